"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}
_SHIPPED: set[str] = set()


def build_session(app: str = "sonaria", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the adaptive settings the operators count on.

    Joins here are many-to-one look-ups whose left key may be hot; adaptive skew join splits
    such partitions for inner, left, semi and anti joins alike.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        # Small stages with model slots are worth many tasks; big ones are far above this floor.
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_package(builder.getOrCreate())


def ship_package(spark: SparkSession) -> SparkSession:
    """Sends this package to the Python workers once per application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = os.path.dirname(os.path.abspath(__file__))
        target = os.path.join(tempfile.mkdtemp(prefix="sonaria-package-"), "sonaria")
        archive = shutil.make_archive(
            target, "zip", root_dir=os.path.dirname(package), base_dir=os.path.basename(package)
        )
        context.addPyFile(archive)
        # The driver-side runner of stateful streams does not see shipped files, only this path.
        known = context.environment.get("PYTHONPATH")
        paths = [os.path.dirname(package)] + ([known] if known else [])
        context.environment["PYTHONPATH"] = os.pathsep.join(paths)
        _SHIPPED.add(context.applicationId)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for written intermediate tables, named by ``spark.checkpoint.dir``.

    A local session without the setting gets a folder of its own, which goes when Python ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if context.applicationId not in _LOCAL_SCRATCH:
        folder = tempfile.mkdtemp(prefix="sonaria-scratch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        _LOCAL_SCRATCH[context.applicationId] = folder
    return _LOCAL_SCRATCH[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the scratch folder."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write once and read back, so that later branches see the same rows.

    Cuts lineage through a written table: a lost executor costs a re-read, and values that
    depend on partition layout (ids, random draws) are fixed from here on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
