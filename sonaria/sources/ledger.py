"""Run ledger: one commit record per written batch, which readers and reruns go by.

A batch is written to a folder of its own and counts once its record is there. A run that is stopped between
output and record leaves a folder nobody reads; the rerun writes the batch again under a new name. Batches
are numbered by commit; one run writes at a time. Records are as many as batches, never as many as rows.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.operators import dataset
from sonaria.sources import versions

RECORD_SCHEMA = (
    "batch long, kind string, next_idx long, n_rows long, n_ok long, n_bad long, minutes double, "
    "rows_per_sec double"
)
BATCH = "batch-"


def now_us() -> int:
    return time.time_ns() // 1000


def _folders(spark: SparkSession, root: str) -> dict[int, str]:
    """Folder name (number, kind, attempt) of every committed batch, by its number."""
    found: dict[int, str] = {}
    for name in versions.complete(spark, f"{root}/ledger", BATCH):
        found.setdefault(int(name[len(BATCH) :].split("-")[0]), name)
    return found


def records(spark: SparkSession, root: str) -> DataFrame:
    """The commit records: what was written, how it went, and where to go on."""
    folders = [f"{root}/ledger/{name}" for name in _folders(spark, root).values()]
    if not folders:
        return spark.createDataFrame([], RECORD_SCHEMA)
    return spark.read.schema(RECORD_SCHEMA).parquet(*folders)


def progress(spark: SparkSession, root: str, kind: str) -> int:
    """Index up to which all of a kind is written."""
    done = records(spark, root).where(F.col("kind") == kind).agg(F.max("next_idx")).first()[0]
    return done or 0


def commit(
    rows: DataFrame, root: str, kind: str, next_idx: int, started_us: int, now: Callable[[], int] = now_us
) -> None:
    """Writes ``rows`` as the next batch, then its record. Rows with a value in ``error``, if there is such
    a column, count as failed."""
    spark = rows.sparkSession
    number = max(_folders(spark, root), default=-1) + 1
    name = f"{BATCH}{number:06d}-{kind}-{uuid.uuid4().hex}"
    rows.write.parquet(f"{root}/data/{name}")
    written = spark.read.schema(rows.schema).parquet(f"{root}/data/{name}")
    if "error" not in rows.columns:
        written = written.withColumn("error", F.lit(None).cast("string"))
    seconds = F.lit((now() - started_us) / 1e6)
    record = dataset.run_report(written, seconds=seconds).select(
        F.lit(number).cast("long").alias("batch"),
        F.lit(kind).alias("kind"),
        F.lit(next_idx).cast("long").alias("next_idx"),
        "n_rows",
        "n_ok",
        "n_bad",
        "minutes",
        "rows_per_sec",
    )
    record.coalesce(1).write.parquet(f"{root}/ledger/{name}")


def read(spark: SparkSession, root: str, kind: str, schema: str) -> DataFrame:
    """Rows of all committed batches of a kind, with the number of their ``batch``."""
    folders = [f"{root}/data/{n}" for n in _folders(spark, root).values() if n.split("-")[2] == kind]
    if not folders:
        return spark.createDataFrame([], f"{schema}, batch long")
    number = F.regexp_extract(F.col("_metadata.file_path"), f"/{BATCH}([0-9]+)-{kind}-[0-9a-f]+/[^/]*$", 1)
    return spark.read.schema(schema).parquet(*folders).withColumn("batch", number.cast("long"))
