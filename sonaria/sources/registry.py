"""Speaker registry: a folder of vector files, and versioned registry tables."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.functions import text, vectors
from sonaria.sources import versions

REGISTRY_SCHEMA = "user_id string, ref_path string, embedding array<float>, enrolled_at long"
PREFIX = "version-"


def read_vector_files(spark: SparkSession, root: str) -> DataFrame:
    """user_id, ref_path, embedding, error of every ``.npy`` file in the folder.

    Vectors are flattened and brought to unit length; an unreadable file keeps its row with the
    error and a null embedding.
    """

    @F.pandas_udf("struct<embedding:array<float>,error:string>")
    def load(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            try:
                array = np.load(io.BytesIO(bytes(data)), allow_pickle=False)
                rows.append((np.asarray(array, dtype=np.float32).reshape(-1), None))
            except Exception as error:
                rows.append((None, repr(error)))
        return pd.DataFrame(rows, columns=["embedding", "error"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(root)
    loaded = files.select("path", load("content").alias("v"))
    unit = vectors.l2_normalise(F.col("v.embedding")).cast("array<float>")
    return loaded.select(
        F.left(text.basename(F.col("path")), F.length(text.basename(F.col("path"))) - 4).alias("user_id"),
        F.col("path").alias("ref_path"),
        F.when(F.col("v.embedding").isNotNull(), unit).alias("embedding"),
        F.col("v.error").alias("error"),
    )


def usable(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("embedding").isNotNull()).drop("error")


def rejects(registry: DataFrame) -> DataFrame:
    return registry.where(F.col("embedding").isNull()).select("user_id", "ref_path", "error")


def require_one_dimension(registry: DataFrame) -> DataFrame:
    """Fails when the vectors differ in dimension."""
    sizes = registry.agg(F.count_distinct(F.size("embedding")).alias("n")).first().n
    if sizes > 1:
        raise ValueError("registry vectors differ in dimension")
    return registry


def read_latest(spark: SparkSession, root: str) -> DataFrame:
    """The newest complete version; readers of an older one are not disturbed by a write."""
    known = versions.numbers(spark, root, PREFIX)
    if not known:
        return spark.createDataFrame([], REGISTRY_SCHEMA)
    return spark.read.schema(REGISTRY_SCHEMA).parquet(f"{root}/{PREFIX}{known[-1]}")


def write_version(registry: DataFrame, root: str) -> int:
    spark = registry.sparkSession
    number = (versions.numbers(spark, root, PREFIX) or [-1])[-1] + 1
    columns = [c.split()[0] for c in REGISTRY_SCHEMA.split(", ")]
    registry.select(*columns).write.parquet(f"{root}/{PREFIX}{number}")
    return number
