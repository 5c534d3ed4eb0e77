"""Numbered folders that are written once: readers see a folder when its writer has committed it."""

from __future__ import annotations

from pyspark.sql import SparkSession


def complete(spark: SparkSession, root: str, prefix: str) -> list[str]:
    """Names of the committed folders below ``root`` that start with ``prefix``, sorted."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    top = path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(top):
        return []
    names = [(status.getPath().getName(), status.getPath()) for status in fs.listStatus(top)]
    return sorted(name for name, at in names if name.startswith(prefix) and fs.exists(path(at, "_SUCCESS")))


def numbers(spark: SparkSession, root: str, prefix: str) -> list[int]:
    """Numbers of the committed folders ``<prefix><number>``, rising."""
    return sorted(int(name[len(prefix) :]) for name in complete(spark, root, prefix))
