"""What the operators of this folder share: inputs, ids of texts and connected components."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.session import materialise, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query; the package is sent to the executors before it runs."""

    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(ship_package(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            STATEMENTS[name] = sql
        return fn

    return register


def give_back() -> None:
    """Returns freed memory of a worker, which the next stages share with it, to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def written(df: DataFrame, label: str) -> DataFrame:
    """Written once and read back, as by ``materialise``; the shuffles behind it go as soon as it is written and not when
    the driver collects its garbage, as each may be as large as the input."""
    conf, name = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(name, None)
    conf.set(name, "true")
    try:
        return materialise(df, label)
    finally:
        if before is None:
            conf.unset(name)
        else:
            conf.set(name, before)
        drop_shuffles(df.sparkSession)


def drop_shuffles(spark: SparkSession) -> None:
    """Frees the disk of shuffles whose results are written: Spark deletes their files once the driver's JVM has
    collected the plans they belong to, which a driver with little to do may not do for long."""
    spark.sparkContext._jvm.System.gc()


def unused(columns: list[str], name: str) -> str:
    """``name``, or a longer one that no column has; names differ in case only do not count as different."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    """crc32 of the id as text, modulo ``parts``, equals ``part``; a null id counts as ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star step followed by one small-star step over (a, b) with a > b."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    large = (
        both.join(least, "a")
        .where(F.col("b") > F.col("a"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .distinct()
    )
    lowest = large.groupBy("a").agg(F.min("b").alias("m"))
    # A node that only ever points to its minimum keeps that edge; others hang below it too.
    small = large.join(lowest, "a")
    return (
        small.where(F.col("b") != F.col("m"))
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
        .unionByName(lowest.select("a", F.col("m").alias("b")))
        .distinct()
    )


def components(links: DataFrame, left: str, right: str) -> DataFrame:
    """(node, root) for every node of an undirected link table; root is the smallest node.

    Alternating large-star and small-star steps; each step is written to the shared scratch folder,
    so lineage stays short and a lost executor costs a re-read. A hub is never gathered: its
    minimum is a partial aggregate and its links are met by an equi-join that adaptive execution
    can split. Nodes without a link to another one are not in the result.
    """
    pairs = links.select(F.col(left).alias("x"), F.col(right).alias("y")).where(
        F.col("x").isNotNull() & F.col("y").isNotNull()
    )
    state = materialise(
        pairs.where(F.col("x") != F.col("y"))
        .select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b"))
        .distinct(),
        "links",
    )
    mark = None
    while True:
        seen = state.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen[0] == 0 or tuple(seen) == mark:
            break
        mark = tuple(seen)
        state = materialise(_stars(state), "stars")
    return state.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        state.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
