"""Name -> Spark query and, where SQL can say it, the equivalent statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sonaria.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STATEMENTS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Look-ups with hot keys count on it, whoever built the session.
            spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
            return fn(ship_package(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            STATEMENTS[name] = sql
        return fn

    return register
