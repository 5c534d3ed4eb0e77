"""Every registered query against its SQL statement on the smallest tables."""

from __future__ import annotations

import os
import re

import pytest
from oracle import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries()))
def test_query_matches_sql(spark, con, name):
    problem, _, _ = compare(spark, con, name, queries()[name], oracle_sql().get(name), SF)
    assert problem is None


def test_entry_runs(spark):
    assert entry(spark).count() > 0


def test_no_driver_side_data_paths():
    """Operators neither collect tables nor join everything with everything."""
    for folder, _, files in os.walk(os.path.join(ROOT, "sonaria")):
        for name in files:
            if name.endswith(".py"):
                body = open(os.path.join(folder, name), encoding="utf-8").read()
                assert not re.search(r"\.(collect|toPandas|toArrow|crossJoin|localCheckpoint)\(", body), name
