"""Emit cadence: after an emit at position x the next one is the first row at x + step or later.

The excess over a step is dropped, so emits are a chain, not a division, and where the chain enters a slice
is known only when it has left the one before. It is found in three steps, none of which holds more than a
slice or a bounded number of entries:

1. Every slice follows the chain from each row that it could enter at (those up to a step after its
   first row) and writes (entry, where the chain goes on after the slice).
2. The entries that the chain does visit are found: for a key of few entries by following them in one
   group, for a key of many by pointer doubling, joins of entries with entries that double the length
   of the jumps, so no group grows with the key and the number of rounds is logarithmic.
3. Every visited slice marks its own emits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from sonaria.operators.scan import Running, running, sliced
from sonaria.session import materialise

# Entry position before any row: the first row emits at once.
AT_ONCE = -(2**61)
#: Entries of a key that are followed in one group.
FOLD_ENTRIES = 1 << 16


def chain(follow: np.ndarray, start: int) -> np.ndarray:
    """Positions visited from ``start``, if i leads to follow[i] > i, or to len(follow): the end."""
    n = len(follow)
    if start >= n:
        return np.empty(0, dtype=np.int64)
    jumps = [np.append(follow, n)]
    while (jumps[-1][:-1] < n).any():
        jumps.append(jumps[-1][jumps[-1]])
    seen = np.array([start])
    for jump in reversed(jumps):
        ahead = jump[seen]
        seen = np.concatenate([seen, ahead[ahead < n]])
    return np.sort(seen)


def _entries(x: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """Possible entries of a slice with distinct positions ``x``, and where the chain from each of
    them goes on."""
    n = len(x)
    last = np.arange(n)
    follow = np.searchsorted(x, x + step, side="left")
    last = np.where(follow < n, follow, last)
    while (last[last] != last).any():
        last = last[last]
    count = min(n, int(np.searchsorted(x, x[0] + step, side="left")) + 1)
    return x[:count], x[last[:count]] + step


def _keyed(table: pa.Table, keys: list[str], order: list[str]) -> tuple[pa.Table, list[tuple[int, int]]]:
    """The table by keys and order, and the rows from and to of each key."""
    table = table.sort_by([(name, "ascending") for name in (*keys, *order)]).combine_chunks()
    n = len(table)
    changes = np.zeros(max(n - 1, 0), dtype=bool)
    for name in keys:
        column = table[name]
        changes |= pc.not_equal(column.slice(1), column.slice(0, max(n - 1, 0))).to_numpy()
    edges = [0, *(np.flatnonzero(changes) + 1).tolist(), n]
    return table, list(zip(edges, edges[1:]))


def _numbers(parts: list) -> np.ndarray:
    return np.concatenate(parts) if parts else np.empty(0, dtype=np.int64)


# The three steps run on groups of many keys: a slice has rows of several, and most keys are short.


def _summary(step: int, keys: list[str], slice_col: str) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table, bounds = _keyed(table, keys, ["_x"])
        x = table["_x"].to_numpy()
        rows, needs = [], []
        for begin, end in bounds:
            own = x[begin:end]
            distinct = np.flatnonzero(np.diff(own, prepend=own[0] - 1))
            at, need = _entries(own[distinct], step)
            rows.append(begin + distinct[: len(at)])
            needs.append(need)
        taken = _numbers(rows)
        found = table.select([*keys, slice_col]).take(pa.array(taken))
        return found.append_column("at", pa.array(x[taken])).append_column("need", pa.array(_numbers(needs)))

    return run


def _walk(threshold: int, keys: list[str], slice_col: str) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        # A position may end one slice and begin the next: the chain enters the earlier one.
        table, bounds = _keyed(table, keys, ["at", slice_col])
        at, need = table["at"].to_numpy(), table["need"].to_numpy()
        rows = []
        for begin, end in bounds:
            own = at[begin:end]
            follow = np.searchsorted(own, need[begin:end], side="left")
            rows.append(begin + chain(follow, int(np.searchsorted(own, threshold))))
        return table.select([*keys, slice_col, "at"]).take(pa.array(_numbers(rows)))

    return run


def _mark(step: int, keys: list[str], ties: list[str], columns: list[str]) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        table, bounds = _keyed(table, keys, ["_x", *ties])
        x, entries = table["_x"].to_numpy(), table["at"].to_numpy()
        rows = []
        for begin, end in bounds:
            own = x[begin:end]
            follow = np.searchsorted(own, own + step, side="left")
            rows.append(begin + chain(follow, int(np.searchsorted(own, entries[begin], side="left"))))
        return table.select(columns).take(pa.array(_numbers(rows)))

    return run


def _jumps(items: DataFrame, keys: list[str], slice_rows: int) -> DataFrame:
    """(keys, at, next): the first entry of the key at ``need`` or later; null at the end."""
    targets = items.select(*keys, F.col("at").alias("p"), F.lit(0).alias("probe"), F.col("at").alias("origin"))
    probes = items.select(*keys, F.col("need").alias("p"), F.lit(1).alias("probe"), F.col("at").alias("origin"))
    # From the far end: of equal positions the target counts before the probe looks back at it.
    far = targets.unionByName(probes).withColumn("_far", -F.col("p"))
    order = ["_far", "probe", "origin"]
    cut = sliced(far, keys, order, slice_rows)
    seen = running(
        cut, keys, "_slice", order, [Running("next", "min", F.when(F.col("probe") == 0, F.col("p")))]
    )
    return seen.where("probe = 1").select(*keys, F.col("origin").alias("at"), "next")


def _visited_by_doubling(items: DataFrame, keys: list[str], threshold: int, slice_rows: int) -> DataFrame:
    """(keys, at) of the entries on the chain of each key."""
    node = [*keys, "at"]
    jumps = [materialise(_jumps(items, keys, slice_rows), "jumps")]
    while not jumps[-1].where("next is not null").isEmpty():
        ahead = jumps[-1].select(*keys, F.col("at").alias("next"), F.col("next").alias("_far"))
        longer = jumps[-1].where("next is not null").join(ahead, [*keys, "next"], "left")
        jumps.append(materialise(longer.select(*node, F.col("_far").alias("next")), "jumps"))
    seen = items.where(F.col("at") >= threshold).groupBy(*keys).agg(F.min("at").alias("at"))
    for jump in reversed(jumps):
        ahead = seen.join(jump.where("next is not null"), node).select(*keys, F.col("next").alias("at"))
        seen = materialise(seen.unionByName(ahead), "visited")
    return seen


def _visited(
    items: DataFrame, keys: list[str], slice_col: str, threshold: int, fold_entries: int
) -> DataFrame:
    """(keys, slice, at) of the entries on the chain of each key."""
    sizes = items.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counted = sizes.agg(F.sum("_n"), F.max("_n")).first()
    schema = StructType([*[items.schema[name] for name in (*keys, slice_col)], StructField("at", LongType())])
    sized = items
    if (counted[1] or 0) > fold_entries:
        sized = items.join(sizes.withColumn("_many", F.col("_n") > fold_entries).drop("_n"), keys)
    # Keys of few entries share a group; a group holds about as many as one key may have.
    buckets = F.lit((counted[0] or 0) // fold_entries + 1)
    few = (
        (sized.where("not _many") if sized is not items else items)
        .select(*items.columns, F.pmod(F.xxhash64(*keys), buckets).alias("_bucket"))
        .groupBy("_bucket")
        .applyInArrow(_walk(threshold, keys, slice_col), schema)
    )
    if sized is items:
        return few
    many = materialise(
        sized.where("_many")
        .groupBy(*keys, "at")
        .agg(F.min_by("need", slice_col).alias("need"), F.min(slice_col).alias(slice_col)),
        "entries",
    )
    seen = _visited_by_doubling(many, keys, threshold, max(fold_entries, 2))
    return few.unionByName(many.join(seen, [*keys, "at"]).select(*keys, slice_col, "at"))


def emits(
    df: DataFrame,
    keys: list[str],
    slice_col: str,
    position: str,
    ties: list[str],
    step: int,
    entered: int = AT_ONCE,
    fold_entries: int = FOLD_ENTRIES,
) -> DataFrame:
    """The emitting rows of ``df``.

    ``df`` is read twice and should be a written table whose slices are bounded (``scan.sliced``);
    keys are not null. ``position`` names a non-decreasing long (samples so far, or microseconds),
    ``ties`` what orders rows of one position. The chain starts at ``entered``.
    """
    group = [*keys, slice_col]
    threshold = entered + step
    fields = [df.schema[name] for name in group]
    summary = StructType([*fields, StructField("at", LongType()), StructField("need", LongType())])
    rows = df.withColumn("_x", F.col(position).cast("bigint"))
    items = materialise(
        rows.select(*group, "_x").groupBy(slice_col).applyInArrow(_summary(step, keys, slice_col), summary),
        "entries",
    )
    # A slice is entered once at most.
    entry = _visited(items, keys, slice_col, threshold, fold_entries)
    return (
        rows.join(entry, group)
        .groupBy(slice_col)
        .applyInArrow(_mark(step, keys, ties, df.columns), df.schema)
    )
