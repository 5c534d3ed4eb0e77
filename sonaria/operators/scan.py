"""Running aggregates that survive a hot key.

A window over one key sorts the whole key in one task. Here each key is cut into slices along
its order; windows run inside a slice and a carry, summed over the slices before, is added. The
shuffle key is (key, slice), so a key that holds a third of all rows still spreads over the
cluster. The carry table has one row per (key, slice).

``sliced`` cuts by number of rows: whatever the rate of a session, a slice never holds more than it
says. Where positions are dense numbers (samples of a clip) ``block_slice`` says the same without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.session import materialise


@dataclass(frozen=True)
class Running:
    """One running value: ``kind`` is sum, max or min; ``inclusive`` counts the row itself."""

    name: str
    kind: str
    value: Column
    inclusive: bool = True


_AGGREGATE = {"sum": F.sum, "max": F.max, "min": F.min}


def _combine(kind: str, local: Column, carry: Column) -> Column:
    if kind == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    return F.greatest(local, carry) if kind == "max" else F.least(local, carry)


#: Rows of a slice at most.
SLICE_ROWS = 1 << 16
SLICE = "_slice"


def sliced(
    df: DataFrame, keys: list[str], order: list[str], rows: int = SLICE_ROWS, name: str = SLICE
) -> DataFrame:
    """``df`` in a written table, with the number of the slice that a row is in.

    Rows are range-partitioned by keys and order, sorted and written once; a slice is a run of at
    most ``rows`` rows of a partition. Slice numbers never fall along (keys, order). ``order`` should end
    in a column that is unique inside a key: rows equal in all of it share a partition.
    """
    place = F.monotonically_increasing_id()
    in_part = F.floor(place.bitwiseAND(F.lit((1 << 33) - 1)) / F.lit(rows)).cast("bigint")
    cut = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn(name, F.shiftleft(F.shiftright(place, 33), 33).bitwiseOR(in_part))
    )
    return materialise(cut, "sliced")


def block_slice(pos: Column, rows: int) -> Column:
    return F.floor(pos / F.lit(rows))


def running(
    df: DataFrame, keys: list[str], slice_col: str, order: list[str], specs: list[Running]
) -> DataFrame:
    """Adds one column per spec. Keys and slice must not be null; the slice must never fall
    along the order."""
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    earlier = (
        Window.partitionBy(*keys)
        .orderBy(slice_col)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    group = [*keys, slice_col]
    totals = df.groupBy(*group).agg(
        *[_AGGREGATE[s.kind](s.value).alias(f"_t_{s.name}") for s in specs]
    )
    carry = totals.select(
        *group,
        *[
            _AGGREGATE[s.kind](F.col(f"_t_{s.name}")).over(earlier).alias(f"_c_{s.name}")
            for s in specs
        ],
    )
    local = df.select(
        "*",
        *[
            _AGGREGATE[s.kind](s.value).over(upto if s.inclusive else before).alias(f"_l_{s.name}")
            for s in specs
        ],
    )
    joined = local.join(carry, group)
    return joined.select(
        *[F.col(c) for c in df.columns],
        *[
            _combine(s.kind, F.col(f"_l_{s.name}"), F.col(f"_c_{s.name}")).alias(s.name)
            for s in specs
        ],
    )


def following(
    df: DataFrame, keys: list[str], slice_col: str, order: list[str], columns: list[str], name: str
) -> DataFrame:
    """Adds struct ``name`` with ``columns`` of the next row of the key; null on its last row."""
    inside = Window.partitionBy(*keys, slice_col).orderBy(*order)
    later = Window.partitionBy(*keys).orderBy(slice_col)
    row = F.struct(*columns)
    heads = df.groupBy(*keys, slice_col).agg(F.min_by(row, F.struct(*order)).alias("_head"))
    carry = heads.select(*keys, slice_col, F.lead("_head").over(later).alias("_after"))
    local = df.withColumn("_inside", F.lead(row).over(inside))
    return (
        local.join(carry, [*keys, slice_col])
        .withColumn(name, F.coalesce("_inside", "_after"))
        .drop("_inside", "_after")
    )


def with_halo(df: DataFrame, pos: str, rows: int, halo: int) -> DataFrame:
    """Copies rows near a block edge into the neighbour block.

    Adds ``_block`` (block the row is copied to) and ``_home`` (true in its own block). Windows
    of up to ``halo`` rows over (key, _block) are then complete for every home row.
    """
    own = F.floor(F.col(pos) / rows)
    inner = F.pmod(F.col(pos), F.lit(rows))
    blocks = F.array_compact(
        F.array(
            own,
            F.when((inner < halo) & (own > 0), own - 1),
            F.when(inner >= rows - halo, own + 1),
        )
    )
    return df.withColumn("_block", F.explode(blocks)).withColumn("_home", F.col("_block") == own)
