"""Corpus preparation: union of splits, filters, last-wins dedup, stable index, resume, report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.constants import BATCH_ROWS, WAV_NAME_FORMAT
from sonaria.functions import text
from sonaria.session import materialise


def union_splits(splits: list[DataFrame]) -> DataFrame:
    """Ordered union: rows keep the rank of their split."""
    ranked = [df.withColumn("file_rank", F.lit(rank)) for rank, df in enumerate(splits)]
    return reduce(lambda a, b: a.unionByName(b), ranked)


def usable_rows(rows: DataFrame, clips: DataFrame) -> DataFrame:
    """Rows with a sentence whose clip exists; the sentence is stripped afterwards, so one made of
    blanks stays as an empty text."""
    filled = rows.where(F.col("sentence").isNotNull() & (F.col("sentence") != ""))
    return (
        filled.join(clips.select("path").distinct(), "path", "left_semi")
        .withColumn("text", text.strip(F.col("sentence")))
        .drop("sentence")
    )


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; copies collapse before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("newest")
    return rows.groupBy(key).agg(newest).select(key, "newest.*")


def unique_rows(rows: DataFrame, clips: DataFrame, order: list[str]) -> DataFrame:
    """``usable_rows`` with the last row per path, as one step.

    Whether a clip exists depends on the path alone, so copies collapse first and the join sees
    every path once: a path that fills a third of the input is one row by then.
    """
    filled = rows.where(F.col("sentence").isNotNull() & (F.col("sentence") != ""))
    last = last_wins(filled, "path", order)
    return (
        last.join(clips.select("path").distinct(), "path", "left_semi")
        .withColumn("text", text.strip(F.col("sentence")))
        .drop("sentence")
    )


def stable_index(rows: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """0-based position in the total order, without a single-task window. ``order`` should end in a
    unique column: rows equal in all of it share one range partition.

    Rows are range-partitioned and sorted once and written with their place inside the partition;
    partition sizes then give each partition's offset. The offsets table has one row per
    partition, which bounds its broadcast.
    """
    place = F.monotonically_increasing_id()
    placed = (
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.shiftright(place, 33))
        .withColumn("_pos", place.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    fixed = materialise(placed, "stable-index")
    sizes = fixed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    return (
        fixed.join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_pos") + F.col("_offset"))
        .drop("_part", "_pos", "_offset")
    )


def batches(indexed: DataFrame, start: Column, size: int = BATCH_ROWS) -> DataFrame:
    """Rows from ``start`` on, with their batch number and output name."""
    return (
        indexed.where(F.col("idx") >= start)
        .withColumn("batch", F.floor((F.col("idx") - start) / size))
        .withColumn("wav_name", F.format_string(WAV_NAME_FORMAT, F.col("idx")))
    )


def resume_start(progress: Column, existing_lines: Column, total: Column) -> Column:
    """Where to go on: the marker or the lines already written, whichever is further."""
    return F.least(F.greatest(progress, existing_lines), total)


def progress_after(done: DataFrame) -> DataFrame:
    """One row: the index up to which all is done."""
    return done.agg((F.coalesce(F.max("idx"), F.lit(-1)) + 1).alias("progress"))


def done_keys(metadata: DataFrame, full_path: bool = False) -> DataFrame:
    key = F.col("file") if full_path else text.done_key(F.col("file"))
    return metadata.where(F.coalesce(F.col("file"), F.lit("")) != "").select(key.alias("done_key")).distinct()


def todo(clips: DataFrame, metadata: DataFrame, full_path: bool = False) -> DataFrame:
    """Clips not yet in the metadata. Equal names in different folders count as the same clip
    unless ``full_path`` is asked for."""
    key = F.col("path") if full_path else text.done_key(F.col("path"))
    return (
        clips.withColumn("done_key", key)
        .join(done_keys(metadata, full_path), "done_key", "left_anti")
        .drop("done_key")
    )


def run_report(
    results: DataFrame, keys: list[str] | None = None, seconds: Column | None = None
) -> DataFrame:
    """n_rows, n_ok, n_bad, minutes and rows per second (at least one second) of finished rows.

    The time is the span of ``ts_us``, or ``seconds`` where the run was timed as a whole.
    """
    if seconds is None:
        seconds = (F.max("ts_us") - F.min("ts_us")) / 1e6
    return results.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.col("error").isNull()).alias("n_ok"),
        F.count_if(F.col("error").isNotNull()).alias("n_bad"),
        (seconds / 60).alias("minutes"),
        (F.count(F.lit(1)) / F.greatest(seconds, F.lit(1.0))).alias("rows_per_sec"),
    )
