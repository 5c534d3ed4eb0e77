"""Hard negatives of anchors by a secondary-sort shuffle.

An anchor's positives are its nearest rows of the same label; each opens a window of scores, and the hard
negatives of that positive are the best rows of other labels inside it. Scores are keyed by (anchor, descending
score, kind, id); repartitionAndSortWithinPartitions brings the scores of an anchor to one partition in
that order, and an iterator reads the stream once: a positive opens its window, a negative is emitted for
every window that holds it and is not full. It remembers the open windows of one anchor, never its rows.

What is shuffled is bounded before: anchors and rows meet in a grid of blocks, and a cell gives
an anchor's best positives of the cell first, then, with the windows known, for every window the best rows of
the cell that it holds. Nothing else can be among the results, so they are exact. Anchors are a stated
set of queries against all rows, in blocks.

Defined cases: rows without an id, without a label, without a vector or with null or non-finite
components take no part; vectors of different lengths do not meet; rows with an anchor's id are
its own and never met, also when the id repeats; equal anchor rows ask once, different rows under
one anchor id ask each (``anchor_row`` tells them apart); repeated rows are candidates each; ties
go to the smaller id; a positive without a row in its window returns nothing, and a negative
positive score has an empty window; an empty table gives an empty result; other columns are not read.
Products are exact while their sums stay below 2^53.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.session import materialise

POSITIVES = 5
NEGATIVES = 10
SCALE = 256
#: A negative's score in hundredths of the positive's.
LOWEST, HIGHEST = 30, 90
ANCHOR_BLOCK = 1024
ROW_BLOCK = 8192
LEAST_BLOCKS = 8
#: Anchors whose scores against a block are held at once.
PANEL = 256

#: Kinds of scores; at equal scores a window opens before rows are held against it.
POSITIVE, NEGATIVE = 0, 1

_PAIR = "anchor_id long, anchor_row long, other_id long, score long"
_RESULT = (
    "anchor_id long, anchor_row long, positive_id long, rank int, negative_id long, "
    "positive_score long, negative_score long"
)


def usable(vectors: DataFrame) -> DataFrame:
    """id, label, v of the rows that take part."""
    sound = F.expr(
        "vec_id is not null and label is not null and embedding is not null and"
        " forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    )
    return vectors.select("vec_id", "label", "embedding").where(sound).select(
        F.col("vec_id").cast("long").alias("id"),
        F.col("label").cast("long").alias("label"),
        F.col("embedding").alias("v"),
    )


def _matrix(rows: pa.Table, dims: int) -> np.ndarray:
    flat = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.floor(SCALE * flat.astype(np.float64)).reshape(len(rows), dims)


def _sides(key: tuple, table: pa.Table) -> tuple:
    """Anchors, rows, and the scores of each panel of anchors; rows stand in the order of their ids."""
    asks = table["asks"].to_numpy(zero_copy_only=False)
    anchors, rows = table.filter(pa.array(asks)), table.filter(pa.array(~asks)).sort_by("id")
    left, right = (_matrix(side, key[0].as_py()) for side in (anchors, rows))
    ids, labels = rows["id"].to_numpy(), rows["label"].to_numpy()
    anchor_ids, anchor_labels = anchors["id"].to_numpy(), anchors["label"].to_numpy()

    def panels():
        for start in range(0, len(anchors), PANEL):
            own = slice(start, start + PANEL)
            other = anchor_ids[own, None] != ids[None, :]
            same = anchor_labels[own, None] == labels[None, :]
            yield start, left[own] @ right.T, other & same, other & ~same

    return anchors, ids, panels()


def _pairs(anchors: pa.Table, ids: np.ndarray, at: list, row: list, score: list) -> pa.Table:
    def joined(parts):
        return np.concatenate(parts) if parts else np.empty(0)

    anchor, found = joined(at).astype(np.int64), joined(row).astype(np.int64)
    return pa.table(
        {
            "anchor_id": anchors["id"].to_numpy()[anchor],
            "anchor_row": anchors["h"].to_numpy()[anchor],
            "other_id": ids[found],
            "score": np.rint(joined(score)).astype(np.int64),
        }
    )


def _best_positives(k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        anchors, ids, panels = _sides(key, table)
        at, row, score = [], [], []
        for start, product, same, _ in panels:
            masked = np.where(same, product, -np.inf)
            # A stable sort over rising ids gives ties to the smaller id.
            top = np.argsort(-masked, axis=1, kind="stable")[:, :k]
            best = np.take_along_axis(masked, top, axis=1)
            a, place = np.nonzero(np.isfinite(best))
            at.append(a + start), row.append(top[a, place]), score.append(best[a, place])
        return _pairs(anchors, ids, at, row, score)

    return run


def _best_of_windows(k: int, lowest: int, highest: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        anchors, ids, panels = _sides(key, table)
        windows = anchors["windows"].to_pylist()
        at, row, score = [], [], []
        for start, product, _, different in panels:
            for i in range(len(product)):
                open_to = np.unique(np.asarray(windows[start + i], dtype=np.float64))
                rows = np.flatnonzero(different[i])
                own = product[i][rows]
                hits = []
                for p in open_to:
                    inside = np.flatnonzero((lowest * p <= 100 * own) & (100 * own <= highest * p))
                    if len(inside) > k:
                        # All that reach the k-th best score, then the first k of them by id.
                        limit = np.partition(own[inside], len(inside) - k)[len(inside) - k]
                        inside = inside[own[inside] >= limit]
                        inside = inside[np.argsort(-own[inside], kind="stable")[:k]]
                    hits.append(inside)
                if hits:
                    found = np.unique(np.concatenate(hits))
                    at.append(np.full(len(found), start + i))
                    row.append(rows[found]), score.append(own[found])
        return _pairs(anchors, ids, at, row, score)

    return run


def _cells(asked: DataFrame, rows: DataFrame, lines: int, columns: int) -> DataFrame:
    """Each anchor once per block of rows, each row once per block of anchors."""
    left = asked.select(
        F.size("v").alias("d"),
        F.pmod(F.xxhash64("id"), F.lit(lines)).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"),
        F.lit(True).alias("asks"),
        "id", "label", "h", "windows", "v",
    )
    right = rows.select(
        F.size("v").alias("d"),
        F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("i"),
        F.pmod(F.xxhash64("id", "v"), F.lit(columns)).cast("int").alias("j"),
        F.lit(False).alias("asks"),
        "id", "label", F.lit(0).cast("long").alias("h"), F.array().cast("array<long>").alias("windows"), "v",
    )
    return left.unionByName(right)


def _key(row) -> tuple:
    """(anchor, descending score, kind, id): the order in which the stream is read."""
    return (row.anchor_id, row.anchor_row, -row.score, row.kind, row.other_id)


def hard_negative_stream(
    keys: Iterator[tuple], positives: int, negatives: int, lowest: int, highest: int
) -> Iterator[tuple]:
    """Result rows from sorted keys; holds the open windows of the current anchor only."""
    current, windows = None, []
    for anchor_id, anchor_row, descending, kind, other in keys:
        if (anchor_id, anchor_row) != current:
            current, windows, seen = (anchor_id, anchor_row), [], 0
        score = -descending
        if kind == POSITIVE:
            if seen < positives:
                windows.append([other, score, 0])
                seen += 1
            continue
        for window in windows:
            positive, reached, told = window
            if lowest * reached <= 100 * score <= highest * reached:
                window[2] = told + 1
                yield (anchor_id, anchor_row, positive, told + 1, other, reached, score)
        # Scores only fall from here: full windows and those left above hold nothing more.
        windows = [w for w in windows if w[2] < negatives and lowest * w[1] <= 100 * score]


def mine(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score, anchor_row.

    Reads vec_id, label and embedding; ``is_anchor`` is a condition on id.
    """
    spark = vectors.sparkSession
    rows = materialise(usable(vectors), "usable")
    asked = rows.where(is_anchor).distinct().withColumn("h", F.xxhash64("label", "v"))
    counted = rows.agg(F.count(F.lit(1)), F.count_if(is_anchor)).first()
    columns = max(LEAST_BLOCKS, math.ceil(counted[0] / ROW_BLOCK))
    lines = max(1, math.ceil(counted[1] / ANCHOR_BLOCK))
    without = F.array().cast("array<long>")
    cells = _cells(asked.withColumn("windows", without), rows, lines, columns)
    near = cells.groupBy("d", "i", "j").applyInArrow(_best_positives(positives), _PAIR)
    order = Window.partitionBy("anchor_id", "anchor_row").orderBy(F.desc("score"), "other_id")
    chosen = materialise(
        near.withColumn("at", F.row_number().over(order)).where(F.col("at") <= positives).drop("at"),
        "positives",
    )
    # At most ``positives`` scores per anchor row.
    opened = chosen.groupBy(F.col("anchor_id").alias("id"), F.col("anchor_row").alias("h")).agg(
        F.collect_list("score").alias("windows")
    )
    cells = _cells(asked.join(opened, ["id", "h"]), rows, lines, columns)
    far = cells.groupBy("d", "i", "j").applyInArrow(
        _best_of_windows(negatives, lowest, highest), _PAIR
    )
    scores = chosen.withColumn("kind", F.lit(POSITIVE)).unionByName(
        far.withColumn("kind", F.lit(NEGATIVE))
    )
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    streamed = (
        scores.rdd.map(lambda row: (_key(row), None))
        .repartitionAndSortWithinPartitions(parts, lambda key: key[1])
        .mapPartitions(
            lambda pairs: hard_negative_stream(
                (key for key, _ in pairs), positives, negatives, lowest, highest
            )
        )
    )
    return spark.createDataFrame(streamed, _RESULT).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score", "anchor_row"
    )
