"""Exact top-k inner products by multi-resolution segment statistics.

With means m and deviations s of the segments of two vectors, the squared distance is at least the sum of
len * ((mq - mc)^2 + (sq - sc)^2) over the segments, so the inner product is at most the sum of
len * (mq mc + sq sc). A block of candidates meets a block of queries: bounds from few long segments
drop most pairs, bounds from more and shorter segments drop more, and survivors are computed exactly.
A pair is only dropped if its bound lies below the k-th best score that its query has already.

Queries and candidates are dealt to blocks by hash and meet in the grid of blocks; a cell returns k rows
per query, and the best k of all cells are the result.

Defined cases: vectors that are null, empty or hold null or non-finite components, and rows without
an id, take no part (zero vectors do); vectors of different lengths do not meet; rows with a query's
id are its own; repeated rows are candidates each; ties go to the smaller id; queries without candidates
return no row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.session import materialise

K = 5
SCALE = 256
#: Segments of a vector, coarse to fine.
RESOLUTIONS = (4, 16)
QUERY_BLOCK = 1024
CANDIDATE_BLOCK = 8192
LEAST_BLOCKS = 16
#: Candidates whose bounds are computed at once.
PANEL = 2048


def segment_statistics(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations by segment, scaled so that a dot product of two rows is the bound."""
    edges = np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int)
    length = np.diff(edges)
    mean = np.add.reduceat(vectors, edges[:-1], axis=1) / length
    square = np.add.reduceat(vectors * vectors, edges[:-1], axis=1) / length
    deviation = np.sqrt(np.maximum(square - mean * mean, 0.0))
    return np.hstack([mean, deviation]) * np.sqrt(np.hstack([length, length]))


def best_of_block(
    queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, score) of the k best candidates of every query; exact."""
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    levels = [
        (segment_statistics(queries, n), segment_statistics(rows, n))
        for n in RESOLUTIONS
        if n < queries.shape[1]
    ]
    best = np.full((len(queries), k), -np.inf)
    owner = np.full((len(queries), k), -1, dtype=np.int64)
    # Rounding of bounds is far below this part of the product of the lengths.
    slack = 1e-9 * np.linalg.norm(queries, axis=1)[:, None]
    size = np.linalg.norm(rows, axis=1)
    for start in range(0, len(rows), PANEL):
        own = np.arange(start, min(start + PANEL, len(rows)))
        alive = query_ids[:, None] != ids[None, own]
        for of_query, of_row in levels:
            q, c = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
            if not len(q):
                break
            bound = of_query[q] @ of_row[own[c]].T + slack[q] * size[own[c]][None, :] + 1e-9
            alive[np.ix_(q, c)] &= bound >= best[q, -1][:, None]
        q, c = np.flatnonzero(alive.any(axis=1)), np.flatnonzero(alive.any(axis=0))
        if not len(q):
            continue
        score = np.where(alive[np.ix_(q, c)], queries[q] @ rows[own[c]].T, -np.inf)
        # Ids rise from panel to panel and inside it, so a stable sort gives ties to the smaller id.
        every = np.hstack([best[q], score])
        names = np.hstack([owner[q], np.broadcast_to(ids[own[c]], score.shape)])
        top = np.argsort(-every, axis=1, kind="stable")[:, :k]
        best[q] = np.take_along_axis(every, top, axis=1)
        owner[q] = np.take_along_axis(names, top, axis=1)
    at, place = np.nonzero(np.isfinite(best))
    return at, owner[at, place], best[at, place]


def _cell(k: int):
    def run(rows: pa.Table) -> pa.Table:
        matrix = rows["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        matrix = matrix.astype(np.float64).reshape(len(rows), -1)
        asks = rows["q"].to_numpy(zero_copy_only=False)
        ids = rows["id"].to_numpy()
        at, found, score = best_of_block(matrix[asks], ids[asks], matrix[~asks], ids[~asks], k)
        return pa.table(
            {
                "query_id": ids[asks][at],
                "vec_id": found.astype(np.int64),
                "score": np.rint(score).astype(np.int64),
            }
        )

    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` candidates with the highest inner product.

    Components are floor(SCALE * x); products are exact below 2^53.
    """
    usable = F.expr(
        "vec_id is not null and embedding is not null and size(embedding) > 0 and"
        " forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"
    )
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE).cast("long"))
    rows = materialise(
        vectors.select("vec_id", "embedding")
        .where(usable)
        .select(
            F.col("vec_id").alias("id"),
            scaled.alias("v"),
            F.size("embedding").alias("d"),
            F.coalesce(is_query, F.lit(False)).alias("q"),
        ),
        "scaled",
    )
    counted = rows.agg(F.count(F.lit(1)), F.count_if("q")).first()
    columns = max(LEAST_BLOCKS, math.ceil(counted[0] / CANDIDATE_BLOCK))
    lines = max(1, math.ceil(counted[1] / QUERY_BLOCK))
    # Repeated query rows ask the same once.
    asked = rows.where("q").distinct().select(
        "d",
        F.pmod(F.xxhash64("id"), F.lit(lines)).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"),
        "q",
        "id",
        "v",
    )
    searched = rows.select(
        "d",
        F.explode(F.sequence(F.lit(0), F.lit(lines - 1))).alias("i"),
        F.pmod(F.xxhash64("id", "v"), F.lit(columns)).cast("int").alias("j"),
        F.lit(False).alias("q"),
        "id",
        "v",
    )
    cells = (
        asked.unionByName(searched)
        .groupBy("d", "i", "j")
        .applyInArrow(_cell(k), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        cells.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
