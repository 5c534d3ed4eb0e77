"""Speaker matching: probes against a registry, pair checks, decisions, upserts.

A probe row is ``(probe_id, embedding)``, a registry row ``(user_id, ref_path, embedding)``.
Ids must be unique on each side. Scores of a probe against every registry vector are never
emitted as rows: tasks multiply blocks and keep the best k of each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.constants import MATCH_THRESHOLD, TOP_K
from sonaria.functions import vectors

MATCH_TYPE = "array<struct<user_id:string,score:double,cosine:double,ref_path:string>>"
# Rows of a block of probes and of a block of the registry. Probes are the many, so their blocks are the
# larger ones: a registry row is sent once for each of them.
PROBE_ROWS = 65536
BLOCK_ROWS = 16384
SCORE_CELLS = 4_000_000
# Blocks of a side that meet blocks smaller than the bounds above: every row is copied once for each block of
# the other side, so a fixed small block would make copies that grow with the square of the rows.
GRID = 16
# Columns whose best values bound the best of all.
BOUND_COLUMNS = 512
# Scores equal to this many decimals count as ties, so that block shape cannot decide an order.
TIE_DECIMALS = 12

_ARROW_MATCH = pa.struct(
    [
        ("user_id", pa.string()),
        ("score", pa.float64()),
        ("cosine", pa.float64()),
        ("ref_path", pa.string()),
    ]
)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit rows of a list column (null rows left out) and the mask of the rows present."""
    present = np.asarray(column.is_valid())
    lists = column.drop_null()
    flat = lists.flatten()
    flat = flat.fill_null(float("nan")) if flat.null_count else flat
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    count = len(lists)
    width = len(values) // count if count else 0
    if count and (np.diff(np.asarray(lists.offsets)) != width).any():
        raise ValueError("embeddings differ in dimension")
    rows = values.reshape(count, width)
    lengths = np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    return rows / lengths, present


def _best(cosines: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best per row, by score then column; columns are in id order."""
    width = cosines.shape[1]
    if k >= width:
        rows = np.repeat(np.arange(len(cosines)), width)
        cols = np.tile(np.arange(width), len(cosines))
    else:
        # The k-th best of some columns is at most the k-th best of all; what may round to it is ranked.
        some = cosines[:, :: max(1, width // max(k, BOUND_COLUMNS))]
        low = np.partition(some, -k, axis=1)[:, -k : some.shape[1] - k + 1]
        rows, cols = np.nonzero(cosines >= low - 2 * 10.0**-TIE_DECIMALS)
    ranked = np.round(cosines[rows, cols], TIE_DECIMALS)
    order = np.lexsort((cols, -ranked, rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep]


def _match_lists(
    column: pa.Array, ids: np.ndarray, paths: np.ndarray, matrix: np.ndarray, top_k: int
) -> pa.Array:
    """One match list per probe row; a null probe or an empty registry gives an empty list."""
    probes, present = _matrix(column)
    sizes = np.zeros(len(column), dtype=np.int64)
    parts: list[tuple[np.ndarray, np.ndarray]] = []
    if len(ids) and len(probes):
        if probes.shape[1] != matrix.shape[1]:
            raise ValueError("probe and registry dimensions differ")
        usable = ~np.isnan(probes).any(axis=1)
        where = np.flatnonzero(present)[usable]
        probes = probes[usable]
        k = max(1, min(int(top_k), len(ids)))
        step = max(1, SCORE_CELLS // len(ids))
        for lo in range(0, len(probes), step):
            cosines = probes[lo : lo + step] @ matrix.T
            rows, cols = _best(cosines, k)
            parts.append((cols, cosines[rows, cols]))
        sizes[where] = k
    cols = np.concatenate([p[0] for p in parts]) if parts else np.zeros(0, dtype=np.int64)
    cos = np.concatenate([p[1] for p in parts]) if parts else np.zeros(0)
    matches = pa.StructArray.from_arrays(
        [
            pa.array(ids[cols], pa.string()),
            pa.array((np.clip(cos, -1.0, 1.0) + 1.0) / 2.0),
            pa.array(cos),
            pa.array(paths[cols], pa.string()),
        ],
        fields=list(_ARROW_MATCH),
    )
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), matches)


def _registry_arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, paths and unit matrix, in id order so that ties fall to the smaller id."""
    column = table.column("embedding").combine_chunks()
    table = table.filter(column.is_valid()).sort_by("user_id")
    matrix, _ = _matrix(table.column("embedding").combine_chunks())
    ids = np.array(table.column("user_id").to_pylist(), dtype=object)
    paths = np.array(table.column("ref_path").to_pylist(), dtype=object)
    return ids, paths, matrix


def _blocks(rows: int, wanted: int, bound: int) -> int:
    """Blocks of ``wanted`` rows; if these are more than ``GRID``, then larger ones up to the bound."""
    return max(1, min(-(-rows // wanted), max(GRID, -(-rows // max(wanted, bound)))))


def top_matches(
    probes: DataFrame,
    registry: DataFrame,
    top_k: int = TOP_K,
    block_rows: int = BLOCK_ROWS,
    probe_rows: int = PROBE_ROWS,
) -> DataFrame:
    """(probe_id, matches): the best ``top_k`` registry entries of every probe, best first.

    Exact, and one way for every size: both sides are cut into hashed blocks that meet in a grid, and
    a cell returns its k best. Blocks have the wanted rows while the grid is small, and grow with the table
    up to the bounds of the module. Registry vectors with null or non-finite components match nothing.
    """
    probes = probes.select("probe_id", "embedding")
    registry = registry.select("user_id", "ref_path", "embedding").where(
        vectors.finite(F.col("embedding"))
    )
    n_registry = registry.count()
    n_probes = probes.count()
    p_blocks = _blocks(n_probes, probe_rows, PROBE_ROWS)
    r_blocks = _blocks(n_registry, block_rows, BLOCK_ROWS)
    left = probes.withColumn("pb", F.pmod(F.xxhash64("probe_id"), F.lit(p_blocks))).withColumn(
        "rb", F.explode(F.sequence(F.lit(0), F.lit(r_blocks - 1)))
    )
    right = registry.withColumn("rb", F.pmod(F.xxhash64("user_id"), F.lit(r_blocks)).cast("int"))
    right = right.withColumn("pb", F.explode(F.sequence(F.lit(0), F.lit(p_blocks - 1))))
    left = left.withColumn("pb", F.col("pb").cast("int"))

    def cell(probe_rows: pa.Table, registry_rows: pa.Table) -> pa.Table:
        ids, paths, matrix = _registry_arrays(registry_rows)
        lists = _match_lists(
            probe_rows.column("embedding").combine_chunks(), ids, paths, matrix, top_k
        )
        return pa.table({"probe_id": probe_rows.column("probe_id"), "matches": lists})

    id_type = probes.schema["probe_id"].dataType.simpleString()
    local = (
        left.groupBy("pb", "rb")
        .cogroup(right.groupBy("pb", "rb"))
        .applyInArrow(cell, f"probe_id {id_type}, matches {MATCH_TYPE}")
    )
    return _merge_blocks(local, top_k)


def _merge_blocks(local: DataFrame, top_k: int) -> DataFrame:
    """Best k over the per-block bests: at most k rows per probe survive each step."""
    from pyspark.sql import Window

    order = Window.partitionBy("probe_id").orderBy(
        F.round("m.cosine", TIE_DECIMALS).desc_nulls_last(), F.col("m.user_id")
    )
    ranked = (
        local.select("probe_id", F.explode_outer("matches").alias("m"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= max(1, top_k))
    )
    pairs = F.collect_list(F.when(F.col("m").isNotNull(), F.struct("rank", "m")))
    return ranked.groupBy("probe_id").agg(
        F.transform(F.array_sort(pairs), lambda p: p["m"]).alias("matches")
    )


def match_rows(matched: DataFrame) -> DataFrame:
    """Match lists as rows: probe_id, rank (from 1), user_id, cosine, score, ref_path."""
    return matched.select("probe_id", F.posexplode("matches").alias("pos", "m")).select(
        "probe_id", (F.col("pos") + 1).alias("rank"), "m.*"
    )


def decide(
    matched: DataFrame, threshold: float | Column = MATCH_THRESHOLD, keep_best: bool = False
) -> DataFrame:
    """Adds decision, threshold and best. ``best`` is null below the threshold unless kept."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    best = F.get("matches", F.lit(0))
    decision = F.coalesce(best["score"] >= limit, F.lit(False))
    return (
        matched.withColumn("decision", decision)
        .withColumn("threshold", limit)
        .withColumn("best", best if keep_best else F.when(F.col("decision"), best))
    )


def verify_pairs(
    probes: DataFrame, references: DataFrame, on: str, threshold: float = MATCH_THRESHOLD
) -> DataFrame:
    """One reference per key; the threshold applies to the raw cosine here, not to the score."""
    pairs = probes.join(
        references.select(on, F.col("embedding").alias("reference")), on, "inner"
    )
    return pairs.withColumn("cosine", vectors.cosine("embedding", "reference")).withColumn(
        "decision", F.col("cosine") >= threshold
    )


def latest_enrolments(enrolments: DataFrame, order: list[str]) -> DataFrame:
    """Last enrolment of each user; one row per user and map task reaches the shuffle."""
    rest = [c for c in enrolments.columns if c != "user_id"]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("newest")
    return enrolments.groupBy("user_id").agg(newest).select("user_id", "newest.*")


def upsert(registry: DataFrame, enrolments: DataFrame, order: list[str]) -> DataFrame:
    return latest_enrolments(registry.unionByName(enrolments), order)


def listing(registry: DataFrame) -> DataFrame:
    """Sorted ids, each with the registry size; both are returned whatever the caller asked."""
    size = registry.agg(F.count(F.lit(1)).alias("n"))
    return registry.select("user_id", size.scalar().alias("registry_size")).orderBy("user_id")


def first_existing(candidates: DataFrame, existing: DataFrame, request: str) -> DataFrame:
    """First candidate path, by rank, that exists; null for a request without any.

    ``candidates``: request, rank, path. ``existing``: path.
    """
    known = existing.select("path").distinct().withColumn("found", F.lit(True))
    hit = F.when(F.col("found"), F.col("rank"))
    return (
        candidates.join(known, "path", "left")
        .groupBy(request)
        .agg(F.min_by("path", hit).alias("ref_path"))
    )
