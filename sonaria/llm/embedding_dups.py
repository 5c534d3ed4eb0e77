"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Unit vectors are quantised to int8 with a scale of their own; the length of what quantisation loses is kept
with each of them. In a tile the products of codes, exact in float arithmetic, plus both error
terms bound the cosine from above. Only pairs whose bound reaches the threshold are computed again
in double precision. Vectors are dealt to blocks by hash, so a group of copies spreads over all of
them; equal vectors are one class first. A tile returns a count and a local root for each vector
that has a link, never the pairs.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing;
vectors of different lengths do not link; rows without an id link with nothing and have no
component; rows with equal vectors are linked to each other; an id on several different vectors
stands for each of them; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaria.llm.common import components
from sonaria.session import materialise

THRESHOLD = 0.95
#: Vectors of a block, blocks at least, and rows of a tile that are multiplied at once.
BLOCK = 4096
LEAST_BLOCKS = 8
PANEL = 1024
#: Far above the rounding of a double-precision dot product of unit vectors.
SLACK = 1e-9


def usable(vector: str, dims: int = 1):
    """Condition: the vector can be compared."""
    return (
        F.expr(f"{vector} is not null and size({vector}) >= {dims}")
        & F.expr(f"forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
        & F.expr(f"exists({vector}, x -> x != 0)")
    )


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, scales and the length of the error of each unit vector."""
    scale = np.abs(unit).max(axis=1) / 127.0
    codes = np.rint(unit / scale[:, None]).astype(np.int8)
    lost = np.linalg.norm(unit - codes * scale[:, None], axis=1)
    return codes, scale, lost


def tile_cosines(left: np.ndarray, right: np.ndarray, threshold: float):
    """Yields (rows, columns, links) of sub-tiles that hold links: index arrays and a boolean matrix."""
    (lq, ls, le), (rq, rs, re) = quantise(left), quantise(right)
    # Sums of at most 2^10 products below 2^14 are exact in 24 bits; longer vectors use doubles.
    kind = np.float32 if left.shape[1] <= 1024 else np.float64
    rcodes, rnorm = rq.astype(kind), 1.0 + re
    for start in range(0, len(left), PANEL):
        own = slice(start, start + PANEL)
        product = lq[own].astype(kind) @ rcodes.T
        # |x.y - sx sy qx.qy| <= |rx| |y| + |sx qx| |ry|, and |y| = 1, |sx qx| <= 1 + |rx|.
        bound = (product * ls[own, None]) * rs[None, :]
        bound += le[own, None] + (1.0 + le[own, None]) * re[None, :]
        possible = bound >= threshold - SLACK
        rows, columns = np.flatnonzero(possible.any(axis=1)), np.flatnonzero(possible.any(axis=0))
        if len(rows):
            exact = left[own][rows] @ right[columns].T >= threshold
            exact &= possible[np.ix_(rows, columns)]
            yield rows + start, columns, exact


def _tile(threshold: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        vectors = rows["v"].combine_chunks()
        matrix = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        matrix = matrix.reshape(len(rows), -1)
        # Scaled first, so that squares of huge or tiny components stay finite and above zero.
        matrix /= np.abs(matrix).max(axis=1, keepdims=True)
        matrix /= np.linalg.norm(matrix, axis=1, keepdims=True)
        block, size = rows["b"].to_numpy(), rows["n"].to_numpy()
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        links = np.zeros(len(rows), dtype=np.int64)
        label = np.arange(len(rows))
        for a, b, found in tile_cosines(matrix[left], matrix[right], threshold):
            a, b = left[a], right[b]
            if i == j:
                found &= a[:, None] != b[None, :]
            links[a] += found @ size[b]
            if i != j:
                links[b] += size[a] @ found
            for row in np.flatnonzero(found.any(axis=1)):
                met = np.unique(np.append(label[b[found[row]]], label[a[row]]))
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
        hit = np.flatnonzero(links)
        node, mark = rows["id"].to_numpy(), rows["h"].to_numpy()
        root = label[hit]
        return pa.table(
            {"id": node[hit], "h": mark[hit], "links": links[hit], "root_id": node[root], "root_h": mark[root]}
        )

    return run


def link_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept, one row per vector."""
    rows = vectors.select("vec_id", "embedding").withColumn(
        "_ok", F.coalesce(usable("embedding") & F.col("vec_id").isNotNull(), F.lit(False))
    )
    classes = materialise(
        rows.where("_ok")
        .groupBy("embedding")
        .agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n"))
        .select("id", F.xxhash64("embedding").alias("h"), "n", F.col("embedding").alias("v")),
        "classes",
    )
    most = classes.groupBy(F.size("v").alias("d")).count().agg(F.max("count")).first()[0] or 0
    blocks = max(LEAST_BLOCKS, math.ceil(most / BLOCK))
    dealt = classes.select(
        F.size("v").alias("d"), F.pmod(F.xxhash64("h", "id"), F.lit(blocks)).cast("int").alias("b"), "*"
    )
    tiles = (
        dealt.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        .withColumns({"i": F.least("b", "k"), "j": F.greatest("b", "k")})
        .drop("k")
        .groupBy("d", "i", "j")
        .applyInArrow(_tile(threshold), "id long, h long, links long, root_id long, root_h long")
    )
    found = materialise(tiles, "tiles")
    node, root = F.struct("id", "h"), F.struct(F.col("root_id").alias("id"), F.col("root_h").alias("h"))
    roots = components(found.select(node.alias("x"), root.alias("y")), "x", "y")
    linked = found.groupBy("id", "h").agg(F.sum("links").alias("links"))
    result = (
        classes.join(linked, ["id", "h"], "left")
        .join(roots.select("node.id", "node.h", F.col("root.id").alias("root")), ["id", "h"], "left")
        .select(
            F.col("v").alias("embedding"),
            (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"),
            F.coalesce("root", "id").alias("component"),
        )
    )
    named = rows.where("_ok").join(result, "embedding").select("vec_id", "n_links", "component")
    alone = rows.where("not _ok").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component")
    )
    return named.unionByName(alone).select(
        "vec_id",
        "n_links",
        F.col("component").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("component"), F.lit(False)).alias("kept"),
    )
