"""SimHash near-duplicates by anchor-point covering.

Fingerprints that differ in at most three of 64 bits differ in at most one bit of one of their
two halves. The anchors of a half are the words of the perfect Hamming code on 31 of its bits, whose
covering radius is one: every fingerprint has a home anchor within one bit, and its partner then
lies within covering radius plus threshold, two bits, of the same anchor. So a fingerprint goes
to the anchors within two bits, 16 of the 2^26 of each half at most, and is compared there with
those that are at home. Every link is met at its home anchor; none is missed.

Anchors with few at home are a plain equi-join. A crowded anchor is cut into tiles of bounded size, and
a tile returns a spanning forest of its links, not the pairs.

Defined cases: a null text is an empty one; texts without words have fingerprint zero and are linked
like any others; repeated rows share a fingerprint and so a component; null ids belong to the
component of their fingerprint, whose id is null only if all its ids are; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import LongType

from sonaria.llm.common import components
from sonaria.session import materialise

SHINGLE = 3
MOST_BITS = 3
HASH_SEED = 42
#: Shingles whose bits are counted at once.
BLOCK = 1 << 16
#: More fingerprints at home than this make an anchor crowded; rows on either side of a tile.
CROWD = 32
TILE = 2048


def fingerprint(text: str | None) -> int:
    """64-bit majority fingerprint of the word shingles of a text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = iter([b" ".join(words)])
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    n = max(1, len(words) - SHINGLE + 1)
    hashes = np.fromiter(
        map(xxhash.xxh64_intdigest, shingles, repeat(HASH_SEED)), dtype=np.uint64, count=n
    )
    ones = np.zeros(64, dtype=np.int64)
    for start in range(0, n, BLOCK):
        part = hashes[start : start + BLOCK]
        padded = np.zeros(-(-len(part) // 255) * 255, dtype=np.uint64)
        padded[: len(part)] = part
        bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        # At most 255 rows are summed in one byte.
        ones += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    majority = np.packbits(2 * ones > n, bitorder="little")
    return int(majority.view("<i8")[0])


@pandas_udf(LongType())
def fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([fingerprint(t) for t in texts], dtype="int64")


def _half(fp: Column, half: int) -> Column:
    """31 of the 32 bits of a half; two halves then differ in no more bits than before."""
    return F.shiftrightunsigned(fp, 1 + 31 * half).bitwiseAND(F.lit((1 << 31) - 1))


def _syndrome(word: Column) -> Column:
    """Exclusive or of the positions 1..31 of the set bits: the bit to flip to reach the code."""
    found = F.lit(0)
    for k in range(5):
        mask = sum(1 << (i - 1) for i in range(1, 32) if i >> k & 1)
        parity = F.bit_count(word.bitwiseAND(F.lit(mask))) % 2
        found = found + parity * F.lit(1 << k)
    return found


def _flip(word: str, *positions: str) -> str:
    for p in positions:
        word = f"({word} ^ shiftleft(1L, cast({p} as int) - 1))"
    return word


def anchored(fps: DataFrame) -> DataFrame:
    """(half, anchor, home, fp): the anchors within two bits of each fingerprint."""
    halves = F.array(
        *[F.struct(F.lit(h).alias("half"), _half(F.col("fp"), h).alias("word")) for h in (0, 1)]
    )
    words = fps.select("fp", F.explode(halves).alias("h")).select("fp", "h.half", "h.word")
    words = words.withColumn("s", _syndrome(F.col("word")))
    near = F.expr(
        "transform(filter(sequence(1, 31), i -> s != 0 and (i ^ s) > i),"
        f" i -> {_flip('word', 'i', '(i ^ s)')})"
    )
    home = F.when(F.col("s") == 0, F.col("word")).otherwise(F.expr(_flip("word", "greatest(s, 1)")))
    rows = words.select("fp", "half", home.alias("at_home"), near.alias("near"))
    listed = F.concat(F.array("at_home"), F.col("near"))
    return rows.select("fp", "half", F.posexplode(listed).alias("p", "anchor")).select(
        "half", "anchor", (F.col("p") == 0).alias("home"), "fp"
    )


def tile_links(fps: np.ndarray, home: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the links between those at home and all others of a tile."""
    left, right = np.unique(fps[home]), np.unique(fps[~home])
    a, b = left.view(np.uint64), right.view(np.uint64)
    linked = np.bitwise_count(a[:, None] ^ b[None, :]) <= MOST_BITS
    from_, to = [], []
    new = np.ones(len(left), dtype=bool)
    unseen = np.ones(len(right), dtype=bool)
    for start in range(len(left)):
        if not new[start]:
            continue
        new[start] = False
        front = np.array([start])
        members = [left[start : start + 1]]
        while len(front):
            across = np.flatnonzero(linked[front].any(axis=0) & unseen)
            unseen[across] = False
            back = np.flatnonzero(linked[:, across].any(axis=1) & new)
            new[back] = False
            members += [right[across], left[back]]
            front = back
        every = np.unique(np.concatenate(members))
        from_.append(every[1:])
        to.append(np.repeat(every[0], len(every) - 1))
    none = np.zeros(0, dtype=np.int64)
    return (np.concatenate(from_), np.concatenate(to)) if from_ else (none, none)


def _tile(rows: pa.Table) -> pa.Table:
    home = rows["home"].to_numpy(zero_copy_only=False)
    x, y = tile_links(rows["fp"].to_numpy(), home)
    return pa.table({"x": x, "y": y})


def fingerprint_links(fps: DataFrame) -> DataFrame:
    """(x, y): links between different fingerprints; they connect whatever the pairs within three
    bits connect. ``fps`` has each fingerprint once."""
    places = materialise(anchored(fps), "anchors")
    key = ["half", "anchor"]
    crowds = places.groupBy(*key).agg(
        F.count_if("home").alias("n_home"), F.count(F.lit(1)).alias("n_all")
    )
    met = crowds.where((F.col("n_home") > 0) & (F.col("n_all") > 1))
    counted = places.join(met, key)
    calm = counted.where(F.col("n_home") <= CROWD)
    near = F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= MOST_BITS
    pairs = (
        calm.where("home")
        .select(*key, F.col("fp").alias("x"))
        .join(calm.select(*key, F.col("fp").alias("y")), key)
        .where((F.col("x") > F.col("y")) & near)
        .select("x", "y")
    )
    crowded = counted.where(F.col("n_home") > CROWD)
    rows, columns = (F.ceil(F.col(n) / TILE).cast("int") for n in ("n_home", "n_all"))
    draw = F.xxhash64("fp")
    at_home = crowded.where("home").select(
        *key,
        F.lit(True).alias("home"),
        "fp",
        F.pmod(draw, rows).cast("int").alias("i"),
        F.explode(F.sequence(F.lit(0), columns - 1)).alias("j"),
    )
    others = crowded.select(
        *key,
        F.lit(False).alias("home"),
        "fp",
        F.explode(F.sequence(F.lit(0), rows - 1)).alias("i"),
        F.pmod(draw, columns).cast("int").alias("j"),
    )
    forests = (
        at_home.unionByName(others)
        .groupBy(*key, "i", "j")
        .applyInArrow(_tile, "x long, y long")
    )
    return pairs.unionByName(forests)


def _components(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp and more, written) with root, the smallest fingerprint of their component, and
    component_id, its smallest id."""
    fps = materialise(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(fps.select("fp")), "x", "y")
    grouped = materialise(
        fps.join(roots, fps["fp"] == roots["node"], "left").select(
            "fp", "least", F.coalesce("root", "fp").alias("root")
        ),
        "grouped",
    )
    ids = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    named = grouped.join(ids, "root").select("fp", "root", "component_id")
    return rows.join(named, "fp")


def duplicate_components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id, one row per document."""
    rows = materialise(
        docs.select("doc_id", fingerprints(F.col("text")).alias("fp")), "fingerprints"
    )
    return _components(rows).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The document with the smallest id of every component, with all its columns.

    The rows are written once with their fingerprint, a hash of their text and a number, and told apart by
    these, as one id may stand on texts of several components. Of a component's rows with its smallest
    id the one with the smallest fingerprint is kept, then with the smallest hash, then any: these have
    equal ids and texts. A component whose ids are all null keeps one row for each fingerprint.
    """
    marked = materialise(
        docs.select(
            F.struct(*docs.columns).alias("row"),
            fingerprints(F.col("text")).alias("fp"),
            F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("h"),
            F.monotonically_increasing_id().alias("n"),
        ),
        "marked",
    )
    found = _components(marked.select(F.col("row.doc_id").alias("doc_id"), "fp", "h", "n"))
    owns = (F.col("doc_id") == F.col("component_id")) | F.col("component_id").isNull()
    nameless = F.when(F.col("component_id").isNull(), F.col("fp"))
    kept = (
        found.where(owns)
        .groupBy("root", nameless.alias("nameless"))
        .agg(F.min(F.struct("fp", "h", "n")).alias("first"))
        .select("first.n")
    )
    return marked.join(kept, "n", "left_semi").select("row.*")
