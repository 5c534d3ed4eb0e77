"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are its words, its pairs of neighbours and its pairs with one word between, hashed to
``DIMENSIONS`` coordinates and counted once each. FTRL-proximal keeps a learning rate per
coordinate, and its L1 term leaves all but a few thousand weights at zero, so the model is a short
list that any task can hold: at most ``DIMENSIONS`` pairs, usually far fewer.

The classifier learns from a sample of labelled rows of at most about ``POSITIVES`` toxic and ``NEGATIVES``
other documents, drawn by a hash of the id; every text is scored whole.

Defined cases: a null text scores as an empty one, which has the bias alone; an id with several
label rows is toxic if one of them says so, and null labels teach nothing; an id with several
documents teaches its greatest text; without labels of both kinds every score is the share of toxic
labels (0 if there are none); other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from sonaria.llm.common import held_out

BITS = 20
DIMENSIONS = 1 << BITS
BIAS = DIMENSIONS
POSITIVES = 3_000
NEGATIVES = 3_000
HELD_OUT_OF = 5
SEED = 11
EPOCHS = 8
ALPHA, BETA, L1, L2 = 0.3, 1.0, 5.0, 0.1
#: Words that a worker remembers the hash of, and words that are hashed at once.
WORD_CACHE = 300_000
BLOCK = 1 << 18

_WORD = re.compile(r"\w+")
_HASHES: dict[str, int] = {}


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word of the lower-cased text."""
    words = _WORD.findall(text.lower())
    if len(_HASHES) > WORD_CACHE:
        _HASHES.clear()
    try:
        return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    except KeyError:
        for word in set(words):
            _HASHES[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))


def _coordinates(words: np.ndarray) -> Iterator[np.ndarray]:
    """Coordinates of words, pairs and skip pairs, block by block, repeats included."""
    mixers = (
        np.uint64(0x9E3779B97F4A7C15),
        np.uint64(0xC2B2AE3D27D4EB4F),
        np.uint64(0x165667B19E3779F9),
    )
    shift = np.uint64(64 - BITS)
    for start in range(0, len(words), BLOCK):
        own = words[start : start + BLOCK + 2]
        first = own[:BLOCK] * mixers[0]
        yield (first >> shift).astype(np.int64)
        for gap, mixer in ((1, mixers[1]), (2, mixers[2])):
            later = own[gap : gap + len(first)]
            pair = (first[: len(later)] ^ (later * mixer)) * mixers[0]
            yield (pair >> shift).astype(np.int64)


def features(text: str | None) -> np.ndarray:
    """Sorted different coordinates of a text."""
    parts = list(_coordinates(word_hashes(text or "")))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, dtype=np.int64)


class FtrlProximal:
    """Per-coordinate FTRL-proximal for 0/1 features; the bias has no L1 term."""

    def __init__(self):
        self.z = np.zeros(DIMENSIONS + 1)
        self.n = np.zeros(DIMENSIONS + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == BIAS, 0.0, L1)
        shrunk = z - np.sign(z) * l1
        rate = (BETA + np.sqrt(self.n[at])) / ALPHA + L2
        return np.where(np.abs(z) <= l1, 0.0, -shrunk / rate)

    def learn(self, at: np.ndarray, label: float) -> None:
        w = self.weights(at)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t.as_py()).astype(np.int32) for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), pa.array(found, pa.list_(pa.int32()))],
            ["draw", "toxic", "features"],
        )


def _train(rows: pa.Table) -> pa.Table:
    """The whole bounded sample in one task: (coordinate, weight) of the weights that are not zero."""
    order = np.argsort(rows["draw"].to_numpy(), kind="stable")
    labels = rows["toxic"].to_numpy().astype(float)
    column = rows["features"].combine_chunks()
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    model, bias = FtrlProximal(), np.array([BIAS])
    turn = np.random.default_rng(SEED)
    for _ in range(EPOCHS):
        for row in turn.permutation(order):
            at = np.concatenate([values[ends[row] : ends[row + 1]].astype(np.int64), bias])
            model.learn(at, labels[row])
    every = np.arange(DIMENSIONS + 1)
    weights = model.weights(every)
    if len(set(labels)) < 2:
        share = min(max(labels.mean(), 1e-6), 1 - 1e-6)
        weights = np.where(every == BIAS, np.log(share / (1 - share)), 0.0)
    kept = np.flatnonzero((weights != 0) | (every == BIAS))
    return pa.table({"coordinate": kept, "weight": weights[kept]})


def training_sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, text, toxic and draw of the bounded sample, without the held-out ids."""
    known = (
        labels.where(
            F.col("toxic").isNotNull()
            & F.col("doc_id").isNotNull()
            & ~held_out(F.col("doc_id"), HELD_OUT_OF, 0)
        )
        .groupBy("doc_id")
        .agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
        .withColumn("draw", F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string")))
    )
    sizes = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).toLocalIterator()}
    part = F.lit(0.0)
    for label, most in ((1, POSITIVES), (0, NEGATIVES)):
        share = min(1.0, most / max(sizes.get(label, 0), 1))
        part = F.when(F.col("toxic") == label, F.lit(share)).otherwise(part)
    place = F.col("draw").cast("double") / 2.0**64 + 0.5
    # About POSITIVES + NEGATIVES rows of three numbers whatever the input: small enough to broadcast.
    chosen = known.where(place < part)
    return (
        docs.select("doc_id", "text")
        .join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "toxic", "draw")
        .agg(F.max(F.coalesce("text", F.lit(""))).alias("text"))
    )


def train(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Coordinates and weights of the model; at most ``DIMENSIONS`` + 1 of them."""
    sample = training_sample(docs.select("doc_id", "text"), labels.select("doc_id", "toxic"))
    rows = sample.select("draw", "text", "toxic").mapInArrow(
        _sample_features, "draw long, toxic int, features array<int>"
    )
    found = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(_train, "coordinate long, weight double")
    pairs = [(r["coordinate"], r["weight"]) for r in found.toLocalIterator()]
    pairs = pairs or [(BIAS, -35.0)]
    return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


def scorer(model: tuple[np.ndarray, np.ndarray]):
    """Column function: the score of a text column."""
    at, weights = model
    dense: dict[str, np.ndarray] = {}

    def one(text: str | None) -> float:
        if "w" not in dense:
            dense["w"] = np.zeros(DIMENSIONS + 1)
            dense["w"][at] = weights
        w = dense["w"]
        hits = [c[w[c] != 0] for c in _coordinates(word_hashes(text or ""))]
        total = w[BIAS] + (w[np.unique(np.concatenate(hits))].sum() if hits else 0.0)
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -35, 35))))

    @pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype="float64")

    return score


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, one row per document; no shuffle of texts."""
    score = scorer(train(docs, labels))
    scored = docs.select("doc_id", score(F.col("text")).alias("score"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), HELD_OUT_OF, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not predicted toxic, with all their columns."""
    score: Column = scorer(train(docs, labels))(F.col("text"))
    return docs.where(score < 0.5)
