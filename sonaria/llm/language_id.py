"""Language identification by error-correcting output codes.

Every learned language has a codeword; a binary logistic classifier over hashed byte n-grams of letters predicts
each bit. A text is given to the language whose codeword loses least against the predicted margins,
where a bit counts by how well it was learned. The code is exhaustive for few languages and the
best of seeded random codes for many, so a wrong bit or two leaves the nearest codeword the same. Texts
for which a second codeword is nearly as near are flagged.

The classifiers learn from a sample of at most about ``SAMPLE`` documents, spread evenly over the languages and drawn
by a hash; every text is classified whole.

Defined cases: null texts and texts without a letter are ``und`` with score 0; null languages teach
nothing; with one learned language every text with a letter has it, with none every text is ``und``;
repeated rows teach once and are classified each; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from sonaria.llm.common import held_out

BUCKETS = 1 << 13
SAMPLE = 2_000
HELD_OUT_OF, HELD_OUT_PART = 4, 2
SEED = 7
STEPS, RATE, DECAY = 200, 0.5, 1e-4
#: A second language within this distance of the best score makes a text ambiguous.
AMBIGUOUS = 0.2
#: Documents whose n-grams are counted at once, and bytes of a text that are hashed at once.
ROWS = 256
BLOCK = 1 << 20
UNKNOWN = "und"

_NOT_LETTERS = re.compile(r"[\W\d_]+")


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def ngram_counts(text: str) -> np.ndarray:
    """Counts of hashed byte pairs and triples of the lower-cased letters, one space between words."""
    data = np.frombuffer((" " + _NOT_LETTERS.sub(" ", text.lower()) + " ").encode(), dtype=np.uint8)
    counts = np.zeros(BUCKETS, dtype=np.int64)
    for start in range(0, len(data), BLOCK):
        part = data[start : start + BLOCK + 2].astype(np.uint32)
        pairs = part[:-1] * np.uint32(0x9E3779B1) + part[1:] * np.uint32(0x85EBCA77)
        triples = pairs[:-1] * np.uint32(5) + part[2:] * np.uint32(0xC2B2AE3D)
        shift = np.uint32(19)
        counts += np.bincount(triples[:BLOCK] >> shift, minlength=BUCKETS)
        counts += np.bincount(pairs[:BLOCK] >> shift, minlength=BUCKETS)
    return counts


def normalised(counts: np.ndarray) -> np.ndarray:
    """Square roots of shares: rows of length one whatever the length of the text."""
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.sqrt(counts / total).astype(np.float32)


def codewords(languages: int) -> np.ndarray:
    """A matrix of -1 and 1 with a row for each language and no constant or repeated column."""
    if languages < 2:
        return np.ones((languages, 1))
    if languages <= 7:
        columns = [(1, *rest) for rest in product((-1, 1), repeat=languages - 1) if -1 in rest]
        return np.array(columns, dtype=float).T
    bits = 10 * int(np.ceil(np.log2(languages)))
    turn, best, far = np.random.default_rng(SEED), None, -1
    for _ in range(50):
        code = turn.choice((-1.0, 1.0), size=(languages, bits))
        apart = (bits - code @ code.T) / 2
        nearest = apart[~np.eye(languages, dtype=bool)].min()
        mixed = (np.abs(code.sum(axis=0)) < languages).all()
        if mixed and nearest > far:
            best, far = code, nearest
    return best


def _sample_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, n = [], []
        for text in batch.column(2):
            counts = ngram_counts(text.as_py())
            hit = np.flatnonzero(counts)
            at.append(hit.astype(np.int32))
            n.append(counts[hit])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(at, pa.list_(pa.int32())),
                pa.array(n, pa.list_(pa.int64())),
            ],
            ["lang", "draw", "at", "n"],
        )


def _train(rows: pa.Table) -> pa.Table:
    """The whole bounded sample in one task: a row (bit, bias, trust, weights) for each bit of the code."""
    names = rows["lang"].to_pylist()
    languages = sorted(set(names))
    code = codewords(len(languages))
    # One order whatever the partitions were.
    order = np.lexsort((rows["draw"].to_numpy(), np.array(names)))
    x = np.zeros((len(names), BUCKETS))
    for row, (at, n) in enumerate(zip(rows["at"].to_pylist(), rows["n"].to_pylist(), strict=True)):
        x[row, at] = n
    x = normalised(x)[order]
    bits = code[[languages.index(names[i]) for i in order]]
    weights, bias = np.zeros((BUCKETS, code.shape[1]), dtype=np.float32), np.zeros(code.shape[1])
    speed = np.zeros_like(weights)
    for _ in range(STEPS):
        margin = x @ weights + bias
        pull = (bits / (1 + np.exp(bits * margin)) / len(x)).astype(np.float32)
        speed = 0.9 * speed + x.T @ pull - DECAY * weights
        weights += 10 * RATE * speed
        bias += RATE * pull.sum(axis=0)
    margin = x @ weights + bias
    # A bit that is wrong on every twentieth sample weighs as log(19) does.
    wrong = ((margin * bits <= 0).sum(axis=0) + 1.0) / (len(x) + 2.0)
    trust = np.maximum(np.log((1 - wrong) / wrong), 0.01)
    return pa.table(
        {
            "bit": np.arange(code.shape[1]),
            "bias": bias,
            "trust": trust / trust.sum(),
            "weights": pa.array(list(weights.T.astype(np.float64)), pa.list_(pa.float64())),
            "languages": pa.array([languages] * code.shape[1], pa.list_(pa.string())),
        }
    )


def training_sample(docs: DataFrame) -> DataFrame:
    """(lang, draw, text) of the bounded sample without the held-out ids."""
    open_ = docs.where(
        F.col("lang").isNotNull()
        & F.col("text").isNotNull()
        & ~held_out(F.col("doc_id"), HELD_OUT_OF, HELD_OUT_PART)
    ).select(
        "lang",
        F.xxhash64(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).alias("draw"),
        "text",
    )
    sizes = {r["lang"]: r["n"] for r in open_.groupBy("lang").agg(F.count("*").alias("n")).toLocalIterator()}
    each = SAMPLE / max(len(sizes), 1)
    shares = {lang: min(1.0, each / n) for lang, n in sizes.items()}
    part = F.lit(0.0)
    for lang, share in shares.items():
        part = F.when(F.col("lang") == lang, F.lit(share)).otherwise(part)
    place = F.col("draw").cast("double") / 2.0**64 + 0.5
    return open_.where(place < part).groupBy("lang", "draw").agg(F.max("text").alias("text"))


def classifier(docs: DataFrame):
    """Column function: struct of lang_pred, score and ambiguous of a text column."""
    sample = training_sample(docs.select("doc_id", "text", "lang"))
    found = (
        sample.mapInArrow(_sample_counts, "lang string, draw long, at array<int>, n array<long>")
        .withColumn("all", F.lit(0))
        .groupBy("all")
        .applyInArrow(
            _train,
            "bit long, bias double, trust double, weights array<double>, languages array<string>",
        )
    )
    # A row per bit of the code; the code grows with the logarithm of the number of languages.
    bits = sorted(tuple(r) for r in found.toLocalIterator())
    languages = bits[0][4] if bits else []
    code = codewords(len(languages))
    bias = np.array([b[1] for b in bits])
    trust = np.array([b[2] for b in bits])
    weights = np.array([b[3] for b in bits], dtype=np.float32).T

    def decode(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        margin = normalised(counts) @ weights + bias
        # Logistic loss of every codeword, weighted by trust.
        loss = np.stack([np.log1p(np.exp(-np.clip(margin * c, -30, 30))) @ trust for c in code], axis=1)
        chance = np.exp((loss.min(axis=1, keepdims=True) - loss) * code.shape[1])
        chance /= chance.sum(axis=1, keepdims=True)
        best = chance.argmax(axis=1)
        top = np.sort(chance, axis=1)
        second = top[:, -2] if len(languages) > 1 else np.zeros(len(top))
        return best, top[:, -1], top[:, -1] - second < AMBIGUOUS

    @pandas_udf("lang_pred string, score double, ambiguous boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        names = np.full(len(texts), UNKNOWN, dtype=object)
        scores, unsure = np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
        known = [i for i, t in enumerate(texts) if languages and has_letter(t)]
        for start in range(0, len(known), ROWS):
            own = known[start : start + ROWS]
            best, score, doubt = decode(np.stack([ngram_counts(texts.iloc[i]) for i in own]))
            names[own] = [languages[b] for b in best]
            scores[own], unsure[own] = score, doubt
        return pd.DataFrame({"lang_pred": names, "score": scores, "ambiguous": unsure})

    return predict


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous, one row per document; no shuffle of texts."""
    predict = classifier(docs)
    return docs.select("doc_id", predict(F.col("text")).alias("p")).select(
        "doc_id",
        held_out(F.col("doc_id"), HELD_OUT_OF, HELD_OUT_PART).alias("held_out"),
        "p.lang_pred",
        "p.score",
        "p.ambiguous",
    )
