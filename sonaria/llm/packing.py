"""Best-fit-decreasing packing of tokenised documents into fixed-size sequences.

Best fit decreasing looks at pieces only through their lengths, and lengths are at most the capacity.
So the packing is planned once on the length histogram (at most ``capacity`` rows): pieces of one
length are placed in bulk into runs of equal open bins, the tightest remaining capacity that fits
is found by a segment tree, and every bulk step becomes one row of the plan. The plan has a size bound
that depends on the capacity alone. Pieces then find their place by their rank within their length; no
piece and no document is gathered anywhere.

Defined cases: a null text is an empty one; an empty text is one piece of one token (the end id);
repeated rows and repeated ids are packed once per row; an empty table gives an empty result;
other columns of the input are not read, so their names cannot clash.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaria.llm.common import give_back
from sonaria.session import materialise

CAPACITY = 2048
END_ID = 0
#: Words whose ids a task remembers; more are forgotten and looked up again.
WORD_CACHE = 250_000

_TOKENIZERS: dict[str, "WordIds"] = {}


# The pieces the tokenizer's own pattern finds, written out for characters below U+0180.
_BEYOND = re.compile(r"[\u0130\u0180-\U0010ffff]")
_MARKS = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
_PIECE = re.compile(
    r"[a-zA-Z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+"
    r"|[0-9\u00b2\u00b3\u00b9\u00bc-\u00be]"
    r"|'s|'t|'re|'ve|'m|'ll|'d"
    r"|[^\s\u0085\u00a0a-zA-Z0-9\u00aa\u00b2\u00b3\u00b5\u00b9\u00ba\u00bc-\u00be\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f]+"
)
# The byte alphabet of byte-level vocabularies: printable bytes stand for themselves, others for
# the characters from U+0100 on.
_SHOWN = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_REST = [b for b in range(256) if b not in set(_SHOWN)]
_ALPHABET = {b: chr(b) for b in _SHOWN} | {b: chr(0x100 + i) for i, b in enumerate(_REST)}


class _Pieces(dict):
    """Piece to the bytes of its ids; a full memory starts anew."""

    def __init__(self, model):
        super().__init__()
        self.model = model

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= WORD_CACHE:
            self.clear()
        shown = piece.isascii() and piece.isprintable()
        plain = piece if shown else "".join(map(_ALPHABET.__getitem__, piece.encode()))
        ids = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(plain)])
        self[piece] = ids
        return ids


class _Words(dict):
    """Word to the bytes of its ids; a full memory starts anew."""

    def __init__(self, pieces: _Pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, word: str) -> bytes:
        if len(self) >= WORD_CACHE:
            self.clear()
        ids = b"".join(map(self.pieces.__getitem__, _PIECE.findall(word)))
        self[word] = ids
        return ids


class WordIds:
    """Ids of texts, word by word.

    The tokenizer of the packing query works on pieces, runs of letters, single digits and runs of
    other signs, and drops the white space between them, so the ids of a text are those of its
    words one after the other, and those of a word are those of its pieces. Words come back often;
    their ids are remembered. Texts with characters beyond Latin letters, with added tokens or with
    separators of their own go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words = _Words(_Pieces(self.tokenizer.model))

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of one text."""
        try:
            text.encode("latin-1")
            plain = not any(mark in text for mark in _MARKS)
        except UnicodeEncodeError:
            plain = not (_BEYOND.search(text) or any(mark in text for mark in _MARKS))
        if plain:
            return b"".join(map(self.words.__getitem__, text.lower().split()))
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()


    def forget(self) -> None:
        self.words.clear()
        self.words.pieces.clear()


def word_ids(path: str) -> WordIds:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordIds(path)
    return _TOKENIZERS[path]


def _cut(path: str, capacity: int, keep_ids: bool):
    """Arrow function: documents to pieces. ``part`` and ``place`` number the pieces of a
    length inside the task, which the written table then fixes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, part = word_ids(path), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        end = np.array([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            texts = batch.column(1)
            doc, piece, start, length, crc, place, tokens = [], [], [], [], [], [], []
            for row, doc_id in enumerate(batch.column(0).to_pylist()):
                ids = ids_of.encode(texts[row].as_py() or "") + end
                for at in range(0, len(ids), 4 * capacity):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    doc.append(doc_id)
                    piece.append(at // (4 * capacity))
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(own))
                    place.append(int(seen[n]))
                    seen[n] += 1
                    if keep_ids:
                        tokens.append(np.frombuffer(own, dtype="<u4").astype(np.int32))
            columns = [
                pa.array(doc, batch.schema.field(0).type),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
                pa.array([part] * len(doc), pa.int32()),
                pa.array(place, pa.int64()),
            ]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_place"]
            if keep_ids:
                columns.append(pa.array(tokens, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)
        ids_of.forget()
        give_back()

    return run


class CapacityTree:
    """Segment tree over remaining capacities: how many runs of open bins have each."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, left: int, change: int) -> None:
        at = self.size + left
        while at:
            self.count[at] += change
            at //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that some bin has."""
        at = self.size + need
        if self.count[at]:
            return need
        while at > 1:
            if at % 2 == 0 and self.count[at + 1]:
                at += 1
                break
            at //= 2
        else:
            return None
        while at < self.size:
            at = 2 * at if self.count[2 * at] else 2 * at + 1
        return at - self.size


def plan_packing(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Rows (length, first rank, end rank, first bin, pieces per bin, offset in the bin).

    What best fit decreasing does with the histogram. Bins with the same remaining capacity are
    interchangeable, so a run of them takes the pieces of one length together.
    """
    tree, runs, plan, bins = CapacityTree(capacity), {}, [], 0

    def open_run(left: int, base: int, count: int) -> None:
        if left and count:
            runs.setdefault(left, []).append((base, count))
            tree.add(left, 1)

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while n:
            left = tree.tightest(length)
            if left is None:
                left = capacity
                per_bin = capacity // length
                base, count = bins, -(-n // per_bin)
                bins += count
            else:
                base, count = runs[left].pop()
                tree.add(left, -1)
                per_bin = left // length
            used = min(n, count * per_bin)
            plan.append((length, rank, rank + used, base, per_bin, capacity - left))
            full, more = divmod(used, per_bin)
            open_run(left - per_bin * length, base, full)
            if more:
                open_run(left - more * length, base + full, 1)
            rest = full + bool(more)
            open_run(left, base + rest, count - rest)
            rank, n = rank + used, n - used
    return np.array(plan, dtype=np.int64).reshape(-1, 6)


def _placed(plan: np.ndarray):
    """Arrow function: rank within the length to sequence and offset."""
    order = np.lexsort((plan[:, 1], plan[:, 0])) if len(plan) else np.zeros(0, dtype=np.int64)
    plan = plan[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # (length, rank) becomes one sortable number: lengths are few, ranks below 2^48.
        starts = (plan[:, 0] << 48) + plan[:, 1]
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            step = plan[np.searchsorted(starts, (length << 48) + rank, side="right") - 1]
            inside = rank - step[:, 1]
            sequence = step[:, 3] + inside // step[:, 4]
            offset = step[:, 5] + inside % step[:, 4] * length
            kept = [n for n in batch.schema.names if n != "_rank"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in kept), pa.array(sequence), pa.array(offset)],
                [*kept, "sequence_id", "offset"],
            )

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids if asked for).

    A document is its ids and one end id; only longer ones are cut. Tokenised pieces are written
    once; only the histogram, at most ``capacity`` rows, visits the driver.
    """
    id_type = docs.schema["doc_id"].dataType.simpleString()
    shape = (
        f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, _part int, _place long"
        + (", ids array<int>" if keep_ids else "")
    )
    cut = docs.select("doc_id", "text").mapInArrow(_cut(tokenizer, capacity, keep_ids), shape)
    pieces = materialise(cut, "pieces")
    counts = pieces.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("length").agg(F.sum("n").alias("n"))
    histogram = {r["length"]: r["n"] for r in total.toLocalIterator()}
    before = (
        Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = counts.select(
        "_part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before")
    )
    columns = [c for c in pieces.columns if c not in ("_part", "_place")]
    ranked = pieces.join(offsets, ["_part", "length"]).select(
        *columns, (F.col("_place") + F.col("_before")).alias("_rank")
    )
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.drop("_rank").schema)
    return ranked.mapInArrow(
        _placed(plan_packing(histogram, capacity)), f"{out}, sequence_id long, offset long"
    )


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed sequences themselves, from a packing that kept its ids.

    A sequence has at most ``capacity`` ids, which bounds its group.
    """
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids")
    )
