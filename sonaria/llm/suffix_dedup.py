"""Exact substring dedup: bytes covered by a 200-byte string that also starts elsewhere.

Sampling. In every window of ``SPAN`` bytes the leftmost smallest hash of ``GRAM`` bytes names an
anchor, so equal windows have anchors at the same place in them. An anchor's context is all
bytes of the windows that may name it. Windows can only be equal if their anchors have equal grams, so
only contexts whose gram occurs again go on, about one row for 80 bytes until then.

Comparing. Contexts that are equal as a whole need no sorting: all their windows are repeats. One of each
set of equal contexts goes on to the suffix array of its bucket. The array is built in two stages:
suffixes smaller than their successors are sorted directly, all others are induced from them by
one scan over the buckets of first bytes. Neighbours in the array with a common prefix of ``SPAN`` bytes are
repeats if they start at different places. A gram that has more different contexts than a bucket should
hold is compared by 128-bit hashes of its windows instead, which is a plain aggregate without hot
groups. Windows are many times the size of their contexts, so this is done in turns, each with its part of the grams.

Texts are known by 128 bits of hash, so copies share their marks and no row ids are needed.

Defined cases: a null text is an empty one; texts below ``SPAN`` bytes keep all their bytes; repeated
rows and repeated ids are documents of their own and repeat each other; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonaria.llm.common import written

SPAN = 200
GRAM = 32
#: Bytes of a text that are hashed at once; neighbouring blocks overlap by a window.
BLOCK = 1 << 17
#: Different contexts of one gram that a suffix array takes, and contexts of one bucket.
HOT = 256
BUCKET = 2_000
#: Hot contexts whose windows are hashed at once.
TOGETHER = 256
#: Turns in which hot contexts are compared. Results do not depend on them.
TURNS = 4

_BASES = {"gram": 0x9E3779B97F4A7C15, "context": 0xD6E8FEB86659FD93}
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_WORD_BASES = [np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64)) for k in range(1, 5)]
_POWERS: dict[str, tuple[np.ndarray, np.ndarray]] = {}


def _powers(kind: str) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base of a hash and of its inverse modulo 2^64."""
    if kind not in _POWERS:
        found = []
        for base in (_BASES[kind], pow(_BASES[kind], -1, 1 << 64)):
            power = np.full(BLOCK + 2 * SPAN, base, dtype=np.uint64)
            power[0] = 1
            found.append(np.multiply.accumulate(power))
        _POWERS[kind] = tuple(found)
    return _POWERS[kind]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _sums(data: np.ndarray, kind: str) -> np.ndarray:
    up, _ = _powers(kind)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def block_anchors(data: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and gram hashes of the anchors of a block of at most ``BLOCK`` bytes and a window;
    ``inside`` says for each window whether it is within one text."""
    width = SPAN - GRAM + 1
    low = np.uint64((1 << 24) - 1)
    _, down = _powers("gram")
    sums = _sums(data, "gram")
    found = _mixed((sums[GRAM:] - sums[:-GRAM]) * down[: len(data) - GRAM + 1])
    n = len(found)
    # Forty bits of hash, then the place: the smallest is the leftmost of equals.
    ranked = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.bitwise_or(found & ~low, np.arange(n, dtype=np.uint64), out=ranked[:n])
    blocks = ranked.reshape(-1, width)
    head = np.minimum.accumulate(blocks, axis=1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    at = (np.minimum(tail[: n - width + 1], head[width - 1 : n])[inside] & low).astype(np.int64)
    if len(at):
        at = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return at, found[at]


def anchors(data: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and gram hashes of the anchors of the texts that end at ``ends``, in order; a place may
    come twice where blocks meet."""
    for start in range(0, max(len(data) - SPAN + 1, 0), BLOCK):
        part = data[start : start + BLOCK + SPAN - 1]
        inside = np.ones(len(part) - SPAN + 1, dtype=bool)
        for end in (ends[slice(*np.searchsorted(ends, [start, start + len(part)]))] - start).tolist():
            inside[max(end - SPAN + 1, 0) : end] = False
        at, gram = block_anchors(part, inside)
        yield at + start, gram


def context_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[begin:end] for stretches in order of ``begin``, block by block."""
    _, down = _powers("context")
    out = np.zeros(len(begin), dtype=np.uint64)
    for start in range(0, len(data), BLOCK):
        own = slice(*np.searchsorted(begin, [start, start + BLOCK]))
        if own.start == own.stop:
            continue
        sums = _sums(data[start : start + BLOCK + 2 * SPAN - 1], "context")
        b, e = begin[own] - start, end[own] - start
        out[own] = _mixed((sums[e] - sums[b]) * down[b]) + (e - b).astype(np.uint64)
    return out


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text or binary column and where its values end, without copies; none is null."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset :][: len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _emit_anchors(grams_only: bool):
    """Arrow function: g (gram), and with it c (context), k1 and k2 (text) and place: the place in the
    text, with the bytes of the context before and after it in its low two bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, ends = _bytes(batch.column(2))
            found = list(anchors(data, ends))
            if not found:
                continue
            place, first = np.unique(np.concatenate([f[0] for f in found]), return_index=True)
            gram = np.concatenate([f[1] for f in found])[first].view(np.int64)
            if grams_only:
                yield pa.RecordBatch.from_arrays([pa.array(gram)], ["g"])
                continue
            text = np.searchsorted(ends, place, side="right")
            start = np.concatenate([[0], ends])[text]
            begin, end = np.maximum(place - (SPAN - GRAM), start), np.minimum(place + SPAN, ends[text])
            before = place - begin
            hashed = context_hashes(data, begin, end) + before.astype(np.uint64) * _MIX
            owner = pa.array(text)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(gram),
                    pa.array(hashed.view(np.int64)),
                    batch.column(0).take(owner),
                    batch.column(1).take(owner),
                    pa.array(((place - start) << 16) | (before << 8) | (end - place)),
                ],
                ["g", "c", "k1", "k2", "place"],
            )

    return run


def suffix_array(
    data: np.ndarray, wide: np.ndarray, depth: int = SPAN, wanted: np.ndarray | None = None
) -> np.ndarray:
    """Suffixes of ``data`` in the order of their first ``depth`` bytes, by two-stage sorting.

    ``wide`` are the names of the bytes from every position. Of a mask of wanted suffixes all are returned, with those that were needed to place them.
    """
    n = len(data)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    # A suffix smaller than its successor rises; in a run of equal bytes the run's end decides.
    step = np.zeros(n, dtype=np.int8)
    step[:-1] = np.sign(data[1:].astype(np.int16) - data[:-1])
    step[-1] = -1
    ends = np.where(step != 0, np.arange(n), n - 1)
    ends = np.minimum.accumulate(ends[::-1])[::-1]
    rising = np.flatnonzero(step[ends] > 0)
    if wanted is not None and len(rising):
        # A falling suffix is placed by the next rising one.
        marked = np.concatenate([[0], np.cumsum(wanted)])
        since = np.concatenate([[0], rising[:-1] + 1])
        rising = rising[marked[rising + 1] > marked[since]]
    risen = sort_suffixes(rising, wide, depth)
    risen_by = np.split(risen, np.searchsorted(data[risen], np.arange(1, 256)))
    # The others follow from the scan: the suffix before an entry goes to the front of its bucket.
    falling: list[list[np.ndarray]] = [[] for _ in range(256)]
    falling[data[-1]].append(np.array([n - 1]))
    order = []
    for byte in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
        front = np.concatenate(falling[byte]) if falling[byte] else np.zeros(0, dtype=np.int64)
        own = [front]
        while len(front):
            earlier = front[front > 0] - 1
            front = earlier[data[earlier] == byte]
            own.append(front)
        bucket = np.concatenate([*own, risen_by[byte]])
        order.append(bucket)
        earlier = bucket[bucket > 0] - 1
        earlier = earlier[data[earlier] > byte]
        heads = data[earlier]
        by_head = np.argsort(heads, kind="stable")
        earlier, heads = earlier[by_head], heads[by_head]
        cuts = np.flatnonzero(heads[1:] != heads[:-1]) + 1
        for part in np.split(earlier, cuts) if len(earlier) else []:
            falling[data[part[0]]].append(part)
    return np.concatenate(order)


def names(data: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """From every position the 8 bytes, as numbers in their order, and with them a hash of the 32 bytes (two
    rows), with room for ``depth`` more positions; bytes after the end are zeros."""
    n = len(data) + depth
    padded = np.zeros(n + 8, dtype=np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(n, dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)
    mixed = _mixed(words)
    hashed = np.zeros(n, dtype=np.uint64)
    for k, base in zip(range(0, 32, 8), _WORD_BASES):
        hashed[: n - k] += mixed[k:] * base
    return words, np.stack([words, _mixed(hashed)])


def _tied(new: np.ndarray) -> np.ndarray:
    """Places of an order that are in a group of several; ``new`` marks where groups begin."""
    tied = ~new
    tied[:-1] |= tied[1:]
    return np.flatnonzero(tied)


def _splitting(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Which of the grouped keys are in a group whose keys differ; ``first`` marks where groups begin."""
    differs = np.flatnonzero((key[1:] != key[:-1]) & ~first[1:]) + 1
    group = np.cumsum(first) - 1
    split = np.zeros(group[-1] + 1, dtype=bool)
    split[group[differs]] = True
    return split[group]


def sort_suffixes(places: np.ndarray, wide: np.ndarray, depth: int) -> np.ndarray:
    """Direct sort, by 8 bytes first, then by more of those that are still tied. Groups that agree in all
    of the next bytes, as most do, are known by their hashes and not sorted again."""
    words, hashed = wide
    order = places[np.argsort(words[places])]
    if len(order) < 2:
        return order
    new = np.concatenate([[True], words[order[1:]] != words[order[:-1]]])
    for offset in range(0, depth, 32):
        at = _tied(new)
        if not len(at):
            break
        at = at[_splitting(hashed[order[at] + offset], new[at])]
        for more in range(offset + 8 if not offset else offset, offset + 32, 8):
            at = at[_tied(new[at])]
            if not len(at):
                break
            key, first = words[order[at] + more], new[at]
            own = _splitting(key, first)
            moved, key, first = at[own], key[own], first[own]
            if not len(moved):
                continue
            # One number for group and key, so that one sort orders all groups.
            by_key = np.argsort(key)
            rank = np.empty(len(key), dtype=np.int64)
            rank[by_key] = np.cumsum(np.concatenate([[0], key[by_key[1:]] != key[by_key[:-1]]]))
            again = np.argsort((np.cumsum(first) << 32) | rank)
            order[moved] = order[moved[again]]
            key = key[again]
            new[moved[1:]] |= key[1:] != key[:-1]
    return order


def common_prefix(order: np.ndarray, small: np.ndarray, wide: np.ndarray, depth: int) -> np.ndarray:
    """For neighbours of the order: whether they agree in their first ``depth`` bytes, a multiple of
    eight."""
    agree = np.ones(max(len(order) - 1, 0), dtype=bool)
    left = np.arange(len(agree))
    whole = depth // 32 * 32
    steps = [(wide[1], o) for o in range(0, whole, 32)] + [(small, o) for o in range(whole, depth, 8)]
    for name, offset in steps:
        same = name[order[left] + offset] == name[order[left + 1] + offset]
        agree[left[~same]] = False
        left = left[same]
    return agree


def repeated_windows(data: np.ndarray, ends: np.ndarray, first: np.ndarray, text: np.ndarray):
    """(context, start in the context, end) of the stretches whose windows start elsewhere too.

    ``data`` are the bytes of all contexts, which stop at ``ends``; ``first`` is the place of a context in
    its text, ``text`` names the text.
    """
    length = np.diff(ends, prepend=0)
    begin = ends - length
    owner = np.repeat(np.arange(len(ends)), length)
    fits = np.arange(len(data)) - begin[owner] + SPAN <= length[owner]
    small, wide = names(data, SPAN + 32)
    order = suffix_array(data, wide, wanted=fits)
    order = order[fits[order]]
    if not len(order):
        return np.zeros((0, 3), dtype=np.int64)
    agree = common_prefix(order, small, wide, SPAN)
    of = owner[order]
    place = (text[of].astype(np.int64) << 32) + first[of] + order - begin[of]
    runs = np.concatenate([[0], np.flatnonzero(~agree) + 1])
    lowest, highest = np.minimum.reduceat(place, runs), np.maximum.reduceat(place, runs)
    size = np.diff(np.append(runs, len(order)))
    hit = np.sort(order[np.repeat(lowest != highest, size)])
    if not len(hit):
        return np.zeros((0, 3), dtype=np.int64)
    cut = np.flatnonzero((np.diff(hit) > 1) | (owner[hit[1:]] != owner[hit[:-1]])) + 1
    from_, to = hit[np.concatenate([[0], cut])], hit[np.append(cut - 1, len(hit) - 1)]
    at = owner[from_]
    return np.stack([at, from_ - begin[at], to - begin[at] + SPAN], axis=1)


def _sort_bucket(rows: pa.Table) -> pa.Table:
    k1, k2 = rows["k1"].to_numpy(), rows["k2"].to_numpy()
    first = rows["first"].to_numpy()
    order = np.lexsort((k2, k1))
    other = (np.diff(k1[order]) != 0) | (np.diff(k2[order]) != 0)
    text = np.empty(len(order), dtype=np.int64)
    text[order] = np.concatenate([[0], np.cumsum(other)])
    data, ends = _bytes(rows["context"].combine_chunks())
    found = repeated_windows(data, ends, first, text)
    at = found[:, 0]
    return pa.table(
        {
            "k1": k1[at],
            "k2": k2[at],
            "from_": (first[at] + found[:, 1]).astype(np.int32),
            "to_": (first[at] + found[:, 2]).astype(np.int32),
        }
    )


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """All entries of a column of lists, with the row of each; null lists have none."""
    sizes = np.diff(column.offsets.to_numpy())
    sizes[column.is_null().to_numpy(zero_copy_only=False)] = 0
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted contexts of each text."""
    for batch in batches:
        owner, wanted = _lists(batch.column("wanted"))
        if not len(owner):
            continue
        data, ends = _bytes(batch.column("text"))
        place = wanted.field("place").to_numpy()
        begin = (place >> 16) - (place >> 8 & 255)
        start = np.concatenate([[0], ends])[owner] + begin
        stop = start + (place >> 8 & 255) + (place & 255)
        view = memoryview(data)
        contexts = [view[b:e].tobytes() for b, e in zip(start.tolist(), stop.tolist(), strict=True)]
        rows = pa.array(owner)
        yield pa.RecordBatch.from_arrays(
            [
                wanted.field("g"),
                wanted.field("hot"),
                batch.column("k1").take(rows),
                batch.column("k2").take(rows),
                pa.array(begin.astype(np.int32)),
                pa.array(contexts, pa.binary()),
            ],
            ["g", "hot", "k1", "k2", "first", "context"],
        )


def _window_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """128-bit hashes of all windows of hot contexts, as two numbers; the windows of many contexts at once."""
    digest = xxhash.xxh3_128_digest
    for whole in batches:
        for begin in range(0, len(whole), TOGETHER):
            batch = whole.slice(begin, TOGETHER)
            found, sizes = [], []
            for context in batch.column("context"):
                data = context.as_py()
                sizes.append(max(len(data) - SPAN + 1, 0))
                found += [digest(data[s : s + SPAN]) for s in range(sizes[-1])]
            if not found:
                continue
            hashed = np.frombuffer(b"".join(found), dtype=np.int64).reshape(-1, 2)
            size = np.array(sizes)
            owner = np.repeat(np.arange(len(size)), size)
            first = batch.column("first").to_numpy()
            rows = pa.array(owner)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(hashed[:, 0].copy()),
                    pa.array(hashed[:, 1].copy()),
                    batch.column("k1").take(rows),
                    batch.column("k2").take(rows),
                    pa.array((first[owner] + np.arange(len(owner)) - (np.cumsum(size) - size)[owner]).astype(np.int32)),
                ],
                ["w1", "w2", "k1", "k2", "from_"],
            )


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2"), text.alias("text"), "doc_id"
    )


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(k1, k2, from_, to_): byte spans of texts to remove, overlapping and repeated ones included."""
    keyed = _keyed(docs)
    texts = keyed.select("k1", "k2", "text")
    again = (
        texts.mapInArrow(_emit_anchors(True), "g long")
        .groupBy("g")
        .agg(F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("g")
    )
    # Anchors are found again rather than written: the table of all of them is as large as the texts.
    every = texts.mapInArrow(_emit_anchors(False), "g long, c long, k1 long, k2 long, place long")
    # Grams that come again are distinct, so their side of the join is even and small enough to hash.
    common = written(every.join(again.hint("shuffle_hash"), "g", "left_semi"), "common-anchors")
    # One place of each context; numbers, unlike structs, are aggregated without a sort.
    turn = F.xxhash64("k1", "k2", "place")
    one_of = [F.min_by(name, turn).alias(name) for name in ("k1", "k2", "place")]
    contexts = written(
        common.groupBy("g", "c").agg(F.count(F.lit(1)).alias("n"), *one_of), "contexts"
    )
    at = F.shiftright("place", 16)
    whole = common.join(contexts.where("n > 1").select("g", "c"), ["g", "c"], "left_semi").select(
        "k1",
        "k2",
        (at - F.shiftright("place", 8).bitwiseAND(255)).cast("int").alias("from_"),
        (at + F.col("place").bitwiseAND(255)).cast("int").alias("to_"),
    )
    kinds = contexts.groupBy("g").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = (
        contexts.join(kinds, "g")
        .select("g", (F.col("kinds") > HOT).alias("hot"), "k1", "k2", "place")
        .groupBy("k1", "k2")
        .agg(F.collect_list(F.struct("g", "hot", "place")).alias("wanted"))
    )
    # Of equal texts one is read: the one with the smallest id.
    one = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("doc_id"))
    asked = wanted.join(one, ["k1", "k2"])
    same_id = keyed["doc_id"].eqNullSafe(asked["doc_id"])
    same_text = (keyed["k1"] == asked["k1"]) & (keyed["k2"] == asked["k2"])
    cut = written(
        keyed.join(asked, same_text & same_id)
        .select(keyed["k1"], keyed["k2"], "wanted", "text")
        .mapInArrow(_contexts, "g long, hot boolean, k1 long, k2 long, first int, context binary"),
        "cut-contexts",
    )
    few, many = cut.agg(F.count_if(~F.col("hot")), F.count_if("hot")).first()
    buckets = max(16, math.ceil(few / BUCKET))
    sorted_ = (
        cut.where("not hot")
        .withColumn("b", F.pmod(F.xxhash64("g"), F.lit(buckets)))
        .groupBy("b")
        .applyInArrow(_sort_bucket, "k1 long, k2 long, from_ int, to_ int")
    )
    # One after the other, so that the shuffles of each are gone before the next.
    spans = written(whole, "whole-spans").unionByName(written(sorted_, "sorted-spans"))
    for k in range(TURNS if many else 0):
        own = cut.where(F.col("hot") & (F.pmod(F.xxhash64("g"), F.lit(TURNS)) == k))
        spans = spans.unionByName(written(_hashed_spans(own), "hashed-spans"))
    return spans


def _hashed_spans(hot: DataFrame) -> DataFrame:
    """Runs of repeated windows of each text among hot contexts, by hashes of all windows."""
    contexts = hot.select("k1", "k2", "first", "context")
    windows = contexts.mapInArrow(_window_hashes, "w1 long, w2 long, k1 long, k2 long, from_ int")
    # Windows start at several places if any of the three numbers of a place differs; numbers need no sort.
    places = ("k1", "k2", "from_")
    ends = [f(name).alias(f"{f.__name__}_{name}") for name in places for f in (F.min, F.max)]
    several = " or ".join(f"min_{name} != max_{name}" for name in places)
    repeats = windows.groupBy("w1", "w2").agg(*ends).where(several)
    found = windows.join(repeats.select("w1", "w2"), ["w1", "w2"], "left_semi")
    listed = found.groupBy("k1", "k2").agg(F.collect_set("from_").alias("from_"))
    return listed.mapInArrow(_window_runs, "k1 long, k2 long, from_ int, to_ int")


def _window_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows of each text as the runs that they cover."""
    for batch in batches:
        owner, begin = _lists(batch.column("from_"))
        begin = begin.to_numpy()
        row, begin, end = merged(owner, begin, begin + SPAN)
        rows = pa.array(row)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("k1").take(rows),
                batch.column("k2").take(rows),
                pa.array(begin.astype(np.int32)),
                pa.array(end.astype(np.int32)),
            ],
            ["k1", "k2", "from_", "to_"],
        )


def merged(row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of overlapping or touching spans of each row: row, begin and end, in order."""
    order = np.lexsort((begin, row))
    row, begin, end = row[order], begin[order].astype(np.int64), end[order].astype(np.int64)
    if not len(row):
        return row, begin, end
    # Rows laid one behind the other, so that one running maximum serves all.
    room = int(end.max()) + 1
    farthest = np.maximum.accumulate(end + row * room) - row * room
    new = np.concatenate([[True], (row[1:] != row[:-1]) | (begin[1:] > farthest[:-1])])
    first = np.flatnonzero(new)
    return row[first], begin[first], farthest[np.append(first[1:], len(row)) - 1]


def _remove(keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, spans = _lists(batch.column("spans"))
            row, begin, end = merged(owner, spans.field("from_").to_numpy(), spans.field("to_").to_numpy())
            cuts = np.searchsorted(row, np.arange(len(batch) + 1)).tolist()
            begin, end = begin.tolist(), end.tolist()
            data, ends = _bytes(batch.column("text"))
            view, numbers, digests, texts = memoryview(data), [], [], []
            start = 0
            for k, stop in enumerate(ends.tolist()):
                at, kept = start, []
                for run in range(cuts[k], cuts[k + 1]):
                    kept.append(view[at : start + begin[run]])
                    at = start + end[run]
                kept.append(view[at:stop])
                rest = b"".join(kept) if len(kept) > 1 or keep_text else kept[0]
                numbers.append((stop - start, stop - start - len(rest), cuts[k + 1] - cuts[k]))
                digests.append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    texts.append(rest)
                start = stop
            n = np.array(numbers, dtype=np.int64).reshape(-1, 3)
            columns = [batch.column("doc_id"), *(pa.array(n[:, k]) for k in range(3)), pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(texts, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept bytes if asked for)."""
    spans = repeated_spans(docs.select("doc_id", "text"))
    listed = written(
        spans.groupBy("k1", "k2").agg(F.collect_set(F.struct("from_", "to_")).alias("spans")), "spans"
    )
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    return (
        _keyed(docs)
        .join(listed, ["k1", "k2"], "left")
        .select("doc_id", "text", "spans")
        .mapInArrow(_remove(keep_text), out + (", kept binary" if keep_text else ""))
    )
