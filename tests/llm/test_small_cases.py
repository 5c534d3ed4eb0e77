"""Operators of the training-data folder on small tables with odd rows, against brute force."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sonaria.llm import (
    embedding_dups,
    html_text,
    language_id,
    mixing,
    packing,
    passage_dedup,
    simhash,
    suffix_dedup,
    topk_search,
    toxicity,
)

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside or return.
        T.StructField("size", T.StringType()),
        T.StructField("d", T.StringType()),
        T.StructField("key", T.StringType()),
        T.StructField("fp", T.StringType()),
    ]
)


def words(seed: int, n: int) -> str:
    turn = np.random.default_rng(seed)
    return " ".join("".join(turn.choice(list("abcdefghij"), 5)) for _ in range(n))


def documents(spark, texts, ids=None, sources=None):
    ids = list(range(len(texts))) if ids is None else ids
    sources = ["s"] * len(texts) if sources is None else sources
    rows = [
        (i, t, "en", s, len(t or ""), "x", "x", "x", "x")
        for i, t, s in zip(ids, texts, sources, strict=True)
    ]
    return spark.createDataFrame(rows, DOCS)


PASSAGE = words(7, 60)
TEXTS = [
    None,
    "",
    " \t\n",
    words(1, 300),
    words(1, 300),
    words(2, 3000),
    "one",
    "two words",
    words(3, 120) + " " + PASSAGE + " " + words(4, 100),
    words(5, 90) + "\n" + PASSAGE + "\n" + words(6, 80),
    "ä" * 700,
    "Grüße <|endoftext|> İΣ a\x1cb",
]
EMPTY_CASES = [
    lambda d: packing.pack_documents(d, VOCABULARY),
    simhash.duplicate_components,
    suffix_dedup.remove_repeats,
    passage_dedup.find_passages,
    mixing.mix,
    language_id.identify,
]


@pytest.mark.parametrize("operator", EMPTY_CASES)
def test_empty_table(spark, operator):
    assert operator(documents(spark, [])).count() == 0


def test_packing_round_trip(spark):
    docs = documents(spark, [*TEXTS, TEXTS[3]], [*range(len(TEXTS)), 3])
    packed = packing.pack_documents(docs, VOCABULARY, keep_ids=True)
    rows = packed.toPandas()
    direct = Tokenizer.from_file(VOCABULARY)
    wanted = Counter()
    for i, text in [*enumerate(TEXTS), (3, TEXTS[3])]:
        ids = direct.encode(text or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 2048):
            own = np.array(ids[at : at + 2048], dtype="<u4").tobytes()
            wanted[(i, at // 2048, at, len(own) // 4, zlib.crc32(own))] += 1
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert Counter(rows[names].itertuples(index=False, name=None)) == wanted
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own["length"].sum() <= 2048
        assert (own["length"].cumsum() - own["length"] == own["offset"]).all()
    whole = packing.sequences(packed).toPandas()
    assert whole["ids"].map(len).sum() == rows["length"].sum()


def simple_best_fit(lengths, capacity):
    left = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in range(len(left)) if left[b] >= n]
        if fits:
            left[min(fits, key=lambda b: left[b])] -= n
        else:
            left.append(capacity - n)
    return len(left)


@pytest.mark.parametrize("seed", range(8))
def test_plan_uses_as_many_bins_as_best_fit(seed):
    turn = np.random.default_rng(seed)
    capacity = int(turn.integers(5, 60))
    lengths = turn.integers(1, capacity + 1, size=int(turn.integers(1, 300)))
    plan = packing.plan_packing(Counter(lengths.tolist()), capacity)
    filled = Counter()
    for length, first, end, base, per_bin, offset in plan:
        for rank in range(first, end):
            at = base + (rank - first) // per_bin
            assert filled[at] == offset + (rank - first) % per_bin * length
            filled[at] += length
    assert max(filled.values()) <= capacity and sum(filled.values()) == lengths.sum()
    assert len(filled) == simple_best_fit(lengths.tolist(), capacity)


def test_mixing_targets_and_budgets(spark):
    sizes = {"a": [10] * 40, "b": [3, 5, 7] * 30, None: [100, 1, 0], "c": [0, 0]}
    rows = [(s, n) for s, many in sizes.items() for n in many]
    docs = documents(spark, [words(i, n) for i, (_, n) in enumerate(rows)], sources=[s for s, _ in rows])
    got = mixing.mix(docs).toPandas()
    again = mixing.mix(docs).toPandas()
    order = ["doc_id", "taken"]
    assert got.sort_values(order)[order].equals(got.sort_values(order)[order])
    assert sorted(map(tuple, got[order].to_numpy())) == sorted(map(tuple, again[order].to_numpy()))
    total = got["size"].sum()
    limits = {s: 3 * sum(n) for s, n in sizes.items()}
    weight = {"a": 1, "b": 2, "c": 3, None: 1}
    level = total / 7
    for _ in range(5):
        fixed = {s for s in sizes if limits[s] < level * weight[s]}
        level = (total - sum(limits[s] for s in fixed)) / sum(w for s, w in weight.items() if s not in fixed)
    got["source"] = [rows[i][0] for i in got["doc_id"]]
    for source, own in got.groupby("source", dropna=False):
        source = None if pd.isna(source) else source
        target = min(limits[source], level * weight[source])
        assert own["target"].iloc[0] == pytest.approx(target)
        assert own["source_size"].iloc[0] == sum(sizes[source])
        assert abs(own["taken"].sum() - target) <= max(sizes[source]) / 2
    assert (got["taken"] <= 3 * got["size"]).all()


def test_mixed_documents_repeat_rows(spark):
    docs = documents(spark, [words(i, 10) for i in range(30)], sources=["a"] * 3 + ["b"] * 27)
    taken = {r["doc_id"]: r["taken"] // r["size"] for r in mixing.mix(docs).toLocalIterator()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema == docs.schema
    assert Counter(mixed.toPandas()["doc_id"]) == {d: n for d, n in taken.items() if n}


@pytest.mark.parametrize("seed", range(6))
def test_fit_counts_reaches_what_subset_sum_reaches(seed):
    turn = np.random.default_rng(seed)
    sizes = np.unique(turn.integers(1, 40, size=6))
    counts = turn.integers(1, 4, size=len(sizes))
    budget = int(turn.integers(1, (sizes * counts).sum()))
    take = mixing.fit_counts(sizes, counts, budget)
    assert (take <= counts).all() and (take >= 0).all()
    assert abs(budget - (sizes * take).sum()) <= sizes.max() / 2


def reachable(n, linked):
    """The smallest index that links reach from each index."""
    root = [-1] * n
    for start in range(n):
        front = [start] if root[start] < 0 else []
        while front:
            i = front.pop()
            if root[i] < 0:
                root[i] = start
                front += np.flatnonzero(linked[i]).tolist()
    return root


def test_simhash_fingerprints_and_components(spark):
    base = words(11, 400).split()
    near = [" ".join([*base[:k], "changed", *base[k + 1 :]]) for k in range(0, 400, 20)]
    texts = [*TEXTS, *near, "ONE", "Two  words"]
    ids = list(range(len(texts)))
    got = simhash.duplicate_components(documents(spark, texts, ids)).toPandas().sort_values("doc_id")
    prints = []
    for text in texts:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        found = re.findall(r"[^\x20\x09-\x0D]+", low)
        shingles = [" ".join(found[i : i + 3]) for i in range(max(1, len(found) - 2))] if found else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)))
    assert list(got["fingerprint"]) == [f"{p:016x}" for p in prints]
    linked = np.array([[(a ^ b).bit_count() <= 3 for b in prints] for a in prints])
    assert list(got["component_id"]) == reachable(len(prints), linked)


def test_simhash_covering_meets_every_link(spark):
    turn = np.random.default_rng(3)
    seeds = turn.integers(-(2**63), 2**63 - 1, size=40, dtype=np.int64)
    fps = set(seeds.tolist())
    for fp in seeds.tolist():
        for _ in range(40):
            for bit in turn.choice(64, size=3, replace=False):
                fp ^= (1 << int(bit)) if bit < 63 else -(1 << 63)
            fps.add(fp)
    fps = sorted(fps)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long")).toPandas()
    values = np.array(fps).view(np.uint64)
    linked = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    place = {f: i for i, f in enumerate(fps)}
    own = np.zeros_like(linked)
    for x, y in links.itertuples(index=False):
        own[place[x], place[y]] = own[place[y], place[x]] = True
    assert reachable(len(fps), own) == reachable(len(fps), linked)


def test_simhash_keeps_one_of_each_group(spark):
    texts = [words(1, 50), words(1, 50), words(2, 50), words(1, 50), None, ""]
    docs = documents(spark, texts, [5, 3, 9, 3, None, None])
    kept = simhash.one_of_each_group(docs).toPandas()
    assert sorted(kept["doc_id"].dropna()) == [3, 9] and kept["doc_id"].isna().sum() == 1


@pytest.mark.parametrize("seed", range(6))
def test_suffix_array(seed):
    turn = np.random.default_rng(seed)
    data = turn.integers(97, 97 + int(turn.integers(1, 4)), size=int(turn.integers(1, 120))).astype(np.uint8)
    text = data.tobytes()
    order = suffix_dedup.suffix_array(data, suffix_dedup.names(data, 232)[1])
    assert [text[i:] for i in order] == sorted(text[i:] for i in range(len(text)))


def removed_by_brute_force(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[s : s + 200] for d in data for s in range(len(d) - 199))
    for d in data:
        gone = np.zeros(len(d), dtype=bool)
        for s in range(len(d) - 199):
            if seen[d[s : s + 200]] > 1:
                gone[s : s + 200] = True
        kept = np.frombuffer(d, dtype=np.uint8)[~gone].tobytes()
        runs = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        yield len(d), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("hot", [256, 1])
def test_substrings(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    shared = [words(20, 40), words(21, 45)]
    texts = [*TEXTS, "a" * 450, shared[0] + "x", "y" + shared[0] + shared[1], shared[1] + shared[0], shared[0][5:]]
    got = suffix_dedup.remove_repeats(documents(spark, texts)).toPandas().sort_values("doc_id")
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert list(got[names].itertuples(index=False, name=None)) == list(removed_by_brute_force(texts))


@pytest.mark.parametrize("seed", range(4))
def test_compact_windows(seed):
    turn = np.random.default_rng(seed)
    order = turn.integers(0, 40, size=50).astype(np.uint64)
    wanted = set()
    for i in range(len(order)):
        for j in range(i + 6, len(order)):
            left = right = c = i + int(np.argmin(order[i : j + 1]))
            while left > 0 and order[left - 1] > order[c]:
                left -= 1
            while right < len(order) - 1 and order[right + 1] >= order[c]:
                right += 1
            wanted.add((left, c, right))
    assert set(zip(*(a.tolist() for a in passage_dedup.compact_windows(order, 7)), strict=True)) == wanted


@pytest.mark.parametrize("hot", [256, 1])
def test_passages(spark, monkeypatch, hot):
    monkeypatch.setattr(passage_dedup, "HOT", hot)
    monkeypatch.setattr(passage_dedup, "PART", 2 if hot == 1 else 512)
    edited = PASSAGE.split()
    edited[30] = "changed"
    near = words(30, 70) + " " + " ".join(edited) + " " + words(31, 70)
    short = " ".join(PASSAGE.split()[:30])
    texts = [*TEXTS, near, words(32, 60) + " " + short + " " + words(33, 60)]
    docs = documents(spark, texts)
    got = passage_dedup.find_passages(docs).toPandas().sort_values("doc_id").set_index("doc_id")
    assert list(got["component_id"]) == [0, 1, 2, 3, 3, 5, 6, 7, 8, 8, 10, 11, 8, 13]
    runs = {i: [(r["from_word"], r["to_word"]) for r in got.loc[i, "repeated"]] for i in (3, 4, 8, 9, 12)}
    assert runs == {3: [(0, 300)], 4: [(0, 300)], 8: [(120, 180)], 9: [(90, 150)], 12: [(70, 130)]}
    kept = passage_dedup.without_repeats(docs)
    assert kept.schema == docs.schema
    left = kept.toPandas().set_index("doc_id")["text"]
    assert 4 not in left.index and len(left) == len(texts) - 1
    assert left[8] == TEXTS[8] and left[13] == texts[13] and left[0] is None
    assert left[9].split() == (words(5, 90) + " " + words(6, 80)).split()
    assert left[12].split() == (words(30, 70) + " " + words(31, 70)).split()


VECTORS = T.StructType(
    [
        T.StructField("vec_id", T.LongType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("id", T.StringType()),
        T.StructField("n", T.StringType()),
    ]
)


def vectors(spark):
    turn = np.random.default_rng(5)
    rows = [turn.normal(size=16) for _ in range(60)]
    rows += [rows[i] + turn.normal(size=16) * s for i in range(20) for s in (0.05, 0.2, 0.3)]
    rows = [r.astype(np.float32).tolist() for r in rows]
    rows += [rows[0], rows[0], [2 * v for v in rows[1]], None, [0.0] * 16, [float("nan")] * 16]
    rows += [[None] * 16, [float("inf")] + [0.0] * 15, [], [1.0, 2.0], [1e-30] * 16, [1e30] * 16]
    return rows, spark.createDataFrame([(i, r, "x", "x") for i, r in enumerate(rows)], VECTORS)


def test_embedding_links(spark):
    rows, table = vectors(spark)
    got = embedding_dups.link_vectors(table).toPandas().sort_values("vec_id")
    unit = []
    for row in rows:
        x = np.array([np.nan if v is None else v for v in row or []], dtype=float)
        good = len(x) and np.isfinite(x).all() and x.any()
        unit.append(x / np.linalg.norm(x) if good else None)
    n = len(rows)
    linked = np.zeros((n, n), dtype=bool)
    for i in range(n):
        for j in range(n):
            if i != j and unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]):
                linked[i, j] = unit[i] @ unit[j] >= 0.95
    assert list(got["n_links"]) == linked.sum(axis=1).tolist()
    assert list(got["component_id"]) == reachable(n, linked)
    assert list(got["kept"]) == [i == r for i, r in enumerate(reachable(n, linked))]
    assert embedding_dups.link_vectors(table.limit(0)).count() == 0


def test_top_k(spark):
    rows, table = vectors(spark)
    table = table.where("embedding is null or size(embedding) = 0 or coalesce(embedding[0], 0) < 1e20")
    got = topk_search.top_k(table, table["vec_id"] % 5 == 0).toPandas()
    usable = {}
    for i, row in enumerate(rows):
        if row and all(v is not None and np.isfinite(v) and v < 1e20 for v in row):
            usable[i] = np.floor(256 * np.array(row, dtype=float)).astype(int)
    wanted = []
    for q, x in usable.items():
        if q % 5 == 0:
            scores = sorted((-int(x @ y), c) for c, y in usable.items() if c != q and len(x) == len(y))
            wanted += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:5])]
    names = ["query_id", "rank", "vec_id", "score"]
    assert sorted(got[names].itertuples(index=False, name=None)) == sorted(wanted)
    assert topk_search.top_k(table.limit(0), table["vec_id"] % 5 == 0).count() == 0


def test_segment_bound_never_below_product():
    turn = np.random.default_rng(1)
    x, y = turn.normal(size=(50, 37)), turn.normal(size=(60, 37))
    for segments in (1, 4, 16, 37):
        bound = topk_search.segment_statistics(x, segments) @ topk_search.segment_statistics(y, segments).T
        assert (bound >= x @ y.T - 1e-9).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="with-sidebar">
<div id="cookie-banner"><p>We use cookies on this site to make it better for all of you.</p></div>
<header><h1>Site</h1></header><nav><a href="/">Home</a></nav><!-- <p>no</p> -->
<script>var a = "<p>no</p>";</script>
<article><h1>Caf&eacute;  &amp; bar</h1><p>First <b>bold</b>
line.<br>Next<p>Open &lt;tag&gt;<aside>An aside that is not part of it at all, really.</aside>
<div class="ad">Buy now and save a lot of money today.</div><ul><li>One<li>Two</ul></article>
<section id="comments"><article class="comment"><p>Nice text, I liked it very much indeed!</p></article></section>
<form><label>Mail</label><button>Send</button></form><footer>&copy; 2020</footer></body></html>"""


def test_page_text(spark):
    rows = [(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "<article><p>Only this", "x")]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extract_pages(table).toPandas().sort_values("page_id")
    wanted = ["Café & bar First bold line. Next Open <tag> One Two", "", "", "Only this"]
    assert list(got["text"]) == wanted and list(got["n_chars"]) == [len(t) for t in wanted]
    assert html_text.extract_pages(table.limit(0)).count() == 0


def test_tree_fits_its_labelled_blocks():
    x, y = html_text.labelled_blocks()
    assert ((html_text.classify(html_text.trained_tree(), x) >= 0.5) == y).mean() > 0.95


def test_codewords_are_apart():
    for n in (2, 3, 5, 7, 12, 60):
        code = language_id.codewords(n)
        apart = (code.shape[1] - code @ code.T) / 2
        assert apart[~np.eye(n, dtype=bool)].min() >= (1 if n < 4 else code.shape[1] / 5)
        assert len({tuple(c) for c in code.T}) == code.shape[1] or n > 7


def test_language_of_odd_texts(spark):
    texts = [words(i, 40) if i % 2 else words(i, 40).upper().replace("A", "Ö") for i in range(60)]
    rows = [(i, t, "aa" if i % 2 else "öö", "x") for i, t in enumerate(texts)]
    rows += [(100, None, "aa", "x"), (101, "", "aa", "x"), (102, "12 ...", None, "x"), (103, words(9, 9), None, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    got = language_id.identify(table).toPandas().set_index("doc_id")
    assert list(got.loc[[100, 101, 102], "lang_pred"]) == ["und"] * 3
    assert got.loc[103, "lang_pred"] == "aa" and got["score"].between(0, 1).all()
    own = [zlib.crc32(str(i).encode()) % 4 == 2 for i in got.index]
    assert list(got["held_out"]) == own
    assert all(got.loc[i, "lang_pred"] == ("aa" if i % 2 else "öö") for i in range(60))


def test_toxicity_learns_a_word_and_its_pair(spark):
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, words(i, 30) + (" vile thing " if bad else " ") + words(i + 1000, 30), "x"))
        labels.append((i, 1, int(bad)))
    rows += [(900, None, "x"), (901, "", "x"), (None, "vile thing", "x"), (5, rows[5][1], "x")]
    labels += [(5, 1, 0), (None, 1, 1), (7, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, predicted string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(table, marks).toPandas()
    assert len(got) == len(rows) and got["score"].between(0, 1).all()
    known = got[got["doc_id"] < 400]
    assert (known["predicted"] == (known["doc_id"] % 4 == 0)).all()
    assert toxicity.clean(table, marks).count() == len(rows) - 101
    assert toxicity.score_documents(table.limit(0), marks).count() == 0
    assert set(toxicity.score_documents(table, marks.limit(0)).toPandas()["predicted"]) == {0}


def stretches_by_brute_force(a: list, b: list, bounds=lambda i, j, centre: True, centres=(0, 0)):
    """(first, last of a, of b) of all similar stretches of two rows of shingles that begin and end with common ones."""
    common = sorted(set(a) & set(b))
    sides = []
    for own, centre in zip((a, b), centres, strict=True):
        ends = [i for i, v in enumerate(own) if v in common]
        spans = [(i, j) for i in ends for j in ends if j - i + 1 >= 46 and bounds(i, j, centre)]
        sets = [set(own[i : j + 1]) for i, j in spans]
        has = np.array([[v in s for v in common] for s in sets], dtype=np.float32).reshape(len(sets), len(common))
        sides.append((spans, np.array([len(s) for s in sets], dtype=int), has))
    (x, n, p), (y, m, q) = sides
    both = p @ q.T
    good = both >= 0.8 * (n[:, None] + m - both) - 1e-9
    return [(*x[i], *y[j]) for i, j in zip(*np.nonzero(good), strict=True)] if len(x) and len(y) else []


def edited_row(turn, row: list, edits: int) -> list:
    row = list(row)
    for _ in range(edits):
        at, n = int(turn.integers(0, len(row))), int(turn.integers(1, 9))
        what = turn.integers(0, 3)
        new = turn.integers(1000, 9000, size=n).tolist()
        row[at : at + (0 if what == 0 else n)] = [] if what == 2 else new
    return row


@pytest.mark.parametrize("seed", range(40))
def test_longest_pair(seed):
    turn = np.random.default_rng(seed)
    # Rows with few different shingles repeat themselves.
    base = turn.integers(0, 30 if seed % 4 == 0 else 900, size=70).tolist()
    a, b = ([*edited_row(turn, base[:35], seed % 4)[:45], 5000, *edited_row(turn, base[35:], seed % 3)[:45]] for _ in "ab")
    centres = a.index(5000), b.index(5000)
    wanted = stretches_by_brute_force(a, b, lambda i, j, c: i <= c <= j, centres)
    rows = [np.array(v, dtype=np.uint32) for v in (a, b)]
    got = passage_dedup.longest_pair(rows[0], centres[0], rows[1], centres[1])
    size = lambda s: s[1] - s[0] + s[3] - s[2]
    assert (got is None) == (not wanted)
    assert got is None or (got in wanted and size(got) == max(map(size, wanted)))
    # In a group of any size a pair is found or not found alike.
    for n in (0, 20):
        others = [np.arange(20_000 + 100 * k, 20_050 + 100 * k, dtype=np.uint32) for k in range(n)]
        found = passage_dedup.similar_pairs([*rows, *others], [*centres, *[25] * n], np.zeros(n + 2, dtype=np.int32))
        assert [tuple(f) for f in found.tolist()] == ([(0, 1, *got)] if got else [])


def test_every_pair_of_kinds_is_linked():
    turn = np.random.default_rng(1)
    base = turn.integers(1000, 9000, size=46).astype(np.uint32)
    first, last = base.copy(), base.copy()
    first[5:10], last[35:40] = np.arange(5), np.arange(10, 15)
    # The first is near the second, and so is the third; they are not near each other.
    chain = [first, base, last]
    for parts in ([0, 0, 0], [0, 1, 0]):
        found = passage_dedup.similar_pairs(chain, [20] * 3, np.array(parts))
        assert sorted(map(tuple, found[:, :2].tolist())) == [(0, 1), (1, 2)]


def test_one_changed_word_leaves_a_candidate():
    for seed in range(400):
        row = words(seed, 50).split()
        edited = ["new" if i == 4 + seed % 42 else w for i, w in enumerate(row)]
        texts = [" ".join([words(1000 + 9 * seed + k, 60), *v, words(5000 + 9 * seed + k, 60)]).encode() for k, v in enumerate((row, edited))]
        of, key, *_ = passage_dedup.windows_of(texts)
        assert set(key[of == 0]) & set(key[of == 1])


def test_simhash_keeps_texts_that_share_an_id(spark):
    texts = [words(800, 80), words(801, 80), words(802, 80), words(802, 80), words(800, 80), words(803, 80)]
    docs = documents(spark, texts, ids=[0, 1, 1, 1, 1, 2])
    kept = simhash.one_of_each_group(docs).toPandas()
    rows = sorted(kept[["doc_id", "text"]].itertuples(index=False, name=None))
    assert rows == sorted([(0, texts[0]), (1, texts[1]), (1, texts[2]), (2, texts[5])])


def shingled(text: str) -> list:
    own = text.lower().split()
    return [tuple(own[i : i + 5]) for i in range(len(own) - 4)]


def near_texts() -> list[str]:
    """Chains of edited copies, single edits of short passages, inserted sentences, two passages near each other."""
    def put(row, seed):
        return " ".join([words(1000 + seed, 60), *row, words(2000 + seed, 60)])

    def changed(row, *places):
        return [f"new{i}" if i in places else w for i, w in enumerate(row)]

    texts = []
    for k in range(4):
        row = words(300 + k, 50).split()
        # The copy with the smallest id is near the second text, and so is the third; they are not near each other.
        texts += [put(v, len(texts) + i) for i, v in enumerate((changed(row, 10 + k), row, changed(row, 40 - k)))]
        row = words(400 + k, 66).split()
        texts += [put(v, len(texts) + i) for i, v in enumerate((changed(row, 20), row, changed(row, 45)))]
        row = words(500 + k, 50).split()
        texts += [put(v, len(texts) + i) for i, v in enumerate((row, changed(row, 8 + 9 * k)))]
        row, gap = words(600 + k, 64).split(), words(700 + k, 10).split()
        texts += [put(v, len(texts) + i) for i, v in enumerate((row, [*row[:50], *gap, *row[50:]]))]
    return texts


@pytest.fixture(scope="module")
def near_by_brute_force():
    rows = [shingled(t) for t in near_texts()]
    held: dict = {}
    for i, row in enumerate(rows):
        for v in row:
            held.setdefault(v, set()).add(i)
    pairs = sorted({(a, b) for s in held.values() for a in s for b in s if a < b})
    return {(a, b): found for a, b in pairs if (found := stretches_by_brute_force(rows[a], rows[b]))}


@pytest.mark.parametrize(("hot", "part"), [(256, 512), (1, 2)])
def test_near_passages_against_brute_force(spark, monkeypatch, near_by_brute_force, hot, part):
    monkeypatch.setattr(passage_dedup, "HOT", hot)
    monkeypatch.setattr(passage_dedup, "PART", part)
    texts = near_texts()
    docs = documents(spark, texts)
    _, links = passage_dedup.passages(docs.select("doc_id", "text"))
    links = {tuple(sorted((r["a"]["d"], r["b"]["d"]))) for r in links.collect()}
    assert links == set(near_by_brute_force)
    got = passage_dedup.find_passages(docs).toPandas().set_index("doc_id")
    counts = [sum(i in pair for pair in links) for i in range(len(texts))]
    assert list(got.loc[range(len(texts)), "n_links"]) == counts
    repeated, removed = ([set() for _ in texts] for _ in "ab")
    for (a, b), found in near_by_brute_force.items():
        for i, j, k, m in found:
            repeated[a].update(range(i, j + 5))
            repeated[b].update(range(k, m + 5))
            removed[b].update(range(k, m + 5))
    for i in range(len(texts)):
        for name, wanted in (("repeated", repeated[i]), ("removed", removed[i])):
            assert {w for r in got.loc[i, name] for w in range(r["from_word"], r["to_word"])} == wanted, (i, name)
