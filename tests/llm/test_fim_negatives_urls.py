"""Fill-in-middle, hard negatives and url filter on odd rows, against brute force and their statements."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sonaria.llm import fill_in_middle, hard_negatives, statements, url_filter

SPACE = " \t\n\x0b\x0c\r"
UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")

DOCS = "doc_id long, text string, n string, form string, h1 string, output string"
VECTORS = "vec_id long, embedding array<float>, label int, d string, i string, h string, score string, v string"
PAGES = "page_id long, url string, html string, host string, path string, rule string, alias string, suffix string"


# ------------------------------------------------------------------ fill in the middle


def drawn(doc_id, seed=42):
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def plain_transform(doc_id, text, rate=50):
    text = text or ""
    units = UNIT.findall(text)
    h1, h2, h3, h4 = drawn(doc_id)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, len(units), "plain", None, None, text
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts():
    turn = np.random.default_rng(5)
    parts = ["a", "é", "\x00", "\x85", " ", "𝔸b", "<", "S>", "<P", ">", *SPACE, "word", "\x7f", "ÿ"]
    made = ["".join(turn.choice(parts, turn.integers(0, 40))) for _ in range(300)]
    return [None, "", " ", "\t\n ", "one", " one", "one ", "<P>", "a <S> b", "x<M>", "\xff \xfe", *made, "w " * 30_000]


@pytest.mark.parametrize("slice_bytes", [64, 8 << 20])
def test_fill_in_middle_is_the_plain_transform(spark, slice_bytes):
    texts = odd_texts()
    rows = [(i, t, "x", "x", "x", "x") for i, t in enumerate(texts)]
    rows += [(None, "no id at all", "x", "x", "x", "x"), rows[30], rows[30]]
    made = fill_in_middle.fill_in_middle(
        spark.createDataFrame(rows, DOCS), rate=90, slice_bytes=slice_bytes
    )
    made = made.withColumn("back", fill_in_middle.restored(F.col("form"), F.col("output"))).collect()
    assert Counter(tuple(r)[:6] for r in made) == Counter(plain_transform(r[0], r[1], 90) for r in rows)
    source = {r[0]: r[1] or "" for r in rows}
    assert all(r["back"] == source[r["doc_id"]] for r in made)
    assert {r["form"] for r in made} == {"plain", "spm", "psm"}


def test_fill_in_middle_of_nothing(spark):
    assert fill_in_middle.fill_in_middle(spark.createDataFrame([], DOCS)).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from([*SPACE, "a", "é", "𝔸", "\x00", "<"]), max_size=12), max_size=8))
def test_units_are_the_matches_of_the_pattern(texts):
    flat_texts = pa.array([t.encode() for t in texts], pa.large_binary())
    offsets, flat = fill_in_middle.units(flat_texts)
    found = [u.decode() for u in flat.to_pylist()]
    assert [found[a:b] for a, b in zip(offsets, offsets[1:])] == [UNIT.findall(t) for t in texts]


# ------------------------------------------------------------------ hard negatives


def mined(vectors, positives=5, negatives=10, is_anchor=lambda i: i % 10 == 0):
    """Every result row by brute force, as a multiset."""
    rows = [
        (i, tuple(math.floor(256 * float(np.float32(x))) for x in v), label)
        for i, v, label, *_ in vectors
        if i is not None and label is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = Counter()
    for i, v, label in {r for r in rows if is_anchor(r[0])}:
        scored = [
            (-sum(a * b for a, b in zip(v, w)), j, other)
            for j, w, other in rows
            if j != i and len(w) == len(v)
        ]
        same = sorted(s[:2] for s in scored if s[2] == label)[:positives]
        rest = sorted(s[:2] for s in scored if s[2] != label)
        for negative_p, j in same:
            held = [s for s in rest if 30 * -negative_p <= 100 * -s[0] <= 90 * -negative_p]
            for rank, (negative_n, n) in enumerate(held[:negatives], 1):
                out[(i, j, rank, n, -negative_p, -negative_n)] += 1
    return out


def odd_vectors(seed, n=400, dims=6, copies=120):
    turn = np.random.default_rng(seed)
    clutter = ("x",) * 5
    rows = [
        (int(i), [float(np.float32(x)) for x in turn.normal(0.4, 0.6, dims)], int(turn.integers(0, 4)), *clutter)
        for i in turn.permutation(n) - 20
    ]
    # A third of all rows are copies of one vector under other ids, and ids repeat.
    rows += [(1000 + i, rows[0][1], int(i % 4), *clutter) for i in range(copies)]
    rows += [rows[5], rows[5], (30, rows[9][1], 2, *clutter), (30, rows[8][1], 1, *clutter)]
    rows += [
        (None, rows[0][1], 1, *clutter),
        (2000, None, 1, *clutter),
        (2010, [0.1, None, 0.1, 0.1, 0.1, 0.1], 1, *clutter),
        (2020, [0.1, float("nan"), 0.1, 0.1, 0.1, 0.1], 1, *clutter),
        (2030, [0.1, float("inf"), 0.1, 0.1, 0.1, 0.1], 1, *clutter),
        (2040, rows[0][1], None, *clutter),
        (2050, [], 1, *clutter),
        (2060, [], 2, *clutter),
        (2070, [0.5, 0.5], 1, *clutter),
        (2071, [0.5, 0.25], 1, *clutter),
        (2072, [0.25, 0.25], 2, *clutter),
        (2080, [0.0] * dims, 3, *clutter),
    ]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_hard_negatives_are_those_of_brute_force(spark, monkeypatch, seed):
    # Small blocks and panels, so that anchors and rows meet in many cells.
    monkeypatch.setattr(hard_negatives, "ANCHOR_BLOCK", 8)
    monkeypatch.setattr(hard_negatives, "PANEL", 3)
    rows = odd_vectors(seed)
    wanted = mined(rows)
    found = hard_negatives.mine(spark.createDataFrame(rows, VECTORS).repartition(7), F.col("id") % 10 == 0)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(tuple(r) for r in found.select(names).collect()) == wanted
    assert len(wanted) > 1000


def test_hard_negatives_match_their_statement_with_ties(spark):
    turn = np.random.default_rng(9)
    rows = [
        (int(i), [float(x) / 4 for x in turn.integers(-3, 4, 3)], int(turn.integers(0, 10)), *("x",) * 5)
        for i in range(1200)
    ]
    frame = spark.createDataFrame(rows, VECTORS)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = hard_negatives.mine(frame.withColumn("label", label), F.col("id") % 100 == 0).drop("anchor_row")
    con = duckdb.connect()
    con.register("embeddings", frame.select("vec_id", "embedding", "label").toPandas())
    wanted = con.execute(statements.HARD_NEGATIVES)
    names = [d[0] for d in wanted.description]
    assert Counter(tuple(r) for r in found.select(names).collect()) == Counter(wanted.fetchall())


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("id") % 10 == 0).count() == 0


def test_stream_remembers_windows_only():
    """Negatives of any number pass without being kept; a full window takes no more."""
    keys = [(0, 1, -100, 0, 7), *((0, 1, -50, 1, i) for i in range(50_000)), (100, 1, -100, 1, 3)]
    found = list(hard_negatives.hard_negative_stream(iter(keys), 5, 10, 30, 90))
    assert found == [(0, 1, 7, i + 1, i, 100, 50) for i in range(10)]
    zero = [(0, 1, 0, 0, 9), (0, 1, 0, 1, 2)]
    assert list(hard_negatives.hard_negative_stream(iter(zero), 5, 10, 30, 90)) == [(0, 1, 9, 1, 2, 0, 0)]


# ------------------------------------------------------------------ url filter


def page(i, url, html=""):
    return (i, url, html, *("x",) * 5)


def canonical(target):
    return f'<head><LINK href="{target}" rel="Canonical"></head>'


URLS = [
    page(0, None, canonical("http://a.com/de/")),
    page(1, "", ""),
    page(2, "no scheme a.com/de/1"),
    page(3, "http://A.Example.ORG/es/1?x=1#y"),
    page(4, "http://example.org/en/1"),
    page(5, "http://example.org/en/21"),
    page(6, "http://notexample.org/es/1"),
    page(7, "https://x.com/fr/2"),
    page(8, "https://x.com/de/2"),
    page(9, "https://x.com/FR/2"),
    page(10, "https://x.com"),
    page(11, "https://com/de/"),
    page(12, "https://x.com:80/de/"),
    page(13, "ftp://a.net/1?u=http://b.com/de/"),
    # Aliases: 14 - 15 - blocked 16; 17 - blocked 18 and allowed 19.
    page(14, "http://a.net/a", canonical("/b?p=1")),
    page(15, "https://a.net/b?p=1#top", "<meta http-equiv=refresh content=\"0; URL='http://b.com/de/9'\">"),
    page(16, "http://b.com/de/9"),
    page(17, "http://c.net/x/y/z", canonical("//d.com/de/1") + "<link rel=canonical href='http://e.org/ok'>"),
    page(18, "http://d.com/de/1"),
    page(19, "http://e.org/ok"),
    page(20, "http://c.net/x/q/../y/z"),
    # Relative references with dots.
    page(21, "http://f.net/a/b/c", canonical("../d/./e")),
    page(22, "http://f.net/a/d/e", canonical("http://b.com/de/9")),
    page(23, "http://f.net/a/d/e?other=1"),
    page(24, "http://g.net/a/b", canonical("../../../up/..")),
    page(25, "http://g.net/", canonical("http://b.com/de/9")),
    page(26, "http://g.net", ""),
    # No edges: comment, script, other relations, a broken reference.
    page(27, "http://h.net/1", "<!-- " + canonical("http://b.com/de/9") + " -->"),
    page(28, "http://h.net/2", "<script>" + canonical("http://b.com/de/9") + "</script>"),
    page(29, "http://h.net/3", '<link rel="alternate" href="http://b.com/de/9"> canonical'),
    page(30, "http://h.net/4", canonical("mailto:someone")),
    page(31, "http://h.net/5", None),
    page(32, "http://h.net/6", canonical("http://b.com/de/9?a=1&amp;b=2")),
    page(33, "http://b.net/?a=1&b=2", canonical("http://b.com/de/9?a=1&b=2")),
    page(14, "http://a.net/a", ""),
    page(None, "http://a.net/a", ""),
]
VERDICTS = {
    0: "allow", 1: "allow", 2: "allow", 3: "block", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "block",
    9: "allow", 10: "allow", 11: "block", 12: "allow", 13: "allow", 14: "block", 15: "block", 16: "block",
    17: "allow", 18: "block", 19: "allow", 20: "allow", 21: "block", 22: "block", 23: "allow", 24: "block",
    25: "block", 26: "block", 27: "allow", 28: "allow", 29: "allow", 30: "allow", 31: "allow", 32: "block",
    33: "block", None: "block",
}


def rule_table(spark, rules=statements.RULES):
    return spark.createDataFrame(rules, url_filter.RULE_SCHEMA)


def test_url_verdicts(spark):
    rows = url_filter.judge(spark.createDataFrame(URLS, PAGES), rule_table(spark)).collect()
    assert len(rows) == len(URLS)
    assert {r["page_id"]: r["verdict"] for r in rows} == VERDICTS
    by_id = {r["page_id"]: r for r in rows}
    assert (by_id[3]["host"], by_id[3]["path"], by_id[3]["rule"]) == ("a.example.org", "/es/1", "example.org/es/")
    assert (by_id[0]["host"], by_id[0]["path"], by_id[0]["rule"]) == ("", "", None)
    assert by_id[19]["rule"] == "org/" and by_id[17]["rule"] is None and by_id[17]["via_alias"]


def test_url_statement_says_the_same(spark):
    frame = spark.createDataFrame(URLS, PAGES)
    found = url_filter.judge(frame, rule_table(spark))
    con = duckdb.connect()
    con.register("raw", pa.Table.from_pylist([{"page_id": r[0], "url": r[1], "html": r[2]} for r in URLS]))
    con.execute("CREATE TABLE pages AS SELECT * FROM raw")
    wanted = con.execute(statements.URL_FILTER)
    names = [d[0] for d in wanted.description]
    assert Counter(tuple(r) for r in found.select(names).collect()) == Counter(wanted.fetchall())


def brute_rule(host, path, rules):
    fits = [
        (len(h + p), len(h), h + p, v)
        for h, p, v in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p) and host
    ]
    return max(fits)[2:] if fits else (None, None)


def test_rules_by_join_are_those_of_a_scan(spark):
    """A rule host with many paths, urls that stand on a third of the pages, long chains of redirects."""
    turn = np.random.default_rng(3)
    labels = ["a", "b", "c", "example", "org", "com"]
    seen = {}
    for _ in range(60):
        host = ".".join(turn.choice(labels, turn.integers(1, 4)))
        path = "/" + "".join(turn.choice(list("ab/"), turn.integers(0, 4)))
        seen[(host, path)] = str(turn.choice(["allow", "block"]))
    rules = [(h, p, v) for (h, p), v in seen.items()]
    urls = [
        f"http://{'.'.join(turn.choice(labels, turn.integers(1, 5)))}/{''.join(turn.choice(list('ab/'), turn.integers(0, 6)))}"
        for _ in range(400)
    ]
    urls += ["http://hot.example/x"] * 300 + [f"http://chain{i}.net/" for i in range(40)]
    pages = spark.createDataFrame([page(i, u) for i, u in enumerate(urls)], PAGES)
    hops = [(f"http://chain{i}.net/", f"https://chain{i + 1}.net", ) for i in range(39)]
    blocked = next(f"http://{h}{p}" for h, p, v in rules if brute_rule(h, p, rules)[1] == "block")
    hops += [("http://chain39.net", blocked), (None, "http://chain0.net/"), ("http://chain0.net/", "nothing")]
    redirects = spark.createDataFrame(hops, "from_url string, to_url string")
    rows = url_filter.judge(pages, rule_table(spark, rules), redirects).collect()
    assert len(rows) == len(urls)
    chained = {f"chain{i}.net" for i in range(40)}
    for r in rows:
        rule, verdict = brute_rule(r["host"], r["path"], rules)
        expected = verdict or ("block" if r["host"] in chained else "allow")
        assert (r["rule"], r["verdict"]) == (rule, expected)


def test_url_filter_edges_of_its_inputs(spark):
    none = spark.createDataFrame([], PAGES)
    assert url_filter.judge(none, rule_table(spark)).count() == 0
    pages = spark.createDataFrame([page(1, "http://a.org/1"), page(2, None)], PAGES)
    odd = [("", "/", "block"), (None, "/", "block"), ("A.org", None, "block"), ("a.org", "", "allow")]
    rows = {r["page_id"]: r for r in url_filter.judge(pages, rule_table(spark, odd)).collect()}
    assert (rows[1]["rule"], rows[1]["verdict"], rows[2]["verdict"]) == ("a.org", "allow", "allow")
    assert url_filter.judge(pages, spark.createDataFrame([], url_filter.RULE_SCHEMA)).count() == 2
