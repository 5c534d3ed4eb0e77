"""Repeated rows, columns with the names operators use inside, and texts longer than the blocks worked on at once."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from sonaria.llm import language_id, mixing, passage_dedup, simhash, suffix_dedup, toxicity

CLASH = (
    "doc_id long, text string, lang string, source string, n_chars long, _fp string, _d string, _h string, "
    "_removed string, _draw string, n string, h string, row string, size string, _row string, _times string"
)


def words(seed: int, n: int) -> str:
    turn = np.random.default_rng(seed)
    return " ".join("".join(turn.choice(list("abcdefghij"), 5)) for _ in range(n))


def table(spark, rows, schema=CLASH):
    """Rows of (doc_id, text, source) with all other columns filled."""
    more = len(schema.split(",")) - 5
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *[f"x{k}" for k in range(more)]) for i, t, s in rows], schema)


PASSAGE = words(7, 60)


def test_stages_keep_columns_with_inner_names(spark):
    near = words(1, 300).replace(" ", "  ", 1)
    rows = [
        (0, words(1, 300), "a"),
        (1, near, "a"),
        (2, words(2, 90) + " " + PASSAGE + " " + words(3, 90), "b"),
        (3, words(4, 90) + " " + PASSAGE + " " + words(5, 90), "b"),
        (4, None, None),
    ]
    docs = table(spark, rows)
    one = simhash.one_of_each_group(docs)
    assert one.schema == docs.schema
    assert sorted(tuple(r) for r in one.collect()) == sorted(tuple(r) for r in docs.where("doc_id <> 1").collect())
    cut = passage_dedup.without_repeats(docs)
    assert cut.schema == docs.schema
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[2] == rows[2][1] and texts[3].split() == (words(4, 90) + " " + words(5, 90)).split()
    assert {r._removed for r in cut.collect()} == {"x3"}
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema == docs.schema and {r._times for r in mixed.collect()} == {"x10"}


def test_one_row_of_equal_ids_and_prints_is_kept_by_its_text(spark):
    """Two texts of one id and fingerprint: the same of them stays in every run."""
    upper, lower = "Same Words In Here", "same words in here"
    kept = set()
    for order in ([upper, lower], [lower, upper]):
        docs = table(spark, [(1, t, "a") for t in order] + [(2, lower, "a")])
        rows = simhash.one_of_each_group(docs.repartition(3)).collect()
        assert len(rows) == 1 and rows[0].doc_id == 1
        kept.add(rows[0].text)
    assert len(kept) == 1


def test_mix_takes_part_of_repeated_rows(spark):
    rows = [(1, words(1, 4), "a")] * 100 + [(2, words(2, 4), "a")] * 7 + [(100 + i, words(50 + i, 10), "b") for i in range(90)]
    rows += [(None, words(9, 3), "c")] * 40 + [(None, None, None)] * 3
    docs = table(spark, rows)
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows)
    assert (got["taken"] <= 3 * got["size"]).all()
    for (size, _), own in got[got["size"] > 0].groupby(["source_size", "target"]):
        assert abs(own["taken"].sum() - own["target"].iloc[0]) <= own["size"].max() / 2 + 0.5, size  # budgets are whole words
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert Counter(map(tuple, got.fillna(-1).to_numpy())) == Counter(map(tuple, again.fillna(-1).to_numpy()))
    mixed = Counter(r.text for r in mixing.mixed_documents(docs).collect())
    source = {t: len(t.split()) for _, t, _ in rows if t}
    for _, own in got[got["size"] > 0].groupby("target"):
        texts = {t for (i, t, s), d in zip(rows, [r[0] for r in rows]) if t and len(t.split()) in set(own["size"])}
        wanted = own["taken"].sum()
        assert wanted == sum(mixed[t] * source[t] for t in texts)


def test_prints_do_not_depend_on_blocks(monkeypatch):
    text = words(3, 700)
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    assert simhash.fingerprint(text) == whole


def test_features_do_not_depend_on_blocks(monkeypatch):
    text = words(4, 700)
    whole = toxicity.features(text)
    monkeypatch.setattr(toxicity, "BLOCK", 50)
    assert (toxicity.features(text) == whole).all()


@pytest.mark.parametrize("block", [600, 1000])
def test_removed_bytes_do_not_depend_on_blocks(spark, monkeypatch, block):
    shared = words(6, 200)
    rows = [(0, words(1, 400) + shared, "a"), (1, shared + words(2, 300), "a"), (2, words(3, 500), "a")]
    docs = table(spark, rows)
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    whole = sorted(tuple(r) for r in suffix_dedup.remove_repeats(docs).select(columns).collect())

    found = [a for a, _ in suffix_dedup.anchors(np.frombuffer(rows[0][1].encode(), np.uint8), np.array([len(rows[0][1])]))]
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    parts = [a for a, _ in suffix_dedup.anchors(np.frombuffer(rows[0][1].encode(), np.uint8), np.array([len(rows[0][1])]))]
    assert len(parts) > 1 and set(np.concatenate(parts)) == set(np.concatenate(found))
    assert whole[0][2] >= 1000 and whole[2][2] == 0


def test_passages_do_not_depend_on_slices(monkeypatch):
    texts = [words(i, 90).encode() + b" " + PASSAGE.encode() for i in range(6)]
    whole = passage_dedup.windows_of(texts)
    parts = []
    for i in range(0, 6, 2):
        found = passage_dedup.windows_of(texts[i : i + 2])
        parts.append([found[0] + i, *found[1:]])
    joined = [np.concatenate(c) for c in zip(*parts)]
    assert sorted(zip(*(c.tolist() for c in whole))) == sorted(zip(*(c.tolist() for c in joined)))


def test_language_of_repeated_rows_and_long_texts(spark):
    en, de = "the house of the people and the river ", "das haus der leute und der fluss ist "
    rows = [(i, (en if i % 2 else de) * (1 + i % 5), "a") for i in range(120)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(
        [(i, t, "en" if i % 2 else "de", s, len(t)) for i, t, s in [*rows, rows[7], rows[7], (500, en * 3000, "a")]], schema
    )
    got = language_id.identify(docs).collect()
    assert len(got) == 123
    assert {r.lang_pred for r in got if r.doc_id == 7} == {"en"} and [r.lang_pred for r in got if r.doc_id == 500] == ["en"]
