"""Small cases of the findings of round 4 on training-data operators."""

import glob
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_small_cases import documents, near_texts, words

from sonaria.llm import common, passage_dedup, suffix_dedup


@pytest.mark.parametrize("seed", range(8))
def test_similar_stretches_share_one_of_their_rarest_shingles(seed):
    """For any order of the common shingles, also of rows that hold shingles several times."""
    turn = np.random.default_rng(seed)
    top = (12, 60, 400, 9_000)[seed % 4]
    met = 0
    for _ in range(60):
        a = turn.integers(0, top, size=int(turn.integers(passage_dedup.LEAST, 92))).astype(np.uint32)
        b = a.copy()
        for at in turn.integers(0, len(b), size=int(turn.integers(0, 14))).tolist():
            b[at] = turn.integers(0, top)
        b = b[int(turn.integers(0, 8)) :] if len(b) > passage_dedup.LEAST + 8 else b
        common_ones = turn.permutation(top)[: int(turn.integers(0, 40))].tolist()
        rank = {v: i for i, v in enumerate(common_ones)}
        shared = len(set(a.tolist()) & set(b.tolist()))
        if shared >= max(passage_dedup.least_shared(a), passage_dedup.least_shared(b)):
            met += 1
            assert set(passage_dedup.rarest(a, rank)) & set(passage_dedup.rarest(b, rank))
    assert met


def repeated_words(n: int) -> list[str]:
    """Texts that repeat one common word and then a foreign one: their stretches have one signature, and hardly
    anything else in common."""
    return [" ".join([words(k, 20), *["the"] * 60, *[f"foreign{k}"] * 60]) for k in range(n)]


def test_many_kinds_of_a_signature_are_not_all_compared(spark, monkeypatch):
    """What was compared of a signature grew with the square of its kinds."""
    compared = []
    pairs = passage_dedup._matched

    def matched(cut, n, kind, removed_only):
        compared.append(n)
        return pairs(cut, n, kind, removed_only)

    monkeypatch.setattr(passage_dedup, "_matched", matched)
    monkeypatch.setattr(passage_dedup, "HOT", 20)
    monkeypatch.setattr(passage_dedup, "PART", 20)
    rows = []
    for n in (60, 120):
        compared.clear()
        spans, _ = passage_dedup.passages(documents(spark, repeated_words(n)), removed_only=True)
        assert spans.where("removed").count()
        rows.append(compared[-1])
    assert rows[1] < 2.5 * rows[0]


@pytest.mark.parametrize(("hot", "part"), [(4, 3)])
def test_passages_do_not_depend_on_groups_by_rare_shingles(spark, monkeypatch, hot, part):
    """Common words before foreign ones, a common passage in foreign surroundings, edited and chained copies."""
    passage = words(7, 60).split()
    texts = [*repeated_words(12), *near_texts()]
    for k in range(14):
        row = [f"new{k}" if k % 3 and i == 11 * k % 60 else w for i, w in enumerate(passage)]
        texts.append(" ".join([words(3000 + k, 40), *row, words(4000 + k, 40)]))
    docs = documents(spark, texts)
    found = []
    for most in (10**6, hot):
        monkeypatch.setattr(passage_dedup, "HOT", most)
        monkeypatch.setattr(passage_dedup, "PART", part)
        whole = sorted(map(str, passage_dedup.find_passages(docs).collect()))
        rest = sorted(map(str, passage_dedup.without_repeats(docs).collect()))
        found.append((whole, rest))
    assert found[0] == found[1]


def test_shuffles_go_when_a_table_is_written(spark):
    def files() -> set[str]:
        root = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
        return {f for d in root for f in glob.glob(f"{d}/*/shuffle_*.data")}

    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    kept, before = spark.conf.get(name, None), files()
    table = common.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    until = time.time() + 10
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert spark.conf.get(name, None) == kept
    assert table.count() == 7


def test_repeated_windows_of_hot_contexts_leave_as_runs_turn_by_turn(spark, monkeypatch):
    """All windows of all hot contexts were shuffled at once, and each repeated one was a span of its own."""
    turn = np.random.default_rng(1)
    shared, texts = words(1, 60), []
    for k in range(24):
        texts.append(f"{words(100 + k, 40)} {shared if k % 2 else shared[: 150 + 20 * k]} {words(300 + k, int(turn.integers(1, 40)))}")
    docs = documents(spark, texts)
    found, tables = [], {}

    def write(df, label):
        table = common.written(df, label)
        tables.setdefault(label, []).append(table.count())
        return table

    monkeypatch.setattr(suffix_dedup, "written", write)
    for hot, turns in ((10**6, 1), (1, 1), (1, 3)):
        monkeypatch.setattr(suffix_dedup, "HOT", hot)
        monkeypatch.setattr(suffix_dedup, "TURNS", turns)
        found.append(sorted(map(str, suffix_dedup.remove_repeats(docs).collect())))
        assert len(tables.pop("hashed-spans", [])) == (turns if hot == 1 else 0)
    assert found[0] == found[1] == found[2]
    assert sum("n_spans=0" not in row for row in found[0]) >= 12


def test_windows_become_runs():
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1, 2, 3]), pa.array([4, 5, 6]), pa.array([[7, 5, 6, 300, 205], [], [9]], pa.list_(pa.int32()))],
        ["k1", "k2", "from_"],
    )
    (got,) = suffix_dedup._window_runs(iter([batch]))
    assert [tuple(r.values()) for r in got.to_pylist()] == [(1, 4, 5, 500), (3, 6, 9, 209)]
