"""Small cases of the findings of round 3 on training-data operators."""

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from sonaria.llm import passage_dedup, suffix_dedup


def test_windows_of_many_contexts_come_together(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 2)
    contexts = [bytes(range(1, 211)), b"x" * 199, b"y" * 201, b"", b"z" * 200]
    n = len(contexts)
    batch = pa.RecordBatch.from_arrays(
        [pa.array(range(n)), pa.array(range(10, 10 + n)), pa.array([7, 0, 3, 0, 1], pa.int32()), pa.array(contexts, pa.binary())],
        ["k1", "k2", "first", "context"],
    )
    out = list(suffix_dedup._window_hashes(iter([batch.slice(1), batch])))
    assert [b.num_rows for b in out] == [2, 1, 11, 2, 1]
    got = [tuple(r.values()) for b in out[2:] for r in b.to_pylist()]
    wanted = []
    for k, (first, data) in enumerate(zip([7, 0, 3, 0, 1], contexts)):
        for s in range(len(data) - 199):
            pair = np.frombuffer(xxhash.xxh3_128_digest(data[s : s + 200]), dtype=np.int64).tolist()
            wanted.append((*pair, k, 10 + k, first + s))
    assert got == wanted


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_all_rows_at_once(seed):
    turn = np.random.default_rng(seed)
    row = turn.integers(0, 5, size=seed * 12)
    begin = turn.integers(0, 400, size=len(row)).astype(np.int32)
    end = (begin + turn.integers(1, 30, size=len(row))).astype(np.int32)
    wanted = []
    for k in range(5):
        covered = np.zeros(500, dtype=int)
        for b, e in zip(begin[row == k], end[row == k]):
            covered[b:e] = 1
        edge = np.diff(covered, prepend=0, append=0)
        runs = list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist()))
        wanted += [(k, b, e) for b, e in runs]
    got = list(zip(*(a.tolist() for a in suffix_dedup.merged(row, begin, end))))
    assert got == wanted


def longest_by_brute_force(a, i, b, j):
    """The longest pair of stretches by trying all of them, the first of equals."""
    best, common = None, set(a) & set(b)

    def stretches(row, c):
        at = [k for k, v in enumerate(row) if v in common]
        return [(f, t) for f in at if f <= c for t in at if t >= c and t - f + 1 >= passage_dedup.LEAST]

    for f, t in stretches(a, i):
        for g, u in stretches(b, j):
            x, y = set(a[f : t + 1]), set(b[g : u + 1])
            if 9 * len(x & y) >= 4 * (len(x) + len(y)) and (best is None or t - f + u - g > best[0]):
                best = t - f + u - g, (f, t, g, u)
    return best and best[1]


@pytest.mark.parametrize("seed", range(12))
def test_longest_pair(monkeypatch, seed):
    monkeypatch.setattr(passage_dedup, "LEAST", 8)
    monkeypatch.setattr(passage_dedup, "CHOICES", 5)
    turn = np.random.default_rng(seed)
    for _ in range(6):
        a = turn.integers(0, 400 if seed % 2 else 25, size=19).tolist()
        b = [int(turn.integers(0, 400)) if turn.random() < 0.2 else v for v in a]
        b[9] = a[9]
        if turn.random() < 0.5:
            b = [*b[:6], *turn.integers(0, 400, size=2).tolist(), *b[6:]]
        rows = [np.array(v, dtype=np.uint32) for v in (a, b)]
        centre = len(b) - 10
        assert passage_dedup.longest_pair(rows[0], 9, rows[1], centre) == longest_by_brute_force(a, 9, b, centre)


def test_passages_do_not_depend_on_rounds(spark, monkeypatch):
    turn = np.random.default_rng(3)

    def words(n):
        return [f"w{v}" for v in turn.integers(0, 10**6, size=n)]

    shared, texts = [words(70) for _ in range(4)], []
    for k in range(24):
        own = list(shared[k % 4])
        own[int(turn.integers(0, 70))] = f"new{k}"
        texts.append(" ".join([*words(30), *own, *words(20), *(shared[k % 3] if k % 5 == 0 else [])]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = []
    for rounds in (1, 3):
        monkeypatch.setattr(passage_dedup, "ROUNDS", rounds)
        whole = sorted(map(str, passage_dedup.find_passages(docs).collect()))
        rest = sorted(map(str, passage_dedup.without_repeats(docs).collect()))
        found.append((whole, rest))
    assert found[0] == found[1]
    assert sum("n_links=0" not in row for row in found[0][0]) == 24


@pytest.mark.parametrize("seed", range(12))
def test_longest_pair_of_edited_copies_needs_no_table_of_choices(monkeypatch, seed):
    """Rows whose common shingles come in the same order, with edits, insertions and foreign ends."""
    monkeypatch.setattr(passage_dedup, "LEAST", 8)
    monkeypatch.setattr(passage_dedup, "_choices", None)
    turn, met = np.random.default_rng(seed), 0
    for _ in range(12):
        a = turn.permutation(100_000)[:23].tolist()
        b = [int(turn.integers(200_000, 900_000)) if turn.random() < 0.15 else v for v in a]
        b[11] = a[11]
        right = turn.integers(1_000_000, 2_000_000, size=int(turn.integers(0, 4))).tolist()
        left = turn.integers(3_000_000, 4_000_000, size=int(turn.integers(0, 4))).tolist()
        at, to = int(turn.integers(1, 11)), int(turn.integers(12, 23))
        b = [*b[:at], *left, *b[at:to], *right, *b[to:]]
        rows = [np.array(v, dtype=np.uint32) for v in (a, b)]
        centre = 11 + len(left)
        found = passage_dedup.longest_pair(rows[0], 11, rows[1], centre)
        assert found == longest_by_brute_force(a, 11, b, centre)
        met += found is not None
    assert met


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_texts_are_joined_at_once(seed):
    """As one by one; spans in any order, some twice, texts without any between them and at the end."""
    turn = np.random.default_rng(seed)
    owner = turn.integers(0, 9, size=40) * 2
    begin = turn.integers(0, 60, size=40)
    end = begin + turn.integers(1, 9, size=40)
    got = passage_dedup.joined_rows(owner, begin, end, 20).to_pylist()
    for row in range(20):
        spans = [(int(b), int(e)) for o, b, e in zip(owner, begin, end, strict=True) if o == row]
        assert [(r["from_word"], r["to_word"]) for r in got[row]] == passage_dedup.joined(spans)
    none = np.zeros(0, dtype=np.int64)
    assert passage_dedup.joined_rows(none, none, none, 2).to_pylist() == [[], []]


def test_least_shared_counts_the_fewest_in_any_stretch():
    turn = np.random.default_rng(5)
    for top in (3, 20, 60, 500):
        row = turn.integers(0, top, size=int(turn.integers(passage_dedup.LEAST, 92))).astype(np.uint32)
        few = min(len(set(row[i : i + passage_dedup.LEAST].tolist())) for i in range(len(row) - passage_dedup.LEAST + 1))
        assert passage_dedup.least_shared(row) == -(-4 * few // 5)
