from __future__ import annotations

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaria.functions import vectors
from sonaria.operators import matching
from sonaria.sources import registry as registry_source

PROBE = "probe_id string, embedding array<float>"
REGISTRY = "user_id string, ref_path string, embedding array<float>"


@pytest.fixture()
def axes(spark):
    rows = [("a", "a.npy", [1.0, 0.0, 0.0]), ("b", "b.npy", [0.0, 2.0, 0.0]), ("c", "c.npy", [0.0, 0.0, 3.0])]
    return spark.createDataFrame(rows, REGISTRY)


def _one(spark, vector, registry, top_k=3, **options):
    probe = spark.createDataFrame([("p", vector)], PROBE)
    return matching.top_matches(probe, registry, top_k, **options)


@pytest.mark.parametrize("options", [{}, {"block_rows": 1, "probe_rows": 1}])
def test_best_first_and_scores_in_range(spark, axes, options):
    matches = _one(spark, [0.0, 1.0, 0.0], axes, **options).first().matches
    assert [m.user_id for m in matches] == ["b", "a", "c"]
    assert matches[0].score == pytest.approx(1.0) and matches[1].score == pytest.approx(0.5)
    assert matches[0].ref_path == "b.npy"


def test_threshold_and_kept_best(spark, axes):
    v = [0.0, 0.5**0.5, 0.5**0.5]
    matched = _one(spark, v, axes, 1)
    strict = matching.decide(matched, 0.9, keep_best=True).first()
    assert not strict.decision and strict.best.score == pytest.approx(0.8536, abs=1e-4)
    assert matching.decide(matched, 0.9).first().best is None
    assert matching.decide(matched, 0.8).first().decision


@pytest.mark.parametrize("options", [{}, {"block_rows": 2}])
def test_empty_results_keep_the_probe(spark, axes, options):
    null_probe = matching.decide(_one(spark, None, axes, **options)).first()
    assert null_probe.matches == [] and not null_probe.decision and null_probe.best is None
    empty = matching.decide(_one(spark, [1.0, 0.0, 0.0], axes.limit(0), **options)).first()
    assert empty.matches == [] and not empty.decision


def test_broken_registry_vectors_match_nothing(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("a", "a", [1.0, 0.0]), ("b", "b", [nan, 0.0]), ("c", "c", [nan, nan]), ("d", "d", [inf, 1.0])]
    rows += [("e", "e", None), ("f", "f", [None, 1.0])]
    registry = spark.createDataFrame(rows, "user_id string, ref_path string, embedding array<double>")
    probe = spark.createDataFrame([("p", [1.0, 0.0])], "probe_id string, embedding array<double>")
    matches = matching.top_matches(probe, registry, 2).first().matches
    assert [m.user_id for m in matches] == ["a"]


def test_zero_vector_scores_one_half(spark, axes):
    scores = [m.score for m in _one(spark, [0.0, 0.0, 0.0], axes).first().matches]
    assert scores == [0.5, 0.5, 0.5]


def test_top_k_is_at_least_one_and_at_most_the_registry(spark, axes):
    assert len(_one(spark, [1.0, 0.0, 0.0], axes, 0).first().matches) == 1
    assert len(_one(spark, [1.0, 0.0, 0.0], axes, 50).first().matches) == 3


def test_dimension_mismatch_fails(spark, axes):
    with pytest.raises(Exception, match="dimension"):
        _one(spark, [1.0, 0.0], axes).collect()


def test_both_paths_agree_with_brute_force(spark):
    rng = np.random.default_rng(1)
    registry = rng.normal(size=(150, 8)).astype(np.float32)
    registry[75:] = registry[:75]
    probes = rng.normal(size=(60, 8)).astype(np.float32)
    reg_df = spark.createDataFrame(
        [(f"u{i:03d}", f"{i}", [float(x) for x in v]) for i, v in enumerate(registry)], REGISTRY
    )
    probe_df = spark.createDataFrame([(f"p{i}", [float(x) for x in v]) for i, v in enumerate(probes)], PROBE)
    unit = lambda m: m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    scores = np.round(unit(probes) @ unit(registry).T, 12)
    want = {f"p{i}": [f"u{j:03d}" for j in np.lexsort((np.arange(150), -scores[i]))[:7]] for i in range(60)}
    for options in ({}, {"block_rows": 16, "probe_rows": 20}):
        got = matching.top_matches(probe_df, reg_df, 7, **options).collect()
        assert {r.probe_id: [m.user_id for m in r.matches] for r in got} == want


def test_pairs_use_the_raw_cosine(spark):
    probes = spark.createDataFrame([("x", [1.0, 0.0])], "k string, embedding array<float>")
    refs = spark.createDataFrame([("x", [0.5, 0.8660254])], "k string, embedding array<float>")
    row = matching.verify_pairs(probes, refs, "k").first()
    assert row.cosine == pytest.approx(0.5) and not row.decision


def test_first_existing_reference(spark):
    candidates = spark.createDataFrame(
        [(1, 0, "x"), (1, 1, "b"), (1, 2, "a"), (2, 0, "x")], "request long, rank int, path string"
    )
    existing = spark.createDataFrame([("a",), ("b",), ("b",)], "path string")
    got = {r.request: r.ref_path for r in matching.first_existing(candidates, existing, "request").collect()}
    assert got == {1: "b", 2: None}


def _npy(folder, name, array):
    buffer = io.BytesIO()
    np.save(buffer, array)
    (folder / name).write_bytes(buffer.getvalue())


def test_vector_folder(spark, tmp_path):
    _npy(tmp_path, "b.npy", np.array([0.0, 2.0], dtype=np.float32))
    _npy(tmp_path, "a.npy", np.array([[3.0, 4.0]], dtype=np.float32))
    _npy(tmp_path, "z.npy", np.zeros(2, dtype=np.float32))
    (tmp_path / "bad.npy").write_bytes(b"nothing")
    (tmp_path / "note.txt").write_text("x")
    found = registry_source.read_vector_files(spark, str(tmp_path))
    good = {r.user_id: [round(x, 4) for x in r.embedding] for r in registry_source.usable(found).collect()}
    assert good == {"a": [0.6, 0.8], "b": [0.0, 1.0], "z": [0.0, 0.0]}
    assert [r.user_id for r in registry_source.rejects(found).collect()] == ["bad"]
    registry_source.require_one_dimension(registry_source.usable(found))
    _npy(tmp_path, "c.npy", np.zeros(3, dtype=np.float32))
    with pytest.raises(ValueError, match="dimension"):
        registry_source.require_one_dimension(registry_source.usable(registry_source.read_vector_files(spark, str(tmp_path))))


def test_registry_versions(spark, tmp_path):
    root = str(tmp_path / "registry")
    assert registry_source.read_latest(spark, root).count() == 0
    schema = registry_source.REGISTRY_SCHEMA
    first = spark.createDataFrame([("a", "a", [1.0], 1), ("b", "b", [1.0], 1)], schema)
    assert registry_source.write_version(first, root) == 0
    newer = spark.createDataFrame([("a", "a2", [2.0], 2)], schema)
    merged = matching.upsert(registry_source.read_latest(spark, root), newer, ["enrolled_at"])
    assert registry_source.write_version(merged, root) == 1
    got = {r.user_id: r.ref_path for r in registry_source.read_latest(spark, root).collect()}
    assert got == {"a": "a2", "b": "b"}
    ids = [(r.user_id, r.registry_size) for r in matching.listing(registry_source.read_latest(spark, root)).collect()]
    assert ids == [("a", 2), ("b", 2)]


def test_signal_validity(spark):
    rows = [(0, [0.0, 1e-9]), (1, [0.1, float("nan")]), (2, [0.1, float("inf")]), (3, [0.0, 0.1]), (4, []), (5, None)]
    df = spark.createDataFrame(rows, "i int, x array<double>")
    got = {r.i: r.ok for r in df.select("i", vectors.is_usable_signal(F.col("x")).alias("ok")).collect()}
    assert got == {0: False, 1: False, 2: False, 3: True, 4: False, 5: False}


def test_small_blocks_do_not_copy_with_the_square_of_the_rows():
    assert matching._blocks(2_000, 64, matching.BLOCK_ROWS) == matching.GRID
    assert matching._blocks(100, 64, matching.BLOCK_ROWS) == 2
    assert matching._blocks(0, 64, matching.BLOCK_ROWS) == 1
    assert matching._blocks(100_000, 64, matching.BLOCK_ROWS) == matching.GRID
    assert matching._blocks(matching.BLOCK_ROWS * 40, 64, matching.BLOCK_ROWS) == 40


@pytest.mark.parametrize("width", [5, 700, 3000])
@pytest.mark.parametrize("k", [1, 3, 600])
def test_best_equals_a_full_sort(width, k):
    """Repeated scores and scores that differ beyond the counted decimals only, too."""
    rng = np.random.default_rng(width + k)
    cosines = np.round(rng.uniform(-1, 1, (7, width)), 2) + rng.choice([0, 3e-13, -3e-13], (7, width))
    rows, cols = matching._best(cosines, k)
    ranked = np.round(cosines, matching.TIE_DECIMALS)
    want = [np.lexsort((np.arange(width), -r))[:k] for r in ranked]
    assert (cols == np.concatenate(want)).all() and (rows == np.repeat(np.arange(7), min(k, width))).all()
