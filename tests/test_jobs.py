from __future__ import annotations

import hashlib
import io
import sys
import wave

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sonaria.functions import reference
from sonaria.operators import signal
from sonaria.plans import jobs as plans
from sonaria.slots import base, builtin, jobs
from sonaria.slots.base import Slot
from sonaria.sources import corpus, ledger
from sonaria.sources.registry import REGISTRY_SCHEMA
from sonaria.sources.voices import ENTRY_SCHEMA

cloudpickle.register_pickle_by_value(sys.modules[__name__])

CLIP = "path string, samples array<float>"


def _picky():
    def run(samples: pd.Series, language: pd.Series) -> pd.Series:
        if any(len(x) == 13 for x in samples):
            raise ValueError("unlucky")
        return pd.Series([{"text": f" n{len(x)} ", "language": "ru", "segments": []} for x in samples])

    return run


PICKY = Slot("test.picky", builtin.TRANSCRIPT, _picky)


def _upper_or_fail():
    def run(texts: pd.Series) -> pd.Series:
        if texts.str.contains("n5").any():
            raise RuntimeError("accent")
        return texts.str.upper()

    return run


UPPER = Slot("test.upper", "string", _upper_or_fail)


def test_batch_transcription(spark, tmp_path):
    rows = [("d/a.wav", [0.1] * 5), ("d/b.wav", [0.1] * 13), ("d/C.WAV", [0.1] * 7), ("d/e.wav", []), ("d/f.wav", [0.1] * 9)]
    clips = spark.createDataFrame(rows, CLIP)
    done = spark.createDataFrame([("old/F.wav", "x")], "file string, text string")
    results = plans.transcription_job(clips, done, transcribe=PICKY, punctuate=builtin.PUNCTUATE, accent=UPPER)
    got = {r.file: (r.text, r.error) for r in results.collect()}
    assert set(got) == {"a.wav", "b.wav", "C.WAV", "e.wav"}
    assert got["a.wav"] == (" n5", None)
    assert got["C.WAV"] == (" N7", None)
    assert got["e.wav"][1] is None and got["e.wav"][0].strip() == ""
    assert got["b.wav"][0] is None and "unlucky" in got["b.wav"][1]
    plans.write_transcription(results, str(tmp_path / "meta"), str(tmp_path / "err"))
    assert {r.file for r in corpus.read_metadata(spark, str(tmp_path / "meta")).collect()} == {"a.wav", "C.WAV", "e.wav"}
    assert [r.value for r in spark.read.text(str(tmp_path / "err")).collect()] == ["d/b.wav :: ValueError('unlucky')"]


def test_error_policies(spark):
    df = spark.createDataFrame([("n5",), ("n6",)], "text string")
    keep = base.apply(df, UPPER, [F.col("text")], "out", base.KEEP_INPUT, F.col("text"))
    assert [r.out for r in keep.collect()] == ["n5", "N6"]
    assert [r.out for r in base.apply(df, UPPER, [F.col("text")], "out", base.DROP).collect()] == ["N6"]
    with pytest.raises(Exception, match="accent"):
        base.apply(df, UPPER, [F.col("text")], "out", base.RAISE).collect()


def test_spectral_embedding_is_unit_length(spark):
    tone = [float(x) for x in 0.5 * np.sin(2 * np.pi * 440 * np.arange(4000) / 16000)]
    clips = spark.createDataFrame([("a", tone), ("z", [0.0] * 4000), ("n", [float("nan")] * 10)], CLIP)
    got = {r.path: r.embedding for r in jobs.embed(clips).collect()}
    assert len(got["a"]) == 256 and np.linalg.norm(got["a"]) == pytest.approx(1.0, abs=1e-5)
    assert got["z"] is None and got["n"] is None


def test_denoise_pads_and_sets_the_level(spark):
    clips = spark.createDataFrame([("a", [0.5, -0.5] * 100), ("long", [0.25, -0.25] * 8000)], CLIP)
    got = {r.path: np.array(r.samples) for r in jobs.denoise(clips).collect()}
    assert len(got["a"]) == 14400 and len(got["long"]) == 16000
    assert np.sqrt(np.mean(got["long"] ** 2)) == pytest.approx(10 ** (-18 / 20), rel=1e-4)


def test_enrolment(spark):
    tone = lambda f, s: [float(x) for x in 0.5 * np.sin(2 * np.pi * f * np.arange(int(16000 * s)) / 16000)]
    clips = spark.createDataFrame(
        [
            ("ann", "1.wav", tone(300, 3), 1),
            ("ann", "2.wav", tone(500, 3), 2),
            ("bob", "short.wav", tone(300, 2.9), 3),
            ("_default", "new.wav", tone(700, 3), 4),
            ("zed", "silent.wav", [0.0] * 48000, 5),
        ],
        "user_id string, ref_path string, samples array<float>, enrolled_at long",
    )
    old = spark.createDataFrame([("ann", "0.wav", [1.0], 0), ("old", "o.wav", [1.0], 0)], REGISTRY_SCHEMA)
    updated, rejected = plans.enrolment_job(clips, old)
    rows = {r.user_id: r.ref_path for r in updated.collect()}
    drawn = [u for u in rows if u not in ("ann", "old")]
    assert rows["ann"] == "2.wav" and rows["old"] == "o.wav" and len(drawn) == 1
    assert len(drawn[0]) == 32 and rows[drawn[0]] == "new.wav"
    assert {r.user_id for r in rejected.collect()} == {"bob", "zed"}


def _clip(*parts, rate=1000):
    rng = np.random.default_rng(0)
    return np.concatenate([np.zeros(ms) if quiet else rng.choice([-0.5, 0.5], ms) for quiet, ms in parts])


def _brute_runs(x, min_frames, threshold):
    limit = 10 ** (threshold / 20)
    silent = np.zeros(len(x), bool)
    for i in range(len(x) - min_frames + 1):
        if np.sqrt(np.mean(x[i : i + min_frames] ** 2)) <= limit:
            silent[i : i + min_frames] = True
    edges = np.flatnonzero(np.diff(np.concatenate([[0], ~silent, [0]]).astype(int)))
    return [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]


@pytest.mark.parametrize("block", [40, 4096])
def test_speech_runs_equal_brute_force(spark, block):
    x = _clip((0, 37), (1, 30), (0, 5), (1, 9), (0, 61), (1, 80), (0, 20), (1, 50))
    frames = spark.createDataFrame([("c", i, float(v * v)) for i, v in enumerate(x)], "clip_id string, frame long, energy double")
    got = signal.speech_runs(frames, 10, -50.0, block=block).orderBy("run").collect()
    assert [(r.start_frame, r.end_frame) for r in got] == _brute_runs(x, 10, -50.0)


def test_voice_reference_is_cut_and_transcribed_once(spark):
    long = _clip((1, 300), (0, 7000), (1, 1500), (0, 4000), (1, 1500), (0, 4000))
    loud = _clip((0, 15000))
    short = _clip((1, 200), (0, 900), (1, 100))
    rows = [(n, [float(v) for v in x]) for n, x in (("long", long), ("loud", loud), ("s1", short), ("s2", short))]
    clips = spark.createDataFrame(rows, "orig_file string, samples array<float>")
    cache = spark.createDataFrame([], ENTRY_SCHEMA)
    voices, fresh, references = plans.voice_catalog_job(clips, cache, rate=1000, accent=builtin.ACCENT)
    got = {r.orig_file: r for r in voices.collect()}
    assert len({r.voice_id for r in got.values()}) == 4
    assert got["s1"].sha1 == got["s2"].sha1 and got["s1"].ref_text == "len=950"
    assert got["loud"].ref_text == "len=12050"
    # First segment: 300 quiet ms trimmed, 7000 loud, 750 of the pause kept; the second would end past the cap.
    assert got["long"].ref_text == "len=7050"
    kinds = {r.kind: r["count"] for r in fresh.groupBy("kind").count().collect()}
    assert kinds == {"by_sha1": 3, "by_path": 3}
    wavs = {r.voice_id: bytes(r.wav) for r in references.collect()}
    assert {v: hashlib.sha1(w).hexdigest() for v, w in wavs.items()} == {r.voice_id: r.sha1 for r in got.values()}
    with wave.open(io.BytesIO(wavs[got["long"].voice_id])) as f:
        assert (f.getframerate(), f.getnframes(), f.getnchannels()) == (1000, 7050, 1)
    again, none, _ = plans.voice_catalog_job(clips, fresh, rate=1000)
    assert none.count() == 0 and again.count() == 4


def test_reference_kernel_equals_the_operators(spark):
    """The array kernel gives the samples that the table operators give."""
    rate = 1000
    rng = np.random.default_rng(3)
    clips = {
        f"c{i}": _clip(*[(k % 2, int(n)) for k, n in enumerate(rng.integers(50, 4000, rng.integers(2, 8)))]) * rng.uniform(0.05, 1)
        for i in range(8)
    }
    clips["quiet"], clips["tiny"] = np.zeros(3000), np.full(7, 0.5)
    rows = [(n, [float(v) for v in x]) for n, x in clips.items()]
    arrays = spark.createDataFrame([*rows, ("none", None), ("empty", [])], "clip_id string, samples array<float>")
    cleaned = arrays.select("clip_id", reference.clean_reference(F.col("samples"), rate).alias("x"))
    got = {r.clip_id: r.x for r in cleaned.collect()}
    assert got["none"] is None and got["empty"] == [0.0] * 50

    long = arrays.select("clip_id", F.posexplode("samples").alias("pos", "amp")).withColumn("pos", F.col("pos").cast("long"))
    frames = signal.frame_energy(long, rate)
    first = signal.cap_segments(signal.split_on_silence(frames))
    over = first.groupBy("clip_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("n")).where("n > 12000")
    second = signal.cap_segments(signal.split_on_silence(frames.join(over, "clip_id", "left_semi"), (100, -40.0)))
    chosen = first.join(over, "clip_id", "left_anti").unionByName(second)
    placed = long.join(chosen, "clip_id").where("pos >= start_ms and pos < end_ms").select(
        "clip_id", (F.col("offset_ms") + F.col("pos") - F.col("start_ms")).alias("pos"), F.col("amp").alias("level")
    )
    want: dict[str, list] = {name: [] for name in clips}
    for r in signal.hard_cap(placed, "pos").orderBy("clip_id", "pos").collect():
        want[r.clip_id].append(r.level)
    for name, x in want.items():
        loud = np.flatnonzero(np.abs(x) > 10 ** (-42 / 20)) if x else []
        kept = x[loud[0] : loud[-1] + 1] if len(loud) else []
        assert got[name] == pytest.approx([*kept, *[0.0] * 50]), name


def test_a_refused_clip_keeps_the_reason_of_its_reader(spark):
    clips = spark.createDataFrame(
        [("ann", "bad.wav", None, 1, "unsupported: x"), ("bob", "short.wav", [0.1], 2, None)],
        "user_id string, ref_path string, samples array<float>, enrolled_at long, error string",
    )
    _, rejected = plans.enrolment_job(clips, spark.createDataFrame([], REGISTRY_SCHEMA))
    assert {r.ref_path: r.error for r in rejected.collect()} == {"bad.wav": "unsupported: x", "short.wav": "too short"}


def _corpus(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "path string, sentence string, n int")


MARK = Slot("test.mark", "string", lambda: lambda texts: texts + "+")


def test_corpus_run_goes_on_after_a_stop_between_output_and_record(spark, tmp_path, monkeypatch):
    out = str(tmp_path / "corpus")
    clips = spark.createDataFrame([(f"p{i}",) for i in range(9)], "path string")
    rows = [(f"p{i}", f" text {i} ") for i in range(7)] + [("p3", "later"), ("gone", "x"), ("p8", None)]

    def run(rows, **more):
        return plans.corpus_run(_corpus(spark, rows), clips, out, ["n"], MARK, rows_per_batch=3, **more)

    def written():
        table = plans.corpus_table(spark, out).orderBy("idx").collect()
        return [(r.idx, r.path, r.file, r.text) for r in table]

    wanted = [(i, f"p{i}", f"cv_{i:07d}.wav", "later+" if i == 3 else f"text {i}+") for i in range(7)]
    run(rows, batches=1)
    assert written() == wanted[:3]

    report = ledger.dataset.run_report

    def stopped(*args, **kwargs):
        raise RuntimeError("stopped")

    # The rows of the batch are written when this is called, its record is not.
    monkeypatch.setattr(ledger.dataset, "run_report", stopped)
    with pytest.raises(RuntimeError):
        run(rows)
    monkeypatch.setattr(ledger.dataset, "run_report", report)
    assert written() == wanted[:3]
    run(rows)
    assert written() == wanted
    before = ledger.records(spark, out).count()
    run(rows)
    assert written() == wanted and ledger.records(spark, out).count() == before
    # New rows: one path is new, one text changed, one came again unchanged.
    run([*rows, ("p8", "eight"), ("p1", "other"), ("p2", "text 2")])
    changed = [(7, "p1", "cv_0000007.wav", "other+"), (8, "p8", "cv_0000008.wav", "eight+")]
    assert written() == [w for w in wanted if w[1] != "p1"] + changed
    assert ledger.progress(spark, out, "corpus") == 9


def test_transcription_runs_try_failed_clips_again(spark, tmp_path):
    out = str(tmp_path / "runs")
    rows = [("d/a.wav", [0.1] * 5), ("d/b.wav", [0.1] * 13), ("d/c.wav", [0.1] * 7)]
    clips = spark.createDataFrame(rows, CLIP)
    ticks = iter([0, 60_000_000, 0, 0])
    first = plans.transcription_run(clips, out, now=lambda: next(ticks), transcribe=PICKY).collect()
    assert [tuple(r) for r in first] == [(1, 3, 2, 1, 1.0, 3 / 60)]
    second = plans.transcription_run(clips, out, now=lambda: next(ticks), transcribe=builtin.TRANSCRIBE)
    assert sorted(tuple(r) for r in second.collect()) == [(1, 3, 2, 1, 1.0, 3 / 60), (2, 1, 1, 0, 0.0, 1.0)]
    done = {r.file: r.batch for r in plans.transcripts(spark, out).where("error is null").collect()}
    assert done == {"a.wav": 0, "c.wav": 0, "b.wav": 1}


def test_trim_and_caps(spark):
    levels = spark.createDataFrame(
        [("a", i, v) for i, v in enumerate([0.0, 0.5, 0.0, 0.5, 0.0])] + [("q", 0, 0.0)], "clip_id string, pos long, level double"
    )
    out = signal.trim_edges(levels).groupBy("clip_id").agg(F.count("*").alias("n")).collect()
    assert {r.clip_id: r.n for r in out} == {"a": 53, "q": 50}
    segs = spark.createDataFrame(
        [("c", i, 0, n) for i, n in enumerate([5000, 2000, 4000, 2000, 100])], "clip_id string, run long, start_ms long, end_ms long"
    )
    assert [r.run for r in signal.cap_segments(segs, block=2).orderBy("run").collect()] == [0, 1, 2]


SEEN = Slot("test.seen", "long", lambda: lambda samples: pd.Series([sum(map(len, samples))] * len(samples)))


def test_models_get_bounded_pieces_of_a_batch(spark):
    """600 padded clips fit into one batch of Spark; a call of the model holds about 1 MB of them."""
    clips = spark.range(0, 600, 1, 1).select("id", F.array_repeat(F.lit(0.5).cast("float"), 14400).alias("samples"))
    seen = base.apply(clips, SEEN, [F.col("samples")], "n").select("id", "n", "error").collect()
    assert sorted(r.id for r in seen) == list(range(600)) and not any(r.error for r in seen)
    assert max(r.n for r in seen) * 4 <= 2 << 20


def test_pieces_keep_rows_and_order():
    import pyarrow as pa

    from sonaria.functions.pieces import pieces

    values = [None, "a" * 3000, "b", "", "c" * 900, "d"] * 3
    parts = list(pieces(iter([pa.array(values, pa.string()), pa.array([], pa.string())]), 1000))
    assert [x for p in parts for x in p.to_pylist()] == values
    assert len(parts) > 3 and all(len(p) == 1 or p.nbytes <= 2000 for p in parts)
