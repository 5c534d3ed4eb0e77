from __future__ import annotations

import datetime as dt
import json
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from sonaria.session import scratch_path
from sonaria.slots import builtin
from sonaria.slots.base import Slot
from sonaria.sources import registry as registry_source
from sonaria.streaming import jobs
from sonaria.streaming.processors import SessionParams

# Test slots live in this module, which the workers cannot import.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SEC = 1_000_000
SECOND, NOTHING = dt.timedelta(seconds=1), dt.timedelta(0)


def _frame(session, seq, second, payload=None, body=None, rate=16000, channels=1, kind=None):
    kind = kind or ("audio" if payload is not None else "control")
    at = START + dt.timedelta(seconds=second)
    return (session, seq, at, kind, payload, body, rate, channels)


def _write(spark, path, *batches):
    """One file per batch, so that one file per trigger makes one micro-batch each."""
    for rows in batches:
        spark.createDataFrame(rows, jobs.FRAME_SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _until(spark, path, second):
    """The time of the stream moves on without a frame."""
    jobs.write_clock(spark, path, F.lit(START + dt.timedelta(seconds=second)))


def _tone(n, freq=440.0):
    x = 0.5 * np.sin(2 * np.pi * freq * np.arange(n) / 16000)
    return (x * 32767).astype("<i2").tobytes()


@pytest.fixture(autouse=True)
def few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def _rel(ts_us):
    return (ts_us - int(START.timestamp()) * SEC) / SEC


def test_asr_controls_errors_and_state_across_batches(spark):
    path = scratch_path(spark, "t-frames")
    _write(
        spark,
        path,
        [
            _frame("a", 2, 2, body='{"event":"flush","utt_id":"u1"}'),
            _frame("a", 1, 1, payload=bytes(200)),
            _frame("a", 3, 3, payload=bytes(3)),
        ],
        [
            _frame("a", 4, 4, payload=bytes(400), channels=2),
            _frame("a", 5, 5, body='{"event":"stop","utt_id":"u2"}'),
            _frame("a", 6, 6, body='{"event":"flush"}'),
            _frame("a", 7, 7, body="not a json"),
            _frame("a", 8, 8, body='{"event":"reset"}'),
        ],
    )
    _until(spark, path, 60)
    frames = jobs.read_frames(spark, path, files_per_trigger=1)
    said = jobs.run_to_end(jobs.asr_messages(frames, SessionParams(150)), "t-asr")
    flushed = jobs.asr_json(said.where("seq = 2")).first().message
    assert json.loads(flushed) == {"type": "partial", "text": "len=100", "utt_id": "u1"}
    got = said.orderBy("seq", "step").collect()
    seen = [(r.seq, r.type, r.text, r.utt_id, r.reason) for r in got]
    assert seen == [
        (1, "ready", None, None, None),
        (2, "partial", "len=100", "u1", None),
        (3, "error", None, None, "bad_frame_size"),
        (5, "final", "len=150", "u2", "client_stop"),
        (6, "partial", "", None, None),
        (7, "error", None, None, "bad_json"),
        (8, "ok", "reset", None, None),
    ]


def test_silence_timer_fires_on_the_watermark(spark):
    path = scratch_path(spark, "t-silence")
    _write(
        spark,
        path,
        [_frame("quiet", 1, 0, payload=bytes(20))],
        [_frame("other", 2, 100, payload=bytes(20))],
        [_frame("other", 3, 101, payload=bytes(20))],
    )
    frames = jobs.read_frames(spark, path, files_per_trigger=1)
    params = SessionParams(1000, gap_us=30 * SEC)
    got = jobs.run_to_end(jobs.asr_messages(frames, params, delay=SECOND), "t-quiet")
    finals = [(r.session_id, _rel(r.ts_us), r.text, r.reason) for r in got.where("type = 'final'").collect()]
    assert finals == [("quiet", 30.0, "len=10", "inactivity")]


def test_idle_partials_come_from_timers(spark):
    path = scratch_path(spark, "t-idle")
    _write(
        spark,
        path,
        [_frame("quiet", 1, 0, payload=bytes(20))],
        [_frame("other", 2, 5, payload=bytes(20))],
        [_frame("other", 3, 9, payload=bytes(20))],
    )
    frames = jobs.read_frames(spark, path, files_per_trigger=1)
    params = SessionParams(1000, emit_us=2 * SEC, idle_partials=True)
    got = jobs.run_to_end(jobs.asr_messages(frames, params, delay=SECOND), "t-idle-out")
    quiet = sorted(_rel(r.ts_us) for r in got.where("session_id = 'quiet' AND type = 'partial'").collect())
    assert quiet[:3] == [0.0, 2.0, 4.0]


def _first_sample():
    """Test embedder: direction by the sign of the first sample."""

    def run(samples: pd.Series) -> pd.Series:
        return samples.map(lambda x: [0.0, 1.0, 0.0] if x[1] > 0 else [1.0, 0.0, 0.0])

    return run


SIGN = Slot("test.sign", "array<float>", _first_sample)


def test_verify_session_matches_a_registry_that_changes(spark, tmp_path):
    root = str(tmp_path / "registry")
    schema = registry_source.REGISTRY_SCHEMA
    registry_source.write_version(spark.createDataFrame([("a", "a", [1.0, 0.0, 0.0], 1)], schema), root)
    path, out, checkpoint = (scratch_path(spark, n) for n in ("t-v", "t-vout", "t-vcp"))
    _write(spark, path, [_frame("s", 1, 1, payload=_tone(4000))])
    frames = jobs.read_frames(spark, path, files_per_trigger=1)
    checks = jobs.verify_checks(frames, SessionParams(128000, gap_us=120 * SEC, min_samples=4800), delay=NOTHING)

    def run():
        query = jobs.start_matching(
            checks, lambda s: registry_source.read_latest(s, root), out, checkpoint, embed=SIGN, denoise=None, threshold=0.7
        )
        query.awaitTermination()

    _until(spark, path, 1.9)
    run()
    _write(spark, path, [_frame("s", 2, 2, payload=_tone(1600))])
    _until(spark, path, 2.9)
    run()
    both = spark.createDataFrame([("a", "a", [1.0, 0.0, 0.0], 1), ("b", "b", [0.0, 2.0, 0.0], 2)], schema)
    registry_source.write_version(both, root)
    _write(
        spark,
        path,
        [
            _frame("s", 3, 3, body='{"event":"flush"}'),
            _frame("s", 4, 4, body='{"event":"reset"}'),
            _frame("s", 5, 5, body='{"event":"stop"}'),
            _frame("s", 6, 6, payload=_tone(1600)),
        ],
    )
    _until(spark, path, 7)
    run()
    decided = spark.read.parquet(out)
    answers = decided.where("type in ('partial', 'final')")
    texts = [json.loads(r.message) for r in jobs.verify_json(answers).where("seq <> 3").orderBy("seq").collect()]
    assert [t["best"] and t["best"]["user_id"] for t in texts] == [None, None, "b"]
    assert texts[0] == {
        "type": "partial", "decision": False, "threshold": 0.7, "best": None, "matches": [], "reason": None,
        "session_id": "s", "version": 1, "ts_ms": int(START.timestamp() * 1000) + 1000,
    }
    rows = decided.orderBy("seq", "type").collect()
    seen = [(r.seq, r.type, r.decision, r.best.user_id if r.best else None, len(r.matches), r.reason) for r in rows]
    assert seen == [
        (1, "partial", False, None, 0, None),
        (1, "ready", None, None, 0, None),
        (2, "partial", False, None, 1, None),
        (3, "partial", True, "b", 2, None),
        (4, "error", None, None, 0, "unknown_event"),
        (5, "final", True, "b", 2, "client_stop"),
    ]


def test_broken_frame_is_an_error_not_the_end(spark):
    path = scratch_path(spark, "t-broken")
    broken = _frame("s", 2, 2, payload=_tone(10))
    rows = [_frame("s", 1, 1, payload=_tone(4000)), broken, _frame("s", 3, 3, body='{"event":"stop"}')]
    _write(spark, path, rows)
    _until(spark, path, 60)
    frames = jobs.read_frames(spark, path).withColumn(
        "sample_rate", F.when(F.col("seq") == 2, F.lit(0)).otherwise(F.col("sample_rate"))
    )
    said = jobs.run_to_end(jobs.verify_checks(frames, SessionParams(128000, min_samples=1)), "t-broken-out")
    seen = {(r.seq, r.type, r.reason) for r in said.collect()}
    assert (2, "error", "ingest_failed") in seen and (3, "final", "client_stop") in seen


def test_idle_verify_session_is_checked_again_then_closed(spark):
    path = scratch_path(spark, "t-vidle")
    _write(
        spark,
        path,
        [_frame("quiet", 1, 0, payload=bytes(20))],
        [_frame("other", 2, 3, payload=bytes(20))],
        [_frame("other", 3, 20, payload=bytes(20))],
        [_frame("other", 4, 21, payload=bytes(20))],
    )
    frames = jobs.read_frames(spark, path, files_per_trigger=1)
    params = SessionParams(1000, emit_us=SEC, gap_us=10 * SEC, idle_partials=True)
    got = jobs.run_to_end(jobs.verify_checks(frames, params, delay=SECOND), "t-vidle-out")
    rows = got.where("session_id = 'quiet'").collect()
    partials = sorted(_rel(r.ts_us) for r in rows if r.type == "partial")
    assert partials[:3] == [0.0, 1.0, 2.0]
    assert [(_rel(r.ts_us), r.reason, r.buffer_len) for r in rows if r.type == "final"] == [(10.0, "inactivity", 10)]
    ready = [json.loads(r.detail) for r in rows if r.type == "ready"]
    assert len(ready) == 1 and ready[0]["gap_us"] == 10 * SEC


def test_buffer_is_capped_at_the_window(spark):
    path = scratch_path(spark, "t-cap")
    _write(spark, path, [_frame("s", 1, 1, payload=bytes(320000)), _frame("s", 2, 2, payload=bytes(2 * 48000), rate=48000)])
    _until(spark, path, 60)
    frames = jobs.read_frames(spark, path)
    got = jobs.run_to_end(jobs.verify_checks(frames, SessionParams(128000, coalesce_us=None)), "t-cap-out")
    assert [r.buffer_len for r in got.where("type = 'partial'").orderBy("seq").collect()] == [128000, 128000]


def test_corpus_increment_reads_new_files_only(spark):
    source, out, checkpoint = (scratch_path(spark, n) for n in ("t-src", "t-out", "t-cp"))
    clips = spark.createDataFrame([("x",), ("y",)], "path string")
    schema = "path string, sentence string"

    def arrive(*rows):
        spark.createDataFrame(list(rows), schema).write.mode("append").parquet(source)
        jobs.start_corpus_increment(spark, source, schema, clips, out, checkpoint).awaitTermination()
        return sorted(r.value for r in spark.read.text(out).collect())

    assert arrive(("x", " one "), ("gone", "no clip"), ("y", None)) == ["x|one"]
    assert arrive(("y", "two")) == ["x|one", "y|two"]


def test_model_failure_in_a_session(spark):
    def broken():
        def run(samples, language):
            raise RuntimeError("no model")

        return run

    slot = Slot("test.broken", builtin.TRANSCRIPT, broken)
    path = scratch_path(spark, "t-broken")
    _write(
        spark,
        path,
        [
            _frame("s", 1, 1, payload=bytes(20)),
            _frame("s", 2, 2, body='{"event":"flush"}'),
            _frame("s", 3, 3, body='{"event":"stop"}'),
        ],
    )
    _until(spark, path, 60)
    got = jobs.run_to_end(jobs.asr_messages(jobs.read_frames(spark, path), SessionParams(100), slot), "t-broken-out")
    seen = [(r.seq, r.type, r.text, r.reason) for r in got.where(F.col("step") == 2).orderBy("seq").collect()]
    assert seen == [(2, "error", None, "model_failed"), (3, "final", "", "client_stop")]


def _state(spark, checkpoint, name):
    """Rows of one state variable of the stateful operator as it stands."""
    reader = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", name)
    return reader.load().collect()


def test_rows_are_applied_in_order_across_micro_batches(spark):
    path = scratch_path(spark, "t-order")
    rows = [
        _frame("a", 1, 1, payload=bytes(20)),
        _frame("a", 2, 2, body='{"event":"flush"}'),
        _frame("a", 3, 3, payload=bytes(20)),
        _frame("a", 4, 4, body='{"event":"stop"}'),
        _frame("a", 5, 5, payload=bytes(40)),
        _frame("a", 6, 6, body='{"event":"flush"}'),
        _frame("b", 7, 6, body='{"event":"flush"}'),
    ]
    for i in (3, 6, 0, 5, 1, 4, 2):
        _write(spark, path, [rows[i]])
    _until(spark, path, 30)
    frames = jobs.read_frames(spark, path, files_per_trigger=1)
    said = jobs.run_to_end(jobs.asr_messages(frames, SessionParams(1000)), "t-order-out")
    texts = said.where("session_id = 'a' and type in ('partial', 'final')").orderBy("seq").collect()
    assert [(r.seq, r.text) for r in texts] == [(2, "len=10"), (4, "len=20"), (6, "len=20")]
    assert [r.seq for r in said.where("type = 'ready'").orderBy("seq").collect()] == [1, 7]


@pytest.mark.parametrize("per_trigger", [1, 100])
def test_coalesced_answers_do_not_depend_on_micro_batches(spark, per_trigger):
    path = scratch_path(spark, "t-tick")
    seconds = [0.1, 0.2, 0.3, 1.1, 1.9, 2.5, 2.6]
    for i, second in enumerate(seconds):
        _write(spark, path, [_frame("s", i, second, payload=bytes(20))])
    _write(spark, path, [_frame("s", 90, 2.7, body='{"event":"flush"}'), _frame("s", 91, 2.8, payload=bytes(20))])
    _until(spark, path, 30)
    frames = jobs.read_frames(spark, path, files_per_trigger=per_trigger)
    params = SessionParams(1000, coalesce_us=SEC)
    got = jobs.run_to_end(jobs.verify_checks(frames, params), "t-tick-out").where("type = 'partial'")
    assert [(r.seq, r.buffer_len) for r in got.orderBy("seq").collect()] == [(2, 30), (4, 50), (6, 70), (90, 70), (91, 80)]


def test_late_frames_are_told_with_all_they_carry(spark):
    path = scratch_path(spark, "t-late")
    _write(spark, path, [_frame("s", 1, 100, payload=bytes(20))])
    _write(spark, path, [_frame("s", 2, 200, payload=bytes(20))])
    late = [_frame("s", 3, 150, payload=b"\x01\x02"), _frame("new", 4, 160, body='{"event":"flush","utt_id":"u"}')]
    _write(spark, path, [*late, _frame("s", 5, 195, payload=bytes(20))])
    _write(spark, path, [_frame("s", 6, 50, payload=bytes(20))])
    _until(spark, path, 400)
    frames = jobs.read_frames(spark, path, files_per_trigger=1)
    out, checkpoint = scratch_path(spark, "t-late-out"), scratch_path(spark, "t-late-cp")
    said = jobs.asr_messages(frames, SessionParams(1000), grace=dt.timedelta(seconds=100))
    query = jobs.start_writing(said, out, checkpoint)
    query.awaitTermination()
    written = spark.read.schema(said.schema).parquet(out)
    told = jobs.late_frames(written).orderBy("seq").collect()
    assert [(r.session_id, r.seq, r.action, r.utt_id, r.payload) for r in told] == [
        ("s", 3, "audio", None, b"\x01\x02"),
        ("new", 4, "flush", "u", None),
    ]
    # Frame 6 is later than delay and grace: Spark drops and counts it.
    dropped = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert dropped == 1
    assert {r.session_id for r in written.where("type = 'ready'").collect()} == {"s"}


@pytest.mark.parametrize("kind", ["asr", "verify"])
def test_no_state_is_left_after_close_and_after_idle_time(spark, kind):
    path, out, checkpoint = (scratch_path(spark, f"t-end-{n}") for n in ("in", "out", "cp"))
    params = SessionParams(1000, gap_us=20 * SEC, keep_us=60 * SEC)
    _write(spark, path, [_frame("stopped", 1, 1, payload=bytes(20)), _frame("quiet", 2, 1, payload=bytes(20))])
    frames = jobs.read_frames(spark, path, files_per_trigger=1)
    make = jobs.asr_messages if kind == "asr" else jobs.verify_checks
    said = make(frames, params, delay=SECOND)

    def run():
        jobs.start_writing(said, out, checkpoint).awaitTermination()
        return {name: len(_state(spark, checkpoint, name)) for name in ("meta", "audio", "waiting")}

    _write(spark, path, [_frame("stopped", 3, 2, body='{"event":"stop"}')])
    _until(spark, path, 10)
    assert run() == {"meta": 2, "audio": 1, "waiting": 0}
    _until(spark, path, 40)
    assert run() == {"meta": 2, "audio": 0, "waiting": 0}
    _until(spark, path, 200)
    assert run() == {"meta": 0, "audio": 0, "waiting": 0}
    # The id of an ended session opens a new one.
    _write(spark, path, [_frame("stopped", 4, 300, payload=bytes(20))])
    _until(spark, path, 305)
    assert run() == {"meta": 1, "audio": 1, "waiting": 0}
    ready = spark.read.schema(said.schema).parquet(out).where("type = 'ready' and session_id = 'stopped'")
    assert sorted(r.seq for r in ready.collect()) == [1, 4]


def test_the_recogniser_is_called_for_batches_of_sessions(spark, tmp_path):
    log = str(tmp_path / "calls")

    def counting():
        def run(samples, language):
            with open(log, "a") as f:
                f.write(f"{len(samples)}\n")
            return pd.Series([{"text": f"n{len(x)}", "language": lang, "segments": []} for x, lang in zip(samples, language)])

        return run

    slot = Slot("test.counting", builtin.TRANSCRIPT, counting)
    path = scratch_path(spark, "t-calls")
    rows = [_frame(f"s{i}", i, 1, payload=bytes(2 * (i + 1))) for i in range(60)]
    rows += [_frame(f"s{i}", 100 + i, 2, body='{"event":"flush"}') for i in range(60)]
    _write(spark, path, rows)
    _until(spark, path, 60)
    got = jobs.run_to_end(jobs.asr_messages(jobs.read_frames(spark, path), SessionParams(1000), slot), "t-calls-out")
    assert {r.seq - 100: r.text for r in got.where("type = 'partial'").collect()} == {i: f"n{i + 1}" for i in range(60)}
    sizes = [int(line) for line in open(log)]
    # One call per state partition (a core each), not one per message.
    assert sum(sizes) == 60 and len(sizes) <= spark.sparkContext.defaultParallelism


def test_parameters_keep_a_session_until_its_silence_is_over():
    with pytest.raises(ValueError):
        SessionParams(100, gap_us=100, keep_us=50)


def test_rows_of_a_session_are_few_state_values_and_messages_are_unpacked_in_order():
    import pickle

    import pyarrow as pa

    from sonaria.streaming import processors

    rows = [(i, None, "audio", "ü", b"\0\1", 16000, 1, None, None) for i in range(600)]
    packed = processors._packed_rows(rows)
    assert len(packed) == 3
    assert [r for (value,) in packed for r in pickle.loads(value)] == rows

    schema = pa.schema([("session_id", pa.string()), ("n", pa.int64()), ("samples", pa.list_(pa.float32()))])
    said = [("a", 1, np.ones(2, "<f4")), ("a", None, None)], [("b", 3, np.empty(0, "<f4"))]
    batch = pa.record_batch([pa.array([pickle.dumps(s) for s in said])], names=["packed"])
    got = [row for part in processors.unpack(schema)(iter([batch, batch.slice(0, 0)])) for row in part.to_pylist()]
    assert [(r["session_id"], r["n"], r["samples"]) for r in got] == [("a", 1, [1.0, 1.0]), ("a", None, None), ("b", 3, [])]
