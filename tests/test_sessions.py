from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sonaria.functions import messages
from sonaria.operators import cadence, scan, sessions

ACTION = "session_id string, ts_us long, seq long, action string, n_samples long, utt_id string"
SEC = 1_000_000


def _actions(seed: int, rows: int = 400):
    """Two sessions; one holds most rows and spans many slices."""
    rng, out, now = random.Random(seed), [], 0
    for seq in range(rows):
        now += rng.choice([0, 1, 2, 5, 30]) * SEC
        action = rng.choices(["audio", "flush", "stop", "reset"], [12, 3, 1, 1])[0]
        n = rng.choice([0, 5, 40, 90]) if action == "audio" else 0
        out.append(("hot" if rng.random() < 0.9 else "cold", now, seq, action, n, None))
    return out


def _replay(rows, window, gap, every):
    """Row-by-row fold, the definition of the messages."""
    state, out = {}, set()
    for sid, ts, seq, action, n, utt in sorted(rows, key=lambda r: (r[1], r[2])):
        if sid not in state:
            out.add((sid, ts, seq, 0, "ready", None, None))
            state[sid] = {"len": 0, "act": ts, "emit": None, "silent": False}
        s = state[sid]
        text = lambda: f"len={s['len']}" if s["len"] else ""  # noqa: B023, E731
        if not s["silent"] and ts - s["act"] >= gap:
            out.add((sid, s["act"] + gap, None, 1, "final", text(), "inactivity"))
            s.update(len=0, emit=None, silent=True)
        if action == "audio":
            s.update(len=min(window, s["len"] + n), act=ts, silent=False)
        elif action == "flush":
            out.add((sid, ts, seq, 2, "partial", text(), None))
        elif action == "stop":
            out.add((sid, ts, seq, 2, "final", text(), "client_stop"))
        else:
            out.add((sid, ts, seq, 2, "ok", "reset", None))
        if action in ("stop", "reset"):
            s.update(len=0, emit=None, act=ts, silent=False)
        elif s["emit"] is None or ts - s["emit"] >= every:
            s["emit"] = ts
            out.add((sid, ts, seq, 3, "partial", text(), None))
    return out


@pytest.mark.parametrize("slice_rows", [7, 100_000])
def test_messages_equal_a_row_by_row_replay(spark, slice_rows):
    rows = _actions(7)
    df = spark.createDataFrame(rows, ACTION)
    got = sessions.asr_messages(df, 200, 30 * SEC, 12 * SEC, slice_rows).collect()
    found = {(r.session_id, r.ts_us, r.seq, r.step, r.type, r.text, r.reason) for r in got}
    assert len(found) == len(got)
    assert found == _replay(rows, 200, 30 * SEC, 12 * SEC)


def test_count_emits_drop_the_excess(spark):
    rows = _actions(3)
    got = sessions.count_emits(spark.createDataFrame(rows, ACTION), 150, 20).collect()
    want, acc = set(), {}
    for sid, _, seq, action, n, _ in sorted(rows, key=lambda r: (r[1], r[2])):
        if action == "audio":
            acc[sid] = acc.get(sid, 0) + n
            if acc[sid] >= 150:
                want.add((sid, seq))
                acc[sid] = 0
    assert {(r.session_id, r.seq) for r in got} == want and len(got) == len(want)


def _verify_replay(rows, window, least, gap, tick):
    """Row-by-row fold with what the next row is, the definition of the answers."""
    out = set()
    for sid in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == sid), key=lambda r: (r[1], r[2]))
        length, active, waits, closed = 0, own[0][1], None, False
        out.add((sid, own[0][1], own[0][2], "ready", None, 0, False))

        def tell(ts, seq, kind, reason, gate=True):
            out.add((sid, ts, seq, kind, reason, length, gate and length >= least))  # noqa: B023

        for _, ts, seq, action, n, _ in own:
            silent = ts - active >= gap
            if waits and (silent or action != "audio" or ts // tick != waits[0] // tick):
                tell(*waits, "partial", None)
                waits = None
            if silent:
                tell(active + gap, None, "final", "inactivity")
            elif action == "audio":
                length, active, waits = min(window, length + n), ts, (ts, seq)
            elif action == "flush":
                tell(ts, seq, "partial", None)
            elif action == "stop":
                tell(ts, seq, "final", "client_stop")
            else:
                tell(ts, seq, "error", "unknown_event", False)
            closed = silent or action == "stop"
            if closed:
                break
        if waits:
            tell(*waits, "partial", None)
    return out


@pytest.mark.parametrize("slice_rows", [3, 100_000])
def test_verification_answers_equal_a_row_by_row_replay(spark, slice_rows):
    rows, rng = [], random.Random(5)
    for s in range(30):
        now = 0
        for seq in range(40):
            now += rng.choice([0, 0, 1, 1, 2, 40 if rng.random() < 0.2 else 1]) * SEC
            action = rng.choices(["audio", "flush", "stop", "reset"], [20, 3, 0.4, 2])[0]
            rows.append((f"s{s}", now, seq, action, rng.choice([0, 5, 40]) if action == "audio" else 0, None))
    df = spark.createDataFrame(rows, ACTION)
    got = sessions.verify_checks(df, 200, 50, 30 * SEC, 3 * SEC, slice_rows).collect()
    found = {tuple(r) for r in got}
    assert len(found) == len(got)
    assert found == _verify_replay(rows, 200, 50, 30 * SEC, 3 * SEC)


def test_slices_hold_no_more_rows_than_they_say(spark):
    """One session has nearly all rows, all of them within one second."""
    rows = [("hot", i % 997, i, "audio", 1, None) for i in range(20_000)]
    rows += [(f"s{i}", i, i, "audio", 1, None) for i in range(50)]
    cut = scan.sliced(spark.createDataFrame(rows, ACTION), ["session_id"], ["ts_us", "seq"], 256)
    sizes = cut.groupBy("session_id", "_slice").count()
    assert sizes.agg(F.max("count")).first()[0] <= 256
    order = cut.where("session_id = 'hot'").orderBy("ts_us", "seq").collect()
    assert [r._slice for r in order] == sorted(r._slice for r in order)
    uttered = sessions.utterances(spark.createDataFrame(rows, ACTION), 10**9, slice_rows=256)
    assert uttered.where("session_id = 'hot'").agg(F.max("buffer_len")).first()[0] == 20_000


def _chain(xs, step, entered):
    out, last = [], entered
    for x, seq in sorted(xs):
        if x >= last + step:
            out.append((x, seq))
            last = x
    return out


@pytest.mark.parametrize("step", [1, 40, 3_000, 10**7])
@pytest.mark.parametrize("slice_rows, fold_entries", [(16, 10**6), (16, 20), (4096, 10**6)])
def test_emit_chain_in_bounded_groups(spark, step, slice_rows, fold_entries):
    """Steps shorter and longer than a slice; one key has most rows; positions repeat across slices."""
    rng = random.Random(step)
    rows, x = [], 0
    for seq in range(1500):
        x += rng.choice([0, 0, 1, 7, 50])
        rows.append(("hot", x, seq, "kept"))
    rows += [(f"k{i % 5}", rng.randrange(2000), i, "kept") for i in range(100)]
    cut = scan.sliced(
        spark.createDataFrame(rows, "k string, x long, seq long, more string"), ["k"], ["x", "seq"], slice_rows
    )
    got = cadence.emits(cut, ["k"], "_slice", "x", ["seq"], step, fold_entries=fold_entries).collect()
    for key in {r[0] for r in rows}:
        want = _chain([(r[1], r[2]) for r in rows if r[0] == key], step, cadence.AT_ONCE)
        assert sorted((r.x, r.seq) for r in got if r.k == key) == want
    assert {r.more for r in got} == {"kept"}


def test_trailing_buffer_keeps_part_of_the_oldest_frame(spark):
    rows = [("s", i, i, "audio", n, None) for i, n in enumerate([960, 1600])]
    uttered = sessions.utterances(spark.createDataFrame(rows, ACTION), 1600)
    assert [r.buffer_len for r in uttered.orderBy("seq").collect()] == [960, 1600]
    assert {r.seq: r.kept for r in sessions.retained(uttered, 1600).collect()} == {1: 1600}
    wider = sessions.retained(sessions.utterances(spark.createDataFrame(rows, ACTION), 2000), 2000)
    assert {r.seq: r.kept for r in wider.collect()} == {0: 400, 1: 1600}


def test_gap_equal_to_the_limit_closes_once(spark):
    rows = [
        ("s", 0, 0, "audio", 5, None),
        ("s", 10 * SEC, 1, "flush", 0, None),
        ("s", 11 * SEC, 2, "flush", 0, None),
    ]
    got = sessions.utterances(spark.createDataFrame(rows, ACTION), 100, 10 * SEC).orderBy("seq").collect()
    assert [r.silence_final for r in got] == [False, True, False]
    assert [r.buffer_len for r in got] == [5, 0, 0] and got[1].closed_len == 5


def test_frame_classification(spark):
    rows = [
        (0, "audio", bytes(4), None, 1),
        (1, "audio", bytes(1), None, 1),
        (2, "audio", bytes(6), None, 2),
        (3, "control", None, "not a json", 1),
        (4, "control", None, '{"event":"weird"}', 1),
        (5, "control", None, '{"event":"flush","utt_id":"u"}', 1),
        (6, "control", None, '{"event":"reset"}', 1),
        (7, "other", None, None, 1),
        (8, "control", None, "17", 1),
    ]
    df = spark.createDataFrame(rows, "i int, kind string, payload binary, body string, channels int")
    asr = {r.i: r for r in messages.classify(df).collect()}
    codes = [asr[i].error_code for i in range(9)]
    assert codes == [
        None, "bad_frame_size", "bad_frame_size", "bad_json", "unknown_event", None, None, "unsupported_frame", "bad_json",
    ]
    assert asr[1].error_detail == '{"got_bytes":1,"bytes_per_frame":2}'
    assert asr[4].error_detail == "weird" and asr[5].utt_id == "u"
    verify = {r.i: r.error_code for r in messages.classify(df, accepts_reset=False).collect()}
    assert verify[6] == "unknown_event"


def test_parameter_text(spark):
    df = spark.createDataFrame([("",), (" 2.5 ",), ("nan",), ("x",), ("1e999",)], "s string")
    got = [r.v for r in df.select(messages.strict_number(F.col("s")).alias("v")).collect()]
    assert got == [None, 2.5, None, None, None]
