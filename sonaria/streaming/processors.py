"""Keyed state of live sessions: rows not yet in their turn, one small record, one capped buffer.

Rows wait in the state until the watermark has passed them and are then applied in (ts_us, seq) order, so
messages do not depend on how rows fall into micro-batches, nor on their order across them: a stream
gives the messages of the batch replay of the same rows. Deadlines (silence, idle partials, coalesced
answers, the end of the state) are events in the same order: before a row is applied, all
that was due by then has happened. One timer per session wakes it for the next row or deadline.

The watermark of the stream lies ``grace_us`` behind the time up to which rows are applied. Rows that come
too late for their turn but within the grace are told as ``late`` with all they carry; only rows later
than that are dropped by Spark, which counts them.

A session that has had no rows for ``keep_us`` ends and leaves nothing behind; so does the mark of a closed
one, ``keep_us`` after it closed. Rows that come later open a new session.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sonaria.constants import PCM16_MAX, SAMPLE_RATE
from sonaria.functions.codec import resample_linear
from sonaria.functions.pieces import pieces

NEVER = -1

#: Messages of one packed value; each may hold a buffer.
FRAME_MESSAGES = 64

ROW_FIELDS = (
    "ts_us", "seq", "action", "utt_id", "payload", "sample_rate", "channels", "error_code", "error_detail"
)
#: Rows of one value of the waiting state: every value read costs a call of its own.
WAITING_ROWS = 256
#: Messages leave the state packed, many in one value: Spark converts the values of a session one by one.
PACKED = "packed binary"
LATE_SCHEMA = "struct<action:string,utt_id:string,payload:binary,sample_rate:int,channels:int>"
SPEECH_SCHEMA = (
    "session_id string, ts_us long, seq long, step int, type string, text string, utt_id string, "
    f"reason string, detail string, samples array<float>, late {LATE_SCHEMA}"
)
CHECK_SCHEMA = (
    "session_id string, ts_us long, seq long, type string, reason string, buffer_len long, "
    f"enough boolean, samples array<float>, detail string, late {LATE_SCHEMA}"
)
META_SCHEMA = (
    "last_activity long, last_emit long, silent boolean, closed boolean, seen long, dirty_ts long, dirty_seq long"
)


@dataclass(frozen=True)
class SessionParams:
    """Times in microseconds; None switches a deadline off (``keep_us`` None: state is kept for ever).

    ``coalesce_us``: new audio is answered once per tick of that length, by its last frame; None
    answers each frame.
    """

    window_samples: int
    emit_us: int | None = None
    gap_us: int | None = None
    min_samples: int = 0
    idle_partials: bool = False
    coalesce_us: int | None = 500_000
    language: str = "ru"
    keep_us: int | None = 24 * 3_600_000_000

    def __post_init__(self):
        if None not in (self.keep_us, self.gap_us) and self.keep_us < self.gap_us:
            raise ValueError("a session must be kept until its silence is over")


def _signal(row: dict) -> np.ndarray:
    """Mono samples at the engine rate of one aligned PCM16 frame."""
    x = np.frombuffer(bytes(row["payload"]), dtype="<i2").astype(np.float32) / np.float32(PCM16_MAX)
    if row["channels"] > 1:
        x = x.reshape(-1, int(row["channels"])).mean(axis=1, dtype=np.float32)
    if row["sample_rate"] != SAMPLE_RATE:
        x = resample_linear(x, int(row["sample_rate"]), SAMPLE_RATE).astype(np.float32)
    return np.clip(x, -1.0, 1.0)


def _plain(value):
    """State values are Python values; pandas brings its own kinds of null and numbers."""
    if value is None or isinstance(value, (int, str)):
        return value
    if isinstance(value, (bytes, bytearray)):
        return bytes(value)
    return None if pd.isna(value) else int(value)


def _packed_rows(rows: list[tuple]) -> list[tuple]:
    return [(pickle.dumps(rows[lo : lo + WAITING_ROWS]),) for lo in range(0, len(rows), WAITING_ROWS)]


def unpack(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The packed messages of many sessions as rows, in batches of a bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(iter([batch.column(0)])):
                rows = [row for packed in part.to_pylist() for row in pickle.loads(packed)]
                columns = zip(*rows)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return run


class _Session(StatefulProcessor):
    """What both kinds of sessions share: waiting rows, trailing buffer, clocks."""

    schema: str

    def __init__(self, params: SessionParams, grace_us: int = 0):
        self.params = params
        self.grace_us = grace_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "rows binary")
        self.meta = handle.getValueState("meta", META_SCHEMA)
        self.audio = handle.getValueState("audio", "data binary")

    def close(self) -> None:
        pass

    # ---- state

    def _fresh(self) -> None:
        self.last_activity = self.last_emit = self.seen = self.dirty_ts = self.dirty_seq = NEVER
        self.silent = self.closed = False
        self.open = False
        self.buffer = np.empty(0, dtype="<f4")

    def _load(self, key) -> None:
        self.key, self.out = key[0], []
        self._fresh()
        kept = self.meta.get()
        self.known = kept is not None
        if self.known:
            (
                self.last_activity, self.last_emit, self.silent, self.closed, self.seen, self.dirty_ts, self.dirty_seq,
            ) = kept
            self.open = True
        data = self.audio.get() if self.known else None
        self.heard = data is not None
        if self.heard:
            self.buffer = np.frombuffer(bytes(data[0]), dtype="<f4")

    def _save(self) -> None:
        if self.open:
            self.meta.update(
                (
                    self.last_activity, self.last_emit, self.silent, self.closed, self.seen, self.dirty_ts,
                    self.dirty_seq,
                )
            )
        elif self.known:
            self.meta.clear()
        if len(self.buffer):
            self.audio.update((self.buffer.astype("<f4").tobytes(),))
        elif self.heard:
            self.audio.clear()

    def _wake(self, first_waiting: int | None) -> None:
        """One timer for the next row or deadline; it fires when the watermark has passed it. The one that
        has just fired was the only one and is removed by Spark."""
        due = [d for d, _ in self._deadlines()]
        if first_waiting is not None:
            due.append(first_waiting)
        if due:
            self.handle.registerTimer(self._after(min(due)))

    # ---- order of rows and deadlines

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        self.key, self.out = key[0], []
        turn = self._turn(timerValues)
        came = []
        for frame in rows:
            columns = [frame[name].tolist() for name in ROW_FIELDS]
            for values in zip(*columns):
                row = dict(zip(ROW_FIELDS, map(_plain, values)))
                if row["action"] == "clock":
                    continue
                if turn is not None and row["ts_us"] < turn:
                    if not self.out:
                        self._load(key)
                    self._late(row)
                else:
                    came.append(tuple(row.values()))
        if came:
            self.waiting.appendList(_packed_rows(came))
            # The armed timer stands for the rows and deadlines there are already.
            first, armed = self._after(min(r[0] for r in came)), list(self.handle.listTimers())
            if not armed or first < min(armed):
                for timer in armed:
                    self.handle.deleteTimer(timer)
                self.handle.registerTimer(first)
        yield from self._frames()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._load(key)
        turn = self._turn(timerValues)
        rows = sorted(self._waiting(), key=lambda r: (r[0], -1 if r[1] is None else r[1]))
        ready = [r for r in rows if r[0] < turn]
        for values in ready:
            row = dict(zip(ROW_FIELDS, values))
            self._advance(row["ts_us"])
            self._take(row)
        self._advance(turn - 1)
        if ready:
            if len(ready) < len(rows):
                self.waiting.put(_packed_rows(rows[len(ready) :]))
            else:
                self.waiting.clear()
        self._save()
        self._wake(rows[len(ready)][0] if len(ready) < len(rows) else None)
        yield from self._frames()

    def _turn(self, timerValues) -> int | None:
        """Rows before this time are applied or late; None before the stream has a watermark."""
        mark = timerValues.getCurrentWatermarkInMs()
        return mark * 1000 + self.grace_us if mark > 0 else None

    def _after(self, ts_us: int) -> int:
        """The first watermark (milliseconds; a timer fires when it is reached) that has passed a time."""
        return int((ts_us - self.grace_us) // 1000 + 1)

    def _waiting(self) -> list[tuple]:
        return [row for packed in self.waiting.get() for row in pickle.loads(bytes(packed[0]))]

    def _advance(self, until: int) -> None:
        """Everything that is due by then, in its order."""
        while due := [d for d in self._deadlines() if d[0] <= until]:
            at, happen = min(due, key=lambda d: d[0])
            happen(at)

    def _deadlines(self) -> list:
        """(time, what happens) of the session as it stands; of equal times the first counts."""
        p = self.params
        found = []
        if not self.open:
            return found
        if self.dirty_ts != NEVER:
            found.append((self._tick_end(self.dirty_ts), self._answer_audio))
        if not self.closed:
            if p.idle_partials and p.emit_us is not None and self.last_emit != NEVER:
                found.append((self.last_emit + p.emit_us, self._idle))
            if p.gap_us is not None and not self.silent:
                found.append((self.last_activity + p.gap_us, self._silence))
        if p.keep_us is not None:
            found.append((self.seen + p.keep_us, self._forget))
        return found

    def _take(self, row: dict) -> None:
        if self.closed:
            return
        if not self.open:
            self.open, self.last_activity = True, row["ts_us"]
            self._ready(row)
        self.seen = row["ts_us"]
        self._apply(row)

    def _forget(self, at: int) -> None:
        self._fresh()

    # ---- audio

    def _tick_end(self, ts_us: int) -> int:
        tick = self.params.coalesce_us
        return (ts_us // tick + 1) * tick

    def _append(self, row: dict) -> str | None:
        """Takes a frame into the buffer; the error text of one that cannot be read."""
        try:
            x = _signal(row)
        except Exception as error:
            return repr(error)
        if len(x):
            self.buffer = np.concatenate([self.buffer, x])[-self.params.window_samples :]
        return None

    def _clear(self) -> None:
        self.buffer = self.buffer[:0]
        self.last_emit = NEVER

    def _parameters(self) -> str:
        """Effective parameters, told to the client when its session opens."""
        return json.dumps(asdict(self.params))

    def _frames(self) -> Iterator[pd.DataFrame]:
        if self.out:
            packed = [
                pickle.dumps(self.out[lo : lo + FRAME_MESSAGES]) for lo in range(0, len(self.out), FRAME_MESSAGES)
            ]
            yield pd.DataFrame({"packed": packed})

    @staticmethod
    def _carried(row: dict) -> dict:
        return {name: row[name] for name in ("action", "utt_id", "payload", "sample_rate", "channels")}

    # ---- what the two kinds say

    def _ready(self, row: dict) -> None:
        raise NotImplementedError

    def _apply(self, row: dict) -> None:
        raise NotImplementedError

    def _late(self, row: dict) -> None:
        raise NotImplementedError

    def _silence(self, due: int) -> None:
        raise NotImplementedError

    def _idle(self, due: int) -> None:
        raise NotImplementedError

    def _answer_audio(self, due: int) -> None:
        raise NotImplementedError


class AsrProcessor(_Session):
    """Recognition sessions: partials on flush and on time, final on stop and on silence.

    A message that wants a text carries the buffer; the recogniser runs behind the state, on the
    buffers of many sessions at once.
    """

    schema = SPEECH_SCHEMA

    def _say(self, ts_us, seq, step, kind, text=None, utt=None, reason=None, detail=None, samples=None, late=None):
        self.out.append((self.key, ts_us, seq, step, kind, text, utt, reason, detail, samples, late))

    def _say_text(self, ts_us, seq, step, kind, utt=None, reason=None) -> None:
        self._say(ts_us, seq, step, kind, None, utt, reason, samples=self.buffer.copy())

    def _ready(self, row) -> None:
        self._say(row["ts_us"], row["seq"], 0, "ready", detail=self._parameters())

    def _late(self, row) -> None:
        self._say(row["ts_us"], row["seq"], 4, "late", late=self._carried(row))

    def _silence(self, due) -> None:
        self._say_text(due, None, 1, "final", reason="inactivity")
        self._clear()
        self.silent = True

    def _idle(self, due) -> None:
        self.last_emit = due
        self._say_text(due, None, 3, "partial")

    def _apply(self, row) -> None:
        ts_us, seq, utt, action = row["ts_us"], row["seq"], row["utt_id"], row["action"]
        if action == "audio":
            failed = self._append(row)
            if failed:
                self._say(ts_us, seq, 2, "error", None, utt, "ingest_failed", failed)
            self.last_activity, self.silent = ts_us, False
        elif action == "flush":
            self._say_text(ts_us, seq, 2, "partial", utt)
        elif action == "stop":
            self._say_text(ts_us, seq, 2, "final", utt, "client_stop")
        elif action == "reset":
            self._say(ts_us, seq, 2, "ok", "reset", utt)
        else:
            self._say(ts_us, seq, 2, "error", None, utt, row["error_code"], row["error_detail"])
        if action in ("stop", "reset"):
            self._clear()
            self.last_activity, self.silent = ts_us, False
        elif self._emits(ts_us):
            self.last_emit = ts_us
            self._say_text(ts_us, seq, 3, "partial")

    def _emits(self, ts_us: int) -> bool:
        every = self.params.emit_us
        return every is not None and (self.last_emit == NEVER or ts_us - self.last_emit >= every)


class VerifyProcessor(_Session):
    """Verification sessions: a check on new audio and flush, a final check on stop or silence.

    New audio is answered once per tick (``coalesce_us``), unless a row that is no audio comes
    first: then before that row. With ``idle_partials`` a session without new audio is
    checked again after ``emit_us``: the interval is the longest wait for an answer, not a brake.
    """

    schema = CHECK_SCHEMA

    def _say(self, ts_us, seq, kind, reason=None, enough=False, samples=None, detail=None, late=None) -> None:
        self.out.append((self.key, ts_us, seq, kind, reason, len(self.buffer), enough, samples, detail, late))

    def _check(self, ts_us, seq, kind, reason=None) -> None:
        self.last_emit = ts_us
        enough = len(self.buffer) >= self.params.min_samples
        self._say(ts_us, seq, kind, reason, enough, self.buffer.copy() if enough else None)

    def _end(self, ts_us, seq, reason) -> None:
        self._check(ts_us, seq, "final", reason)
        self._clear()
        self.closed, self.seen = True, ts_us

    def _ready(self, row) -> None:
        self._say(row["ts_us"], row["seq"], "ready", detail=self._parameters())

    def _late(self, row) -> None:
        self._say(row["ts_us"], row["seq"], "late", late=self._carried(row))

    def _silence(self, due) -> None:
        self._answer_audio(due)
        self._end(due, None, "inactivity")

    def _idle(self, due) -> None:
        self._check(due, None, "partial")

    def _answer_audio(self, due=None) -> None:
        if self.dirty_ts != NEVER:
            at, seq = self.dirty_ts, self.dirty_seq
            self.dirty_ts = self.dirty_seq = NEVER
            self._check(at, None if seq == NEVER else seq, "partial")

    def _apply(self, row) -> None:
        ts_us, seq, action = row["ts_us"], row["seq"], row["action"]
        if action != "audio":
            self._answer_audio()
        if action == "audio":
            failed = self._append(row)
            if failed:
                self._answer_audio()
                self._say(ts_us, seq, "error", "ingest_failed", detail=failed)
                return
            self.last_activity = ts_us
            self.dirty_ts, self.dirty_seq = ts_us, NEVER if seq is None else seq
            if self.params.coalesce_us is None:
                self._answer_audio()
        elif action == "flush":
            self._check(ts_us, seq, "partial")
        elif action == "stop":
            self._end(ts_us, seq, "client_stop")
        else:
            self._say(ts_us, seq, "error", row["error_code"], detail=row["error_detail"])
