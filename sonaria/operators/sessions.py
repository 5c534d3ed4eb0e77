"""Batch replay of audio sessions: utterances, trailing buffers, emits, silences, messages.

An action row is (session_id, ts_us, seq, action, n_samples, utt_id); ``action`` is audio, flush,
stop, reset or error. Replay order is (ts_us, seq). Lengths travel here, never samples; what a
recogniser says of a buffer of a length comes in as a column expression.

Sessions are cut into slices of ``slice_rows`` rows at most, written once; no window or group is larger.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from sonaria.operators import cadence
from sonaria.operators.scan import SLICE_ROWS, Running, following, running, sliced
from sonaria.session import materialise

ORDER = ["ts_us", "seq"]


def _action(*names: str) -> Column:
    return F.col("action").isin(*names)


def _samples() -> Column:
    return F.when(_action("audio"), F.col("n_samples")).otherwise(F.lit(0)).cast("bigint")


def _sliced(actions: DataFrame, slice_rows: int) -> DataFrame:
    return sliced(actions, ["session_id"], ORDER, slice_rows)


def _windows() -> tuple[WindowSpec, WindowSpec, WindowSpec]:
    """Inside a slice up to the row, inside a slice before the row, over the earlier slices."""
    inside = Window.partitionBy("session_id", "_slice").orderBy(*ORDER)
    return (
        inside.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        inside.rowsBetween(Window.unboundedPreceding, -1),
        Window.partitionBy("session_id")
        .orderBy("_slice")
        .rowsBetween(Window.unboundedPreceding, -1),
    )


def inactivity_flags(
    actions: DataFrame, gap_us: int | None, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Adds ``silence_final``: the session had been silent for the gap before this row.

    Audio, stop and reset count as activity, and so does the first row. A gap equal to the limit
    closes; one silence gives one final, however many control rows fall into it.
    """
    _, before, earlier = _windows()
    us = F.col("ts_us")
    active = F.when(_action("audio", "stop", "reset"), us)
    cut = _sliced(actions, slice_rows)
    if gap_us is None:
        return cut.withColumn("silence_final", F.lit(False)).withColumn(
            "silence_due", F.lit(None).cast("bigint")
        )
    carry = (
        cut.groupBy("session_id", "_slice")
        .agg(F.max(active).alias("a"), F.min("ts_us").alias("f"), F.max("ts_us").alias("p"))
        .select(
            "session_id",
            "_slice",
            F.max("a").over(earlier).alias("_ca"),
            F.min("f").over(earlier).alias("_cf"),
            F.max("p").over(earlier).alias("_cp"),
        )
    )
    local = cut.select(
        "*",
        F.max(active).over(before).alias("_la"),
        F.min("ts_us").over(before).alias("_lf"),
        F.max("ts_us").over(before).alias("_lp"),
    )
    prev = F.coalesce("_lp", "_cp")
    last = F.coalesce("_la", "_ca", "_cf", "_lf")
    due = last + F.lit(gap_us)
    silent = F.coalesce((us >= due) & (prev < due), F.lit(False))
    return local.join(carry, ["session_id", "_slice"]).select(
        *actions.columns,
        "_slice",
        silent.alias("silence_final"),
        F.when(silent, due).alias("silence_due"),
    )


def utterances(
    actions: DataFrame,
    window_samples: int,
    gap_us: int | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Adds ``opens`` (first row of the session), ``silence_final``, ``epoch``, ``buffer_len``
    (after the row) and ``closed_len`` (buffer before a silence final).

    stop and reset end an utterance after their row; a silence final ends it before its row.
    The buffer length has a closed form because lengths are never negative:
    min(window, samples since the utterance began). A slice is summarised by its samples, its
    utterance ends and the place of the last end, so carries stay one row per slice.
    """
    upto, before, earlier = _windows()
    ends, silent = _action("stop", "reset"), F.col("silence_final")
    ended_at = F.when(ends, F.col("_sum"))
    silent_at = F.when(silent, F.col("_sum") - _samples())
    local = (
        inactivity_flags(actions, gap_us, slice_rows)
        .select(
            "*",
            F.sum(_samples()).over(upto).alias("_sum"),
            F.coalesce(F.count_if(ends).over(before), F.lit(0)).alias("_ends"),
            F.count_if(silent).over(upto).alias("_silences"),
            F.count(F.lit(1)).over(before).alias("_rows"),
        )
        .select(
            "*",
            F.greatest(F.max(ended_at).over(before), F.max(silent_at).over(upto)).alias("_base"),
            F.greatest(F.max(ended_at).over(before), F.max(silent_at).over(before)).alias("_left"),
        )
    )
    totals = local.groupBy("session_id", "_slice").agg(
        F.max("_sum").alias("total"),
        (F.count_if(ends) + F.count_if(silent)).alias("closed"),
        F.greatest(F.max(ended_at), F.max(silent_at)).alias("last_end"),
    )
    carry = totals.select(
        "*", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("_before")
    ).select(
        "session_id",
        "_slice",
        "_before",
        (F.count(F.lit(1)).over(earlier) == 0).alias("_starts"),
        F.coalesce(F.sum("closed").over(earlier), F.lit(0)).alias("_closed"),
        F.max(F.col("_before") + F.col("last_end")).over(earlier).alias("_end_before"),
    )
    zero, window = F.lit(0).cast("bigint"), F.lit(window_samples).cast("bigint")
    total = F.col("_before") + F.col("_sum")
    base = F.coalesce(F.col("_before") + F.col("_base"), "_end_before", zero)
    left = F.coalesce(F.col("_before") + F.col("_left"), "_end_before", zero)
    return local.join(carry, ["session_id", "_slice"]).select(
        *actions.columns,
        "_slice",
        (F.col("_starts") & (F.col("_rows") == 0)).alias("opens"),
        "silence_final",
        "silence_due",
        (F.col("_closed") + F.col("_ends") + F.col("_silences")).alias("epoch"),
        (total - base).alias("epoch_samples"),
        F.least(window, total - base).alias("buffer_len"),
        F.when(silent, F.least(window, total - _samples() - left)).alias("closed_len"),
    )


def retained(uttered: DataFrame, window_samples: int) -> DataFrame:
    """Audio rows still in the buffer when their utterance ends, with the samples kept of each."""
    # The total of an utterance is repeated for each of its slices, so that the join key of a long
    # utterance is as spread as its rows, which are not shuffled again.
    key = ["session_id", "_slice", "epoch"]
    whole = Window.partitionBy("session_id", "epoch")
    totals = (
        uttered.groupBy(*key)
        .agg(F.max("epoch_samples").alias("_part"))
        .select(*key, F.max("_part").over(whole).alias("epoch_total"))
    )
    after = F.col("epoch_total") - F.col("epoch_samples")
    return (
        uttered.where(_action("audio") & (F.col("n_samples") > 0))
        .join(totals, key)
        .where(after < window_samples)
        .withColumn("kept", F.least(F.col("n_samples"), F.lit(window_samples) - after))
        .drop("epoch_total")
    )


def count_emits(
    actions: DataFrame, every_samples: int, slice_rows: int = SLICE_ROWS
) -> DataFrame:
    """Rows at which the sample counter reaches the step; it restarts from zero there."""
    audio = actions.where(_action("audio")).select(
        "session_id", *ORDER, F.col("n_samples").cast("bigint").alias("n_samples")
    )
    summed = running(
        _sliced(audio, slice_rows),
        ["session_id"],
        "_slice",
        ORDER,
        [Running("samples_seen", "sum", F.col("n_samples"))],
    )
    found = cadence.emits(
        materialise(summed, "samples-seen"), ["session_id"], "_slice", "samples_seen", ORDER, every_samples, entered=0
    )
    return found.select("session_id", *ORDER, "samples_seen")


def timed_emits(uttered: DataFrame, every_us: int) -> DataFrame:
    """Rows at which a timed partial is due, per utterance; the first row of one emits at once.

    ``uttered`` is read twice and should be a written table.
    """
    rows = uttered.select("session_id", "epoch", "_slice", *ORDER, "action", "buffer_len")
    found = cadence.emits(rows, ["session_id", "epoch"], "_slice", "ts_us", ["seq"], every_us)
    return found.drop("_slice")


def spoken_length(length: Column) -> Column:
    """Text of the built-in recogniser: the buffer length, nothing for an empty buffer."""
    return F.when(length > 0, F.concat(F.lit("len="), length.cast("string"))).otherwise(F.lit(""))


def asr_messages(
    actions: DataFrame,
    window_samples: int,
    gap_us: int | None = None,
    every_us: int | None = None,
    slice_rows: int = SLICE_ROWS,
    recognised: Callable[[Column], Column] = spoken_length,
) -> DataFrame:
    """Every message of the recognition sessions: session_id, ts_us, seq, step, type, text,
    utt_id, reason. ``step`` orders messages of one row: ready, silence final, answer, partial. A
    silence final carries its deadline and no seq, as no row caused it. ``recognised`` gives the
    text of a buffer of a length."""
    uttered = utterances(actions, window_samples, gap_us, slice_rows)
    if every_us is not None:
        # Three branches read the utterances; lengths only, so one written copy is cheap.
        uttered = materialise(uttered, "utterances")
    none = F.lit(None).cast("string")
    text = recognised(F.col("buffer_len"))

    def message(
        step: int, kind: str, body: Column, utt: Column, reason: Column, at=None, seq=None
    ) -> Column:
        return F.struct(
            (F.col("ts_us") if at is None else at).alias("ts_us"),
            (F.col("seq") if seq is None else seq).alias("seq"),
            F.lit(step).alias("step"),
            F.lit(kind).alias("type"),
            body.alias("text"),
            utt.alias("utt_id"),
            reason.alias("reason"),
        )

    utt = F.col("utt_id")
    ready = F.when(F.col("opens"), message(0, "ready", none, none, none))
    silent = F.when(
        F.col("silence_final"),
        message(
            1,
            "final",
            recognised(F.col("closed_len")),
            none,
            F.lit("inactivity"),
            F.col("silence_due"),
            F.lit(None).cast("bigint"),
        ),
    )
    answer = (
        F.when(_action("flush"), message(2, "partial", text, utt, none))
        .when(_action("stop"), message(2, "final", text, utt, F.lit("client_stop")))
        .when(_action("reset"), message(2, "ok", F.lit("reset"), utt, none))
    )
    replies = uttered.select(
        "session_id",
        F.explode(F.array_compact(F.array(ready, silent, answer))).alias("m"),
    ).select("session_id", "m.*")
    if every_us is None:
        return replies
    partials = (
        timed_emits(uttered, every_us)
        .where(~_action("stop", "reset"))
        .select("session_id", message(3, "partial", text, none, none).alias("m"))
        .select("session_id", "m.*")
    )
    return replies.unionByName(partials)


def verify_checks(
    actions: DataFrame,
    window_samples: int,
    min_samples: int,
    gap_us: int,
    coalesce_us: int | None = None,
    slice_rows: int = SLICE_ROWS,
) -> DataFrame:
    """Every answer of the verification sessions, with the buffer it sees: ready, partial, final, error.

    New audio asks for a partial (with ``coalesce_us`` once per tick of that length: by its last frame, or the
    last before a row that is no audio), flush asks for one, stop or a silence of the gap gives the final
    and closes the session: later rows are not read. Rows of any other action are answered as
    errors, with ``error_code`` as reason if there is such a column. ``enough`` is the minimum-audio gate;
    below it the answer is an empty result. A silence final carries its deadline and no seq.
    """
    known = F.when(_action("audio", "flush", "stop"), F.col("action")).otherwise(F.lit("error"))
    code = F.col("error_code") if "error_code" in actions.columns else F.lit(None)
    rows = actions.select(
        "session_id",
        *ORDER,
        known.alias("action"),
        F.when(_action("audio"), F.col("n_samples")).otherwise(F.lit(0)).cast("bigint").alias("n_samples"),
        F.when(known == "error", F.coalesce(code.cast("string"), F.lit("unknown_event"))).alias("error_code"),
    )
    flagged = inactivity_flags(rows, gap_us, slice_rows)
    summed = running(
        flagged,
        ["session_id"],
        "_slice",
        ORDER,
        [
            Running("_sum", "sum", _samples()),
            Running("_rows", "sum", F.lit(1)),
            Running(
                "_closed", "max", (_action("stop") | F.col("silence_final")).cast("int"), False
            ),
        ],
    )
    read = summed.where(F.coalesce(F.col("_closed"), F.lit(0)) == 0)
    answered = F.lit(True)
    if coalesce_us is not None:
        read = following(
            read, ["session_id"], "_slice", ORDER, ["ts_us", "action", "silence_final"], "_next"
        )
        tick = F.lit(coalesce_us)
        answered = ~F.coalesce(
            _action("audio")
            & (F.col("_next.action") == "audio")
            & ~F.col("_next.silence_final")
            & (F.floor(F.col("_next.ts_us") / tick) == F.floor(F.col("ts_us") / tick)),
            F.lit(False),
        )
    silent, error = F.col("silence_final"), _action("error")
    total = F.when(silent, F.col("_sum") - _samples()).otherwise(F.col("_sum"))
    length = F.least(F.lit(window_samples).cast("bigint"), total)
    none = F.lit(None)

    def answer(kind: Column, reason: Column, seen: Column, enough: Column, ts=F.col("ts_us"), seq=F.col("seq")) -> Column:
        return F.struct(
            ts.alias("ts_us"),
            seq.alias("seq"),
            kind.alias("type"),
            reason.cast("string").alias("reason"),
            seen.cast("bigint").alias("buffer_len"),
            enough.alias("enough"),
        )

    gate = length >= min_samples
    ready = F.when(F.col("_rows") == 1, answer(F.lit("ready"), none, F.lit(0), F.lit(False)))
    said = (
        F.when(
            silent,
            answer(F.lit("final"), F.lit("inactivity"), length, gate, F.col("silence_due"), none.cast("bigint")),
        )
        .when(error, answer(F.lit("error"), F.col("error_code"), length, F.lit(False)))
        .when(_action("stop"), answer(F.lit("final"), F.lit("client_stop"), length, gate))
        .when(answered, answer(F.lit("partial"), none, length, gate))
    )
    return read.select(
        "session_id", F.explode(F.array_compact(F.array(ready, said))).alias("m")
    ).select("session_id", "m.*")
