"""Control-frame checks and JSON messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.constants import MAX_TOP_K, MESSAGE_VERSION
from sonaria.functions.clock import to_millis
from sonaria.functions.text import strip

CONTROL_SCHEMA = "event string, utt_id string"


def is_json_object(body: Column) -> Column:
    """Control frames are JSON objects; anything else is refused, never raised."""
    parsed = F.try_parse_json(body)
    return F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False))


def control_fields(body: Column) -> Column:
    """struct<event, utt_id>; null fields for a missing key or broken JSON."""
    return F.from_json(body, CONTROL_SCHEMA)


def bytes_per_frame(channels: Column) -> Column:
    return channels * 2


def playable(frames: DataFrame) -> Column:
    """An audio frame needs a payload, a channel count and, where frames have one, a sample rate."""
    sound = F.col("payload").isNotNull() & (F.col("channels") > 0)
    if "sample_rate" in frames.columns:
        sound = sound & (F.col("sample_rate") > 0)
    return F.coalesce(sound, F.lit(False))


def misaligned(payload: Column, channels: Column) -> Column:
    return F.pmod(F.octet_length(payload), bytes_per_frame(channels)) != 0


def classify(frames: DataFrame, accepts_reset: bool = True) -> DataFrame:
    """Adds action, utt_id, error_code and error_detail (JSON) to raw frames.

    ``frames``: kind audio/control/other, payload, body, channels. Only recognition sockets know
    reset. The frame of an error row is dropped by the sessions, which go on.
    """
    events = ("flush", "stop", "reset") if accepts_reset else ("flush", "stop")
    audio = F.col("kind") == "audio"
    control = F.col("kind") == "control"
    parsed = frames.withColumn("_c", control_fields(F.col("body"))).withColumn(
        "_ok", is_json_object(F.col("body"))
    )
    code = (
        F.when(audio & ~playable(frames), "ingest_failed")
        .when(audio & misaligned(F.col("payload"), F.col("channels")), "bad_frame_size")
        .when(control & ~F.col("_ok"), "bad_json")
        .when(
            control & F.coalesce(~F.col("_c.event").isin(*events), F.lit(True)), "unknown_event"
        )
        .when(~F.coalesce(audio | control, F.lit(False)), "unsupported_frame")
    )
    frame_detail = F.to_json(
        F.struct(
            F.octet_length("payload").alias("got_bytes"),
            bytes_per_frame(F.col("channels")).alias("bytes_per_frame"),
        )
    )
    return (
        parsed.withColumn("error_code", code)
        .withColumn(
            "error_detail",
            F.when(F.col("error_code") == "bad_frame_size", frame_detail).when(
                F.col("error_code") == "unknown_event", F.col("_c.event")
            ),
        )
        .withColumn(
            "action",
            F.when(F.col("error_code").isNotNull(), "error")
            .when(audio, "audio")
            .otherwise(F.col("_c.event")),
        )
        .withColumn("utt_id", F.when(control, F.col("_c.utt_id")))
        .drop("_c", "_ok")
    )


def stamp(body: DataFrame) -> DataFrame:
    """Session metadata on every message; values already set are kept."""
    out = body
    if "version" in body.columns:
        out = out.withColumn("version", F.coalesce("version", F.lit(MESSAGE_VERSION)))
    else:
        out = out.withColumn("version", F.lit(MESSAGE_VERSION))
    return out


def stamp_time(ts_us: Column, ts_ms: Column | None = None) -> Column:
    now = to_millis(ts_us)
    return now if ts_ms is None else F.coalesce(ts_ms, now)


def verify_json(*columns) -> Column:
    """Nulls are written: a missing ``best`` is part of the answer."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def transcript_json(*columns) -> Column:
    """Nulls are left out."""
    return F.to_json(F.struct(*columns))


def strict_number(text: Column) -> Column:
    """Number of a trimmed text; null for blank or non-finite input, which switches a value off."""
    value = strip(text).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def _outside(value: Column, low: float, high: float) -> Column:
    return ~F.coalesce(value.between(low, high), F.lit(False))


def parameter_errors(
    sample_rate: Column,
    channels: Column,
    top_k: Column,
    threshold: Column,
    emit_ms: Column,
    window_sec: Column,
    emit_sec: Column,
    inactivity_sec: Column,
    language: Column,
) -> Column:
    """Names of the parameters out of range, in a fixed order; empty for an accepted request."""

    def positive(value: Column) -> Column:
        return F.coalesce(value > 0, F.lit(False))

    return F.array_compact(
        F.array(
            F.when(_outside(sample_rate, 8000, 48000), "sample_rate"),
            F.when(_outside(channels, 1, 2), "channels"),
            F.when(_outside(top_k, 1, MAX_TOP_K), "top_k"),
            F.when(_outside(threshold, 0, 1), "sim_threshold"),
            F.when(_outside(emit_ms, 50, 5000), "emit_interval_ms"),
            F.when(~positive(window_sec), "window_sec"),
            F.when(~positive(emit_sec), "emit_sec"),
            F.when(inactivity_sec.isNotNull() & ~positive(inactivity_sec), "inactivity_sec"),
            F.when(_outside(F.length(language), 1, 16), "language"),
        )
    )
