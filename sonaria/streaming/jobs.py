"""Streaming jobs: frames in, messages out; matching against a live registry; corpus increments."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from sonaria.constants import MATCH_THRESHOLD, TOP_K
from sonaria.functions import messages, text
from sonaria.functions.clock import epoch_micros
from sonaria.operators import matching
from sonaria.session import materialise, scratch_path, ship_package
from sonaria.slots import base, builtin, jobs
from sonaria.slots.base import Slot
from sonaria.sources.sinks import append_raw_metadata
from sonaria.streaming.processors import PACKED, AsrProcessor, SessionParams, VerifyProcessor, unpack

FRAME_SCHEMA = (
    "session_id string, seq long, ts timestamp, kind string, payload binary, body string, "
    "sample_rate int, channels int"
)
#: How long rows wait for earlier ones, and how long after that they are still told as late.
DELAY, GRACE = timedelta(seconds=10), timedelta(hours=1)
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_partitions(spark: SparkSession, count: int | None) -> Iterator[None]:
    """Partitions of a stream's state, fixed by its first start: by default one wave of tasks.

    The stream copies the setting when it starts; the session gets its own back.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(count or spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def read_frames(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    """Frame files as a stream; the trigger bound also bounds a session's rows per micro-batch.
    Messages do not depend on it, what comes too late for its turn does."""
    return (
        spark.readStream.schema(FRAME_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .parquet(path)
    )


def write_clock(spark: SparkSession, path: str, ts: Column) -> None:
    """Adds a frame that belongs to no session and only moves the time of the stream: the end of an
    input, or a sign of life while all sessions are silent."""
    row = spark.range(1).select(
        F.lit("").alias("session_id"),
        F.lit(None).cast("long").alias("seq"),
        ts.cast("timestamp").alias("ts"),
        F.lit("clock").alias("kind"),
        F.lit(None).cast("binary").alias("payload"),
        F.lit(None).cast("string").alias("body"),
        F.lit(None).cast("int").alias("sample_rate"),
        F.lit(None).cast("int").alias("channels"),
    )
    row.coalesce(1).write.mode("append").parquet(path)


def _actions(frames: DataFrame, accepts_reset: bool, behind: timedelta) -> DataFrame:
    checked = messages.classify(frames, accepts_reset).withColumn("ts_us", epoch_micros(frames, "ts"))
    action = F.when(F.col("kind") == "clock", F.lit("clock")).otherwise(F.col("action"))
    return (
        checked.withColumn("action", action)
        .withWatermark("ts", f"{_micros(behind) // 1000} milliseconds")
        .select(
            "session_id", "ts", "ts_us", "seq", "action", "utt_id", "payload", "sample_rate", "channels",
            "error_code", "error_detail",
        )
    )


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _stateful(frames: DataFrame, accepts_reset: bool, processor, delay: timedelta, grace: timedelta) -> DataFrame:
    spark = frames.sparkSession
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    processor.grace_us = _micros(grace)
    actions = _actions(frames, accepts_reset, delay + grace)
    said = actions.groupBy("session_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=PACKED, outputMode="Append", timeMode="EventTime"
    )
    schema = to_arrow_schema(StructType.fromDDL(processor.schema))
    return said.mapInArrow(unpack(schema), processor.schema)


def asr_messages(
    frames: DataFrame,
    params: SessionParams,
    slot: Slot = builtin.TRANSCRIBE,
    delay: timedelta = DELAY,
    grace: timedelta = GRACE,
) -> DataFrame:
    """Messages of recognition sessions.

    Rows are applied in order ``delay`` behind the newest; rows that come later than that are told
    as ``late`` messages, rows later by another ``grace`` are dropped by Spark and show up in the
    query progress. The recogniser runs behind the state, on the buffers of many sessions in one
    call; a failure ends a final with an empty text and turns a partial into an error.
    """
    said = _stateful(frames, True, AsrProcessor(params), delay, grace)
    sound = F.when(F.size("samples") > 0, F.col("samples"))
    ran = base.apply(said, slot, [sound, F.lit(params.language)], "raw")
    heard = F.when(F.col("raw").isNotNull(), text.strip(F.coalesce("raw.text", F.lit(""))))
    failed = F.col("error").isNotNull()
    partial = failed & (F.col("type") == "partial")
    wanted = F.col("samples").isNotNull()
    return ran.select(
        "session_id",
        "ts_us",
        "seq",
        "step",
        F.when(partial, "error").otherwise(F.col("type")).alias("type"),
        F.when(partial, F.lit(None)).when(wanted, F.coalesce(heard, F.lit(""))).otherwise(F.col("text")).alias("text"),
        "utt_id",
        F.when(partial, "model_failed").otherwise(F.col("reason")).alias("reason"),
        F.when(partial, F.col("error")).otherwise(F.col("detail")).alias("detail"),
        "late",
    )


def verify_checks(
    frames: DataFrame, params: SessionParams, delay: timedelta = DELAY, grace: timedelta = GRACE
) -> DataFrame:
    """Checks, ready, error and late rows of verification sessions, in the order of ``asr_messages``."""
    return _stateful(frames, False, VerifyProcessor(params), delay, grace)


def late_frames(said: DataFrame) -> DataFrame:
    """The late rows among the messages of either kind of session, with all they carried."""
    return said.where("type = 'late'").select("session_id", "ts_us", "seq", "late.*")


def match_checks(
    checks: DataFrame,
    registry: DataFrame,
    threshold: float = MATCH_THRESHOLD,
    top_k: int = TOP_K,
    embed: Slot = builtin.EMBED,
    denoise: Slot | None = builtin.DENOISE,
) -> DataFrame:
    """Decision messages for the checks of one micro-batch; too little audio, an unusable signal
    or an empty registry give an empty result of the same shape."""
    keyed = checks.where(F.col("type").isin("partial", "final")).withColumn(
        "probe_id", F.concat_ws("/", "session_id", "type", "ts_us", F.coalesce("seq", F.lit(-1)))
    ).drop("late")
    sound = keyed.where("enough").select("probe_id", "samples")
    if denoise is not None:
        sound = jobs.denoise(sound, denoise).drop("error")
    probes = jobs.embed(sound, embed).select("probe_id", "embedding")
    matched = matching.top_matches(probes, registry, top_k)
    full = keyed.drop("samples").join(matched, "probe_id", "left").withColumn(
        "matches", F.coalesce("matches", F.array().cast(matching.MATCH_TYPE))
    )
    return matching.decide(full, threshold).drop("probe_id")


def asr_json(said: DataFrame) -> DataFrame:
    """session_id, ts_us, seq, message: nulls are left out of the JSON text."""
    body = messages.transcript_json("type", "text", "utt_id", "reason", "detail")
    return said.select("session_id", "ts_us", "seq", body.alias("message"))


def verify_json(decided: DataFrame) -> DataFrame:
    """Decisions as stamped JSON text; a missing best match is written as null."""
    timed = messages.stamp(decided).withColumn("ts_ms", messages.stamp_time(F.col("ts_us")))
    body = messages.verify_json(
        "type", "decision", "threshold", "best", "matches", "reason", "session_id", "version", "ts_ms"
    )
    return timed.select("session_id", "ts_us", "seq", body.alias("message"))


def start_matching(
    checks: DataFrame,
    registry: Callable[[SparkSession], DataFrame],
    out: str,
    checkpoint: str,
    partitions: int | None = None,
    **options,
) -> StreamingQuery:
    """Writes one decision per check, and ready and error rows without one. ``registry`` is called for every micro-batch, so enrolments
    made meanwhile count for sessions that are already live."""

    def write(batch: DataFrame, batch_id: int) -> None:
        # The stateful stage runs once: both branches read the checks it wrote.
        checked = materialise(batch, "checks")
        decided = match_checks(checked, registry(batch.sparkSession), **options)
        told = checked.where(~F.col("type").isin("partial", "final")).drop("samples")
        told = told.withColumn("matches", F.array().cast(matching.MATCH_TYPE))
        decided = decided.unionByName(told, allowMissingColumns=True)
        # The folder of a batch is replaced when the batch is repeated after a failure.
        decided.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    with _state_partitions(checks.sparkSession, partitions):
        return (
            checks.writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


def start_writing(
    stream: DataFrame, out: str, checkpoint: str, partitions: int | None = None
) -> StreamingQuery:
    with _state_partitions(stream.sparkSession, partitions):
        return (
            stream.writeStream.format("parquet")
            .option("path", out)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(availableNow=True)
            .start()
        )


def run_to_end(stream: DataFrame, label: str) -> DataFrame:
    """Runs over all data there is and returns what was written."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, label), scratch_path(spark, f"{label}-checkpoint")
    query = start_writing(stream, out, checkpoint)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def start_corpus_increment(
    spark: SparkSession,
    source: str,
    schema: str,
    clips: DataFrame,
    out: str,
    checkpoint: str,
    fmt: str = "parquet",
    **options: str,
) -> StreamingQuery:
    """Incremental corpus build: only files that came since the last run are read.

    The checkpoint holds the progress, so a stopped run goes on where it was; each input row is
    filtered, stripped and appended once.
    """
    rows = spark.readStream.format(fmt).schema(schema).options(**options).load(source)
    filled = rows.where(F.col("sentence").isNotNull() & (F.col("sentence") != ""))
    kept = filled.join(clips.select("path").distinct(), "path", "left_semi").select(
        F.col("path").alias("file"), text.strip(F.col("sentence")).alias("text")
    )

    def write(batch: DataFrame, batch_id: int) -> None:
        # A batch repeated after a failure replaces its folder, so no row is there twice.
        append_raw_metadata(batch, f"{out}/batch={batch_id}", mode="overwrite")

    return (
        kept.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
