"""Streaming queries: the events become audio and control frames, run through the live session
operators and are compared with the batch replay in SQL."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.plans.registered import query
from sonaria.plans.session_queries import (
    ASR_MESSAGES,
    COALESCE_HOURS,
    EMIT_HOURS,
    GAP_HOURS,
    HOUR_US,
    VERIFY_CHECKS,
    WINDOW,
)
from sonaria.session import scratch_path, table
from sonaria.streaming import jobs
from sonaria.streaming.processors import SessionParams

# Frames carry one sample per hundred of the replay, so that payloads stay small.
SCALE = 100
# Frames arrive in so many files, one per micro-batch, up to so many hours out of order.
FILES = 5
JITTER_HOURS = 48
ORDERED = timedelta(hours=JITTER_HOURS + 1)


def frames_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    audio = kind.isin("view", "click")
    event = F.when(kind == "purchase", "flush").when(kind == "signup", "stop").otherwise("reset")
    body = F.to_json(F.struct(event.alias("event"), F.get_json_object("props", "$.k").alias("utt_id")))
    silence = F.unhex(F.repeat(F.lit("0000"), F.floor("value").cast("int")))
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("session_id"),
        F.col("event_id").alias("seq"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.when(audio, "audio").otherwise("control").alias("kind"),
        F.when(audio, silence).alias("payload"),
        F.when(~audio, body).alias("body"),
        F.lit(16000).alias("sample_rate"),
        F.lit(1).alias("channels"),
    )


def arrived_frames(spark: SparkSession, sf_dir: str, until_hours: int) -> str:
    """Frame files in order of arrival, then a clock frame so many hours after the last of them."""
    path = scratch_path(spark, "frames")
    us = F.unix_micros("ts")
    late = F.col("seq") * 7919 % JITTER_HOURS * HOUR_US
    frames = frames_of(spark, sf_dir)
    low, high, last = frames.agg(F.min(us), F.max(us), F.max("ts")).first()
    width = (high - low + JITTER_HOURS * HOUR_US) // FILES + 1
    placed = frames.withColumn("_file", F.floor((us + late - low) / width))
    for i in range(FILES):
        placed.where(F.col("_file") == i).drop("_file").coalesce(1).write.mode("append").parquet(path)
    jobs.write_clock(spark, path, F.lit(last) + F.make_interval(hours=F.lit(until_hours)))
    return path


UNIT_VALUES = ("CAST(floor(value * 100) AS BIGINT)", "CAST(floor(value) AS BIGINT)")
SMALL_WINDOW = (f"least({WINDOW},", f"least({WINDOW // SCALE},")
GAP = GAP_HOURS * HOUR_US
PAST_ALL = 2 * GAP_HOURS + 2 * JITTER_HOURS

ASR_STREAM = ASR_MESSAGES + f"""
UNION ALL
SELECT session_id, active + {GAP}, NULL, 1, 'final', CASE WHEN ended THEN '' ELSE text END, NULL, 'inactivity'
FROM (
  SELECT session_id, us, text, action IN ('stop', 'reset') AS ended,
         CASE WHEN action IN ('audio', 'stop', 'reset') OR active IS NULL THEN us ELSE active END AS active,
         row_number() OVER (PARTITION BY session_id ORDER BY us DESC, seq DESC) AS n
  FROM texts)
WHERE n = 1 AND us < active + {GAP}"""


@query("asr_stream", ASR_STREAM.replace(*UNIT_VALUES).replace(*SMALL_WINDOW))
def asr_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events in five files out of order, one per micro-batch; sessions that fall silent at the
    end are closed by timers."""
    params = SessionParams(
        window_samples=WINDOW // SCALE, emit_us=EMIT_HOURS * HOUR_US, gap_us=GAP, keep_us=None
    )
    frames = jobs.read_frames(spark, arrived_frames(spark, sf_dir, PAST_ALL), files_per_trigger=1)
    out = jobs.run_to_end(jobs.asr_messages(frames, params, delay=ORDERED), "asr-stream")
    return out.select(
        F.col("session_id").cast("bigint").alias("session_id"),
        "ts_us", "seq", "step", "type", "text", "utt_id", "reason",
    )


VERIFY_STREAM = VERIFY_CHECKS + f"""
UNION ALL
SELECT session_id, active + {GAP}, NULL, 'final', 'inactivity', CAST(len AS BIGINT), len >= 4800
FROM (
  SELECT session_id, len, bool_or(silent OR action = 'stop') OVER whole AS ended,
         coalesce(max(CASE WHEN action = 'audio' THEN us END) OVER whole, min(us) OVER whole) AS active,
         row_number() OVER (PARTITION BY session_id ORDER BY us DESC, seq DESC) AS n
  FROM read
  WINDOW whole AS (PARTITION BY session_id))
WHERE n = 1 AND NOT ended"""


@query(
    "verify_stream",
    VERIFY_STREAM.replace(*UNIT_VALUES).replace(*SMALL_WINDOW).replace(">= 4800", ">= 48"),
)
def verify_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``asr_stream``: ready, partial, final and error rows of verification sessions."""
    params = SessionParams(
        window_samples=WINDOW // SCALE,
        gap_us=GAP,
        min_samples=48,
        coalesce_us=COALESCE_HOURS * HOUR_US,
        keep_us=None,
    )
    frames = jobs.read_frames(spark, arrived_frames(spark, sf_dir, PAST_ALL), files_per_trigger=1)
    out = jobs.run_to_end(jobs.verify_checks(frames, params, delay=ORDERED), "verify-stream")
    return out.select(
        F.col("session_id").cast("bigint").alias("session_id"), "ts_us", "seq", "type", "reason", "buffer_len", "enough"
    )


IMPATIENT_HOURS = 12


@query(
    "late_frames",
    f"""
WITH bounds AS (
  SELECT min(epoch_us(ts)) AS low, (max(epoch_us(ts)) - min(epoch_us(ts)) + {JITTER_HOURS * HOUR_US}) // {FILES} + 1 AS width
  FROM events),
placed AS (
  SELECT *, epoch_us(ts) AS us,
         (epoch_us(ts) + event_id * 7919 % {JITTER_HOURS} * {HOUR_US} - low) // width AS file
  FROM events, bounds),
clocks AS (
  SELECT f.file, (SELECT max(us) FROM placed p WHERE p.file < f.file) // 1000 * 1000 AS clock
  FROM (SELECT DISTINCT file FROM placed) f)
SELECT user_id AS session_id, us AS ts_us, event_id AS seq,
       CASE WHEN event_type IN ('view', 'click') THEN 'audio' WHEN event_type = 'purchase' THEN 'flush'
            WHEN event_type = 'signup' THEN 'stop' ELSE 'reset' END AS action,
       CASE WHEN event_type NOT IN ('view', 'click') THEN json_extract_string(props, '$.k') END AS utt_id,
       CASE WHEN event_type IN ('view', 'click') THEN 2 * CAST(floor(value) AS BIGINT) END AS n_bytes
FROM placed JOIN clocks USING (file)
WHERE us < clock - {IMPATIENT_HOURS * HOUR_US}""",
)
def late_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that come after their turn, where sessions wait a quarter of the disorder."""
    params = SessionParams(window_samples=WINDOW // SCALE, keep_us=None)
    frames = jobs.read_frames(spark, arrived_frames(spark, sf_dir, PAST_ALL), files_per_trigger=1)
    said = jobs.asr_messages(
        frames, params, delay=timedelta(hours=IMPATIENT_HOURS), grace=timedelta(hours=2 * JITTER_HOURS)
    )
    return jobs.late_frames(jobs.run_to_end(said, "late-frames")).select(
        F.col("session_id").cast("bigint").alias("session_id"),
        "ts_us", "seq", "action", "utt_id", F.octet_length("payload").cast("bigint").alias("n_bytes"),
    )


@query(
    "corpus_increment",
    """
WITH lines AS (
  SELECT unnest(string_split(source || '/' || n_chars || '.WAV|' || text, chr(10))) AS line
  FROM documents WHERE n_chars % 13 NOT IN (0, 1, 2)
  UNION ALL
  SELECT source || '/' || n_chars || '.WAV|' FROM documents WHERE n_chars % 13 = 2)
SELECT sha1(line) AS line_sha1, count(*) AS n FROM lines GROUP BY 1""",
)
def corpus_increment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arrivals of split files, two runs on one checkpoint; every row is written once."""
    from sonaria.plans.dataset_queries import split_rows

    source, out, checkpoint = (scratch_path(spark, n) for n in ("arrivals", "corpus", "corpus-checkpoint"))
    rows = split_rows(spark, sf_dir)
    clips = rows.select("path")
    for late in (False, True):
        part = rows.where((F.col("file_rank") >= 3) == F.lit(late)).select("path", "sentence")
        part.write.mode("append").parquet(source)
        run = jobs.start_corpus_increment(
            spark, source, "path string, sentence string", clips, out, checkpoint
        )
        run.awaitTermination()
    return spark.read.text(out).groupBy(F.sha1("value").alias("line_sha1")).agg(F.count(F.lit(1)).alias("n"))
