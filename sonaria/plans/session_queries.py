"""Session replay over ``events``: a user is a session, views and clicks are audio frames,
purchases flush, signups stop, errors reset."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.functions import messages
from sonaria.functions.clock import epoch_micros
from sonaria.operators import sessions
from sonaria.plans.registered import query
from sonaria.session import materialise, table

WINDOW = 10_000
STEP_SAMPLES = 20_000
HOUR_US = 3_600_000_000
GAP_HOURS = 24
EMIT_HOURS = 6


def actions_of(events: DataFrame) -> DataFrame:
    kind = F.col("event_type")
    audio = kind.isin("view", "click")
    return events.select(
        F.col("user_id").alias("session_id"),
        epoch_micros(events, "ts").alias("ts_us"),
        F.col("event_id").alias("seq"),
        F.when(audio, "audio")
        .when(kind == "purchase", "flush")
        .when(kind == "signup", "stop")
        .otherwise("reset")
        .alias("action"),
        F.when(audio, F.floor(F.col("value") * 100)).otherwise(0).cast("bigint").alias("n_samples"),
        F.when(~audio, F.get_json_object("props", "$.k")).alias("utt_id"),
    )


def session_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions_of(table(spark, sf_dir, "events"))


ACTIONS = """
actions AS (
  SELECT user_id AS session_id, ts, event_id AS seq,
         CASE WHEN event_type IN ('view', 'click') THEN 'audio' WHEN event_type = 'purchase' THEN 'flush'
              WHEN event_type = 'signup' THEN 'stop' ELSE 'reset' END AS action,
         CASE WHEN event_type IN ('view', 'click') THEN CAST(floor(value * 100) AS BIGINT) ELSE 0 END
           AS n_samples,
         CASE WHEN event_type NOT IN ('view', 'click') THEN json_extract_string(props, '$.k') END
           AS utt_id
  FROM events)"""

EPOCHS = (
    ACTIONS
    + """,
uttered AS (
  SELECT *, coalesce(sum(CASE WHEN action IN ('stop', 'reset') THEN 1 ELSE 0 END) OVER (
              PARTITION BY session_id ORDER BY ts, seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS epoch
  FROM actions),
folded AS (
  SELECT *, sum(n_samples) OVER (PARTITION BY session_id, epoch ORDER BY ts, seq
                                 ROWS UNBOUNDED PRECEDING) AS total
  FROM uttered)"""
)


@query(
    "session_buffers",
    f"""
WITH {EPOCHS}
SELECT session_id, seq, CAST(epoch AS BIGINT) AS epoch,
       CAST(least({WINDOW}, total) AS BIGINT) AS buffer_len
FROM folded""",
)
def session_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.utterances(session_actions(spark, sf_dir), WINDOW).select(
        "session_id", "seq", "epoch", "buffer_len"
    )


@query(
    "session_retention",
    f"""
WITH {EPOCHS},
ends AS (SELECT *, sum(n_samples) OVER (PARTITION BY session_id, epoch) - total AS after FROM folded)
SELECT session_id, seq, CAST(epoch AS BIGINT) AS epoch,
       CAST(least(n_samples, {WINDOW} - after) AS BIGINT) AS kept
FROM ends WHERE action = 'audio' AND n_samples > 0 AND after < {WINDOW}""",
)
def session_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    uttered = sessions.utterances(session_actions(spark, sf_dir), WINDOW)
    return sessions.retained(uttered, WINDOW).select("session_id", "seq", "epoch", "kept")


@query(
    "count_emits",
    f"""
WITH RECURSIVE {ACTIONS},
a AS (
  SELECT session_id, seq, n_samples AS n,
         row_number() OVER (PARTITION BY session_id ORDER BY ts, seq) AS rn,
         sum(n_samples) OVER (PARTITION BY session_id ORDER BY ts, seq
                              ROWS UNBOUNDED PRECEDING) AS seen
  FROM actions WHERE action = 'audio'),
fold AS (
  SELECT session_id, rn, seq, seen, n >= {STEP_SAMPLES} AS emit,
         CASE WHEN n >= {STEP_SAMPLES} THEN 0 ELSE n END AS acc
  FROM a WHERE rn = 1
  UNION ALL
  SELECT a.session_id, a.rn, a.seq, a.seen, f.acc + a.n >= {STEP_SAMPLES},
         CASE WHEN f.acc + a.n >= {STEP_SAMPLES} THEN 0 ELSE f.acc + a.n END
  FROM fold f JOIN a ON a.session_id = f.session_id AND a.rn = f.rn + 1)
SELECT session_id, seq, CAST(seen AS BIGINT) AS samples_seen FROM fold WHERE emit""",
)
def count_emits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.count_emits(session_actions(spark, sf_dir), STEP_SAMPLES).select(
        "session_id", "seq", "samples_seen"
    )


@query(
    "timed_emits",
    f"""
WITH RECURSIVE {EPOCHS},
a AS (
  SELECT session_id, epoch, seq, epoch_us(ts) AS us,
         row_number() OVER (PARTITION BY session_id, epoch ORDER BY ts, seq) AS rn
  FROM folded),
fold AS (
  SELECT session_id, epoch, rn, seq, us, TRUE AS emit, us AS last FROM a WHERE rn = 1
  UNION ALL
  SELECT a.session_id, a.epoch, a.rn, a.seq, a.us, a.us - f.last >= {EMIT_HOURS * HOUR_US},
         CASE WHEN a.us - f.last >= {EMIT_HOURS * HOUR_US} THEN a.us ELSE f.last END
  FROM fold f JOIN a ON a.session_id = f.session_id AND a.epoch = f.epoch AND a.rn = f.rn + 1)
SELECT session_id, CAST(epoch AS BIGINT) AS epoch, seq, us AS ts_us FROM fold WHERE emit""",
)
def timed_emits(spark: SparkSession, sf_dir: str) -> DataFrame:
    uttered = materialise(sessions.utterances(session_actions(spark, sf_dir), WINDOW), "utterances")
    return sessions.timed_emits(uttered, EMIT_HOURS * HOUR_US).select(
        "session_id", "epoch", "seq", "ts_us"
    )


SILENT = (
    ACTIONS
    + f""",
seen AS (
  SELECT *, epoch_us(ts) AS us,
         coalesce(max(CASE WHEN action IN ('audio', 'stop', 'reset') THEN epoch_us(ts) END) OVER before,
                  min(epoch_us(ts)) OVER before) AS active,
         max(epoch_us(ts)) OVER before AS prev,
         lag(action) OVER (PARTITION BY session_id ORDER BY ts, seq) AS prev_action
  FROM actions
  WINDOW before AS (PARTITION BY session_id ORDER BY ts, seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
flagged AS (
  SELECT *, coalesce(us - active >= {GAP_HOURS * HOUR_US} AND prev - active < {GAP_HOURS * HOUR_US},
                     FALSE) AS silent
  FROM seen),
uttered AS (
  SELECT *, coalesce(sum(CASE WHEN action IN ('stop', 'reset') THEN 1 ELSE 0 END) OVER (
              PARTITION BY session_id ORDER BY ts, seq
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            + sum(CASE WHEN silent THEN 1 ELSE 0 END) OVER (
              PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS epoch
  FROM flagged),
folded AS (
  SELECT *, least({WINDOW}, sum(n_samples) OVER (PARTITION BY session_id, epoch ORDER BY ts, seq
                                                 ROWS UNBOUNDED PRECEDING)) AS len
  FROM uttered),
closed AS (
  SELECT *, CASE WHEN prev_action IN ('stop', 'reset') THEN 0
                 ELSE lag(len) OVER (PARTITION BY session_id ORDER BY ts, seq) END AS closed_len
  FROM folded)"""
)


@query(
    "inactivity_splits",
    f"""
WITH {SILENT}
SELECT session_id, seq, CAST(epoch AS BIGINT) AS epoch, silent AS silence_final,
       CAST(CASE WHEN silent THEN closed_len END AS BIGINT) AS closed_len,
       CAST(len AS BIGINT) AS buffer_len
FROM closed""",
)
def inactivity_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    uttered = sessions.utterances(
        session_actions(spark, sf_dir), WINDOW, gap_us=GAP_HOURS * HOUR_US
    )
    return uttered.select(
        "session_id", "seq", "epoch", "silence_final", "closed_len", "buffer_len"
    )


ASR_MESSAGES = f"""
WITH RECURSIVE {SILENT},
numbered AS (
  SELECT session_id, epoch, seq, us, row_number() OVER (PARTITION BY session_id, epoch
                                                        ORDER BY us, seq) AS rn
  FROM closed),
fold AS (
  SELECT session_id, epoch, rn, seq, us, TRUE AS emit, us AS last FROM numbered WHERE rn = 1
  UNION ALL
  SELECT a.session_id, a.epoch, a.rn, a.seq, a.us, a.us - f.last >= {EMIT_HOURS * HOUR_US},
         CASE WHEN a.us - f.last >= {EMIT_HOURS * HOUR_US} THEN a.us ELSE f.last END
  FROM fold f JOIN numbered a
    ON a.session_id = f.session_id AND a.epoch = f.epoch AND a.rn = f.rn + 1),
texts AS (
  SELECT *, CASE WHEN len > 0 THEN 'len=' || CAST(len AS BIGINT) ELSE '' END AS text,
         CASE WHEN closed_len > 0 THEN 'len=' || CAST(closed_len AS BIGINT) ELSE '' END AS closed_text
  FROM closed)
SELECT session_id, us AS ts_us, seq, 0 AS step, 'ready' AS type, NULL AS text, NULL AS utt_id,
       NULL AS reason
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY us, seq) AS n FROM texts)
WHERE n = 1
UNION ALL
SELECT session_id, active + {GAP_HOURS * HOUR_US}, NULL, 1, 'final', closed_text, NULL, 'inactivity' FROM texts WHERE silent
UNION ALL
SELECT session_id, us, seq, 2,
       CASE action WHEN 'flush' THEN 'partial' WHEN 'stop' THEN 'final' ELSE 'ok' END,
       CASE action WHEN 'reset' THEN 'reset' ELSE text END, utt_id,
       CASE action WHEN 'stop' THEN 'client_stop' END
FROM texts WHERE action <> 'audio'
UNION ALL
SELECT t.session_id, t.us, t.seq, 3, 'partial', t.text, NULL, NULL
FROM texts t JOIN fold f ON f.session_id = t.session_id AND f.seq = t.seq AND f.emit
WHERE t.action NOT IN ('stop', 'reset')"""


@query("asr_replay", ASR_MESSAGES)
def asr_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.asr_messages(
        session_actions(spark, sf_dir),
        WINDOW,
        gap_us=GAP_HOURS * HOUR_US,
        every_us=EMIT_HOURS * HOUR_US,
    )


COALESCE_HOURS = 12

VERIFY_ROWS = f"""
{ACTIONS},
kept AS (SELECT session_id, ts, seq, n_samples, CASE action WHEN 'reset' THEN 'error' ELSE action END AS action
         FROM actions),
seen AS (
  SELECT *, epoch_us(ts) AS us,
         coalesce(max(CASE WHEN action IN ('audio', 'stop') THEN epoch_us(ts) END) OVER before,
                  min(epoch_us(ts)) OVER before) AS active,
         sum(n_samples) OVER upto AS total, row_number() OVER upto AS place
  FROM kept
  WINDOW before AS (PARTITION BY session_id ORDER BY ts, seq
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upto AS (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING)),
flagged AS (
  SELECT *, coalesce(us - active >= {GAP_HOURS * HOUR_US}, FALSE) AS silent FROM seen),
ends AS (
  SELECT *, coalesce(bool_or(silent OR action = 'stop') OVER (
              PARTITION BY session_id ORDER BY us, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
              FALSE) AS closed
  FROM flagged),
read AS (
  SELECT *, least({WINDOW}, total - CASE WHEN silent THEN n_samples ELSE 0 END) AS len,
         lead(action = 'audio' AND NOT silent) OVER next AND action = 'audio' AND NOT silent
         AND lead(us) OVER next // {COALESCE_HOURS * HOUR_US} = us // {COALESCE_HOURS * HOUR_US} AS waits
  FROM ends WHERE NOT closed
  WINDOW next AS (PARTITION BY session_id ORDER BY us, seq))"""

VERIFY_CHECKS = f"""
WITH {VERIFY_ROWS}
SELECT session_id, us AS ts_us, seq, 'ready' AS type, NULL AS reason, 0 AS buffer_len, FALSE AS enough
FROM read WHERE place = 1
UNION ALL
SELECT session_id, CASE WHEN silent THEN active + {GAP_HOURS * HOUR_US} ELSE us END,
       CASE WHEN NOT silent THEN seq END,
       CASE WHEN silent OR action = 'stop' THEN 'final' WHEN action = 'error' THEN 'error' ELSE 'partial' END,
       CASE WHEN silent THEN 'inactivity' WHEN action = 'stop' THEN 'client_stop'
            WHEN action = 'error' THEN 'unknown_event' END,
       CAST(len AS BIGINT), len >= 4800 AND (silent OR action <> 'error')
FROM read WHERE NOT coalesce(waits, FALSE)"""


@query("verify_replay", VERIFY_CHECKS)
def verify_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.verify_checks(
        session_actions(spark, sf_dir), WINDOW, 4800, GAP_HOURS * HOUR_US, COALESCE_HOURS * HOUR_US
    )


@query(
    "frame_checks",
    """
WITH f AS (SELECT event_id, octet_length(encode(event_type || props)) AS got, 1 + event_id % 2 AS ch
           FROM events)
SELECT event_id, got % (2 * ch) <> 0 AS misaligned,
       CASE WHEN got % (2 * ch) <> 0
            THEN '{"got_bytes":' || got || ',"bytes_per_frame":' || 2 * ch || '}' END AS detail
FROM f""",
)
def frame_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "events").select(
        "event_id",
        F.lit("audio").alias("kind"),
        F.encode(F.concat("event_type", "props"), "UTF-8").alias("payload"),
        F.lit(None).cast("string").alias("body"),
        (1 + F.col("event_id") % 2).alias("channels"),
    )
    checked = messages.classify(frames)
    return checked.select(
        "event_id",
        (F.col("error_code").isNotNull()).alias("misaligned"),
        F.col("error_detail").alias("detail"),
    )


BODY_SQL = """
  CASE event_type
    WHEN 'purchase' THEN '{"event":"flush","utt_id":"' || event_id || '"}'
    WHEN 'signup' THEN '{"event": "stop"}'
    WHEN 'error' THEN '{"event":"reset","utt_id":null}'
    WHEN 'click' THEN CASE WHEN value < 20 THEN 'not a json' WHEN value < 40 THEN '{"event":' ELSE '[1]' END
    ELSE CASE WHEN value < 40 THEN '{"event":"weird"}' ELSE '{"utt_id":"7"}' END END"""


def control_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind, value = F.col("event_type"), F.col("value")
    body = (
        F.when(
            kind == "purchase",
            F.concat(F.lit('{"event":"flush","utt_id":"'), F.col("event_id").cast("string"), F.lit('"}')),
        )
        .when(kind == "signup", F.lit('{"event": "stop"}'))
        .when(kind == "error", F.lit('{"event":"reset","utt_id":null}'))
        .when(
            kind == "click",
            F.when(value < 20, "not a json").when(value < 40, '{"event":').otherwise("[1]"),
        )
        .otherwise(F.when(value < 40, '{"event":"weird"}').otherwise('{"utt_id":"7"}'))
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        F.lit("control").alias("kind"),
        F.lit(None).cast("binary").alias("payload"),
        body.alias("body"),
        F.lit(1).alias("channels"),
    )


CLASSIFIED_SQL = """
WITH b AS (SELECT event_id, {body} AS body FROM events),
j AS (SELECT *, json_valid(body) AND left(body, 1) = '{{' AS ok FROM b),
e AS (SELECT *, CASE WHEN ok THEN json_extract_string(body, '$.event') END AS event,
             CASE WHEN ok THEN json_extract_string(body, '$.utt_id') END AS utt FROM j)
SELECT event_id,
       CASE WHEN NOT ok THEN 'error' WHEN event IN ({known}) THEN event ELSE 'error' END AS action,
       CASE WHEN NOT ok THEN 'bad_json' WHEN event IN ({known}) THEN NULL ELSE 'unknown_event' END
         AS error_code,
       CASE WHEN ok AND event NOT IN ({known}) THEN event END AS error_detail,
       utt AS utt_id
FROM e"""


@query("control_frames_asr", CLASSIFIED_SQL.format(body=BODY_SQL, known="'flush', 'stop', 'reset'"))
def control_frames_asr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.classify(control_frames(spark, sf_dir)).select(
        "event_id", "action", "error_code", "error_detail", "utt_id"
    )


@query("control_frames_verify", CLASSIFIED_SQL.format(body=BODY_SQL, known="'flush', 'stop'"))
def control_frames_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages.classify(control_frames(spark, sf_dir), accepts_reset=False).select(
        "event_id", "action", "error_code", "error_detail", "utt_id"
    )


@query(
    "parameter_checks",
    """
WITH p AS (
  SELECT event_id, CAST(floor(value * 1000) AS BIGINT) AS sample_rate, event_id % 4 AS channels,
         CAST(json_extract_string(props, '$.k') AS BIGINT) AS top_k, value / 100 AS threshold,
         CAST(floor(value * 30) AS BIGINT) AS emit_ms, value - 5 AS window_sec,
         event_id % 3 AS emit_sec,
         CASE event_type WHEN 'view' THEN NULL WHEN 'click' THEN -1.5 WHEN 'error' THEN NULL
                         ELSE 2.5 END AS inactivity,
         CASE event_type WHEN 'error' THEN repeat('x', 17) WHEN 'signup' THEN '' ELSE 'ru' END AS lang
  FROM events)
SELECT event_id, concat_ws(',',
    CASE WHEN sample_rate NOT BETWEEN 8000 AND 48000 THEN 'sample_rate' END,
    CASE WHEN channels NOT BETWEEN 1 AND 2 THEN 'channels' END,
    CASE WHEN top_k NOT BETWEEN 1 AND 50 THEN 'top_k' END,
    CASE WHEN threshold NOT BETWEEN 0 AND 1 THEN 'sim_threshold' END,
    CASE WHEN emit_ms NOT BETWEEN 50 AND 5000 THEN 'emit_interval_ms' END,
    CASE WHEN window_sec <= 0 THEN 'window_sec' END,
    CASE WHEN emit_sec <= 0 THEN 'emit_sec' END,
    CASE WHEN inactivity <= 0 THEN 'inactivity_sec' END,
    CASE WHEN length(lang) NOT BETWEEN 1 AND 16 THEN 'language' END) AS errors
FROM p""",
)
def parameter_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, kind, eid = F.col("value"), F.col("event_type"), F.col("event_id")
    raw_gap = (
        F.when(kind == "view", "  ")
        .when(kind == "click", " -1.5 ")
        .when(kind == "error", "Infinity")
        .otherwise("2.5")
    )
    errors = messages.parameter_errors(
        sample_rate=F.floor(value * 1000),
        channels=eid % 4,
        top_k=F.get_json_object("props", "$.k").cast("bigint"),
        threshold=value / 100,
        emit_ms=F.floor(value * 30),
        window_sec=value - 5,
        emit_sec=eid % 3,
        inactivity_sec=messages.strict_number(raw_gap),
        language=F.when(kind == "error", F.repeat(F.lit("x"), 17))
        .when(kind == "signup", "")
        .otherwise("ru"),
    )
    return table(spark, sf_dir, "events").select("event_id", F.array_join(errors, ",").alias("errors"))


@query(
    "duration_gates",
    """
SELECT event_id, CAST(floor(value * 400) AS BIGINT) AS n_samples,
       floor(value * 400) >= 3 * (8000 + 4000 * (event_id % 3)) AS can_enrol,
       floor(value * 400) >= floor(0.3 * (8000 + 4000 * (event_id % 3))) AS can_verify
FROM events""",
)
def duration_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaria.operators.signal import long_enough

    rate = 8000 + 4000 * (F.col("event_id") % 3)
    n = F.floor(F.col("value") * 400)
    return table(spark, sf_dir, "events").select(
        "event_id",
        n.alias("n_samples"),
        long_enough(n, F.lit(3.0), rate).alias("can_enrol"),
        long_enough(n, F.lit(0.3), rate).alias("can_verify"),
    )


@query(
    "message_stamps",
    """
SELECT event_id, CASE WHEN event_type = 'view' THEN 2 ELSE 1 END AS version,
       CASE WHEN event_type = 'click' THEN 5 ELSE epoch_us(ts) // 1000 END AS ts_ms,
       '{"type":"' || event_type || '","session_id":"' || user_id || '","k":'
       || json_extract_string(props, '$.k') || '}' AS body
FROM events""",
)
def message_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn(
        "version", F.when(F.col("event_type") == "view", 2)
    )
    props = F.from_json("props", "k bigint")
    return messages.stamp(rows).select(
        "event_id",
        "version",
        messages.stamp_time(epoch_micros(rows, "ts"), F.when(F.col("event_type") == "click", F.lit(5).cast("bigint"))).alias(
            "ts_ms"
        ),
        messages.transcript_json(
            F.col("event_type").alias("type"),
            F.col("user_id").cast("string").alias("session_id"),
            props["k"].alias("k"),
            F.lit(None).cast("string").alias("best"),
        ).alias("body"),
    )


@query(
    "session_run_report",
    """
SELECT user_id AS session_id, count(*) AS n_rows,
       CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS n_ok,
       CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS n_bad,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 / 60, 1) AS minutes,
       round(count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 1), 6) AS rows_per_sec
FROM events GROUP BY user_id""",
)
def session_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sonaria.operators.dataset import run_report

    events = table(spark, sf_dir, "events")
    rows = events.select(
        F.col("user_id").alias("session_id"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
        epoch_micros(events, "ts").alias("ts_us"),
    )
    return run_report(rows, ["session_id"]).select(
        "session_id",
        "n_rows",
        "n_ok",
        "n_bad",
        F.round("minutes", 1).alias("minutes"),
        F.round("rows_per_sec", 6).alias("rows_per_sec"),
    )
