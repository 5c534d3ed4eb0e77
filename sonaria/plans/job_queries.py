"""The composed jobs over the driver tables: transcription, enrolment, voices, live matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.functions import codec
from sonaria.operators import matching
from sonaria.plans import jobs
from sonaria.plans.registered import query
from sonaria.plans.signal_queries import DIM, PER_CLIP, SAMPLES
from sonaria.session import scratch_path, table
from sonaria.slots import builtin
from sonaria.slots import jobs as slot_jobs
from sonaria.sources import sinks
from sonaria.sources.registry import REGISTRY_SCHEMA, read_latest, write_version
from sonaria.sources.voices import ENTRY_SCHEMA
from sonaria.streaming import jobs as streams
from sonaria.streaming.processors import SessionParams


def clips_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as short clips; every third is cut to 48 and every third to 40 samples."""
    size = F.element_at(F.array(F.lit(64), F.lit(48), F.lit(40)), (F.col("vec_id") % 3 + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.col("label").cast("string").alias("user_id"),
        F.concat(F.lit("clips\\"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".WAV")).alias("path"),
        F.slice("embedding", F.lit(1), size).alias("samples"),
    )


def recordings_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole vectors as clips, some with their beginning once more, so that lengths differ."""
    more = F.slice("embedding", F.lit(1), (F.col("vec_id") % 3 * 8).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        "label",
        F.concat(F.lit("clips\\"), F.col("label").cast("string"), F.lit("/"), F.col("vec_id").cast("string"), F.lit(".WAV")).alias("path"),
        F.concat("embedding", more).alias("samples"),
    )


@query(
    "batch_transcription",
    """
SELECT vec_id || '.WAV' AS file,
       CASE WHEN label = 1 THEN NULL ELSE ' len=' || (64 + vec_id % 3 * 8) END AS text,
       CASE WHEN label = 1 THEN 'unsupported' END AS error
FROM embeddings WHERE label <> 0""",
)
def batch_transcription(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label 0 is already in the metadata, label 1 could not be decoded."""
    clips = recordings_of(spark, sf_dir)
    done = clips.where("label = 0").select(
        F.concat(F.lit("wavs/"), F.lower(F.col("vec_id").cast("string")), F.lit(".wav")).alias("file")
    )
    return jobs.transcription_job(_decoded(clips, F.col("label") == 1), done).select("file", "text", "error")


def _decoded(clips: DataFrame, bad: Column) -> DataFrame:
    return clips.select(
        "path",
        F.when(~bad, F.col("samples")).alias("samples"),
        F.when(bad, F.lit("unsupported")).alias("error"),
    )


@query(
    "transcription_report",
    """
WITH runs AS (
  SELECT 1 AS run, label = 1 AS bad, 120.0 AS seconds FROM embeddings
  UNION ALL SELECT 2, label = 1 AND vec_id % 2 = 1, 0.5 FROM embeddings WHERE label = 1
  UNION ALL SELECT 3, FALSE, 30.0 FROM embeddings WHERE label = 1 AND vec_id % 2 = 1)
SELECT run, count(*) AS n_rows, count(*) FILTER (WHERE NOT bad) AS n_ok, count(*) FILTER (WHERE bad) AS n_bad,
       round(max(seconds) / 60, 6) AS minutes, round(count(*) / greatest(max(seconds), 1), 6) AS rows_per_sec
FROM runs GROUP BY run""",
)
def transcription_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs on one folder: the second tries the failed clips again, half of them in vain, the
    third the rest. Clocks are given, so that the times can be compared."""
    out, clips = scratch_path(spark, "transcriptions"), recordings_of(spark, sf_dir)
    vain = F.col("vec_id") % 2 == 1
    for bad, seconds in ((F.lit(True), 120.0), (vain, 0.5), (F.lit(False), 30.0)):
        ticks = iter((0, int(seconds * 1e6)))
        report = jobs.transcription_run(
            _decoded(clips, (F.col("label") == 1) & bad), out, now=lambda ticks=ticks: next(ticks)
        )
    return report.withColumns({c: F.round(c, 6) for c in ("minutes", "rows_per_sec")})


@query(
    "enhancement",
    """
WITH x AS (
  SELECT vec_id, unnest(list_concat(embedding, embedding[1:vec_id % 3 * 8]))::DOUBLE AS v FROM embeddings),
k AS (SELECT vec_id, pow(10, -18 / 20.0) / (sqrt(sum(v * v) / 14400) + 1e-9) AS k FROM x GROUP BY vec_id)
SELECT vec_id || '_enhanced.wav' AS output_filename, CAST(44 + 2 * 14400 AS BIGINT) AS n_bytes,
       CAST(sum(trunc(abs(CAST(greatest(-1.0, least(1.0, v * k)) AS FLOAT)::DOUBLE) * 32767)) AS BIGINT) AS total
FROM x JOIN k USING (vec_id) GROUP BY vec_id""",
)
def enhancement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips shorter than 0.9 s are padded to it and set to the level; a WAV header has 44 bytes."""
    done = jobs.enhancement_job(recordings_of(spark, sf_dir))
    heard = codec.decode_wav(F.col("wav"))["samples"]
    add = lambda s, v: s + F.abs(F.round(v.cast("double") * 32768)).cast("long")
    return done.select(
        "output_filename",
        F.octet_length("wav").cast("bigint").alias("n_bytes"),
        F.aggregate(heard, F.lit(0).cast("long"), add).alias("total"),
    )


SPECTRA_SQL = f"""
cells AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i
          FROM embeddings),
bins AS (
  SELECT vec_id, label, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / {DIM})), 2)
                                + pow(sum(x * sin(2 * pi() * k * i / {DIM})), 2)) AS m
  FROM cells, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, label, k),
spectra AS (SELECT vec_id, label, list(m ORDER BY k) AS s FROM bins GROUP BY vec_id, label)"""


@query(
    "file_verification",
    f"""
WITH {SPECTRA_SQL},
refs AS (SELECT label, max(vec_id) AS vec_id FROM embeddings GROUP BY label),
named AS (
  SELECT p.vec_id, p.s, CASE WHEN p.label % 2 = 0 THEN (SELECT vec_id FROM refs WHERE label = 3) ELSE r.vec_id END AS ref
  FROM spectra p JOIN refs r ON r.label = p.label)
SELECT n.vec_id AS probe_id, CAST(n.ref AS VARCHAR) AS ref_path, round(list_cosine_similarity(n.s, q.s), 4) AS cosine,
       list_cosine_similarity(n.s, q.s) >= 0.65 AS decision
FROM named n JOIN spectra q ON q.vec_id = n.ref""",
)
def file_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of odd labels name a reference; the others get the first fallback that exists."""
    clips = table(spark, sf_dir, "embeddings")
    newest = clips.groupBy("label").agg(F.max("vec_id").alias("ref_id"))
    references = clips.join(newest.select(F.col("ref_id").alias("vec_id")), "vec_id", "left_semi").select(
        F.col("vec_id").cast("string").alias("path"), F.col("embedding").alias("samples")
    )
    named = F.when(F.col("label") % 2 == 1, F.col("ref_id").cast("string"))
    probes = clips.join(newest, "label").select(
        F.col("vec_id").alias("probe_id"), F.col("embedding").alias("samples"), named.alias("ref_path")
    )
    # Fallbacks: a path that does not exist, then label 3's, then label 4's reference.
    rank = F.when(F.col("label") == 3, 1).when(F.col("label") == 4, 2).otherwise(0)
    path = F.when(rank == 0, F.lit("absent")).otherwise(F.col("ref_id").cast("string"))
    candidates = newest.select(rank.alias("rank"), path.alias("path"))
    scored, _ = jobs.pair_verification_job(probes, references, candidates)
    return scored.select("probe_id", "ref_path", F.round("cosine", 4).alias("cosine"), "decision")


ENROL_RATE = 16


@query(
    "enrolment",
    """
WITH c AS (
  SELECT vec_id, label, embedding[1:CASE vec_id % 3 WHEN 0 THEN 64 ELSE 48 END] AS x FROM embeddings
  WHERE vec_id % 3 <> 2),
latest AS (SELECT label, arg_max(x, vec_id) AS x, max(vec_id) AS vec_id FROM c GROUP BY label),
raw AS (SELECT label, vec_id, unnest(x)::DOUBLE AS v, generate_subscripts(x, 1) - 1 AS i FROM latest),
cells AS (
  SELECT label, vec_id, i, greatest(-1.0, least(1.0, v * pow(10, -18 / 20.0)
         / (sqrt(sum(v * v) OVER (PARTITION BY label) / 14400) + 1e-9))) AS v
  FROM raw),
bins AS (
  SELECT label, vec_id, k, sqrt(pow(sum(v * cos(2 * pi() * k * i / 2048)), 2)
                                + pow(sum(v * sin(2 * pi() * k * i / 2048)), 2)) AS m
  FROM cells, (SELECT unnest(range(256)) AS k) GROUP BY ALL),
norms AS (SELECT label, sqrt(sum(m * m)) AS n FROM bins GROUP BY label)
SELECT CAST(label AS VARCHAR) AS user_id, 'clips\\' || label || '/' || vec_id || '.WAV' AS ref_path, k,
       round(m / n, 3) AS value
FROM bins JOIN norms USING (label)""",
)
def enrolment(spark: SparkSession, sf_dir: str) -> DataFrame:
    updated, _ = _enrolled(spark, sf_dir)
    return updated.select("user_id", "ref_path", F.posexplode("embedding").alias("k", "value")).select(
        "user_id", "ref_path", F.col("k").cast("bigint").alias("k"), F.round(F.col("value").cast("double"), 3).alias("value")
    )


def _enrolled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    clips = clips_of(spark, sf_dir).select(
        "user_id", F.col("path").alias("ref_path"), "samples", F.col("vec_id").alias("enrolled_at")
    )
    return jobs.enrolment_job(clips, spark.createDataFrame([], REGISTRY_SCHEMA), rate=ENROL_RATE)


@query(
    "enrolment_accounting",
    """
WITH c AS (
  SELECT label, vec_id, vec_id % 3 = 2 OR vec_id % 5 = 0 AS short,
         'clips\\' || label || '/' || vec_id || '.WAV' AS ref_path
  FROM embeddings)
SELECT CAST(label AS VARCHAR) AS user_id, ref_path, 'too short' AS outcome FROM c WHERE short
UNION ALL
SELECT CAST(label AS VARCHAR), arg_max(ref_path, vec_id), 'enrolled' FROM c WHERE NOT short GROUP BY label""",
)
def enrolment_accounting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every clip ends, those without samples too."""
    clips = clips_of(spark, sf_dir).select(
        "user_id",
        F.col("path").alias("ref_path"),
        F.when(F.col("vec_id") % 5 != 0, F.col("samples")).alias("samples"),
        F.col("vec_id").alias("enrolled_at"),
    )
    updated, rejected = jobs.enrolment_job(
        clips, spark.createDataFrame([], REGISTRY_SCHEMA), rate=ENROL_RATE
    )
    enrolled = updated.select("user_id", "ref_path", F.lit("enrolled").alias("outcome"))
    return enrolled.unionByName(rejected.withColumnRenamed("error", "outcome"))


@query(
    "clip_registry_verification",
    """
SELECT vec_id AS probe_id, CASE WHEN vec_id % 3 <> 2 THEN CAST(vec_id AS VARCHAR) END AS best_user,
       vec_id % 3 <> 2 AS decision, CASE WHEN vec_id % 3 = 2 THEN 'too short' END AS error
FROM embeddings""",
)
def clip_registry_verification(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every clip is matched against the enrolled vectors of all clips, so it finds itself."""
    clips = clips_of(spark, sf_dir)
    enrolled, _ = jobs.enrolment_job(
        clips.select(
            F.col("vec_id").cast("string").alias("user_id"),
            F.col("path").alias("ref_path"),
            "samples",
            F.col("vec_id").alias("enrolled_at"),
        ),
        spark.createDataFrame([], REGISTRY_SCHEMA),
        rate=ENROL_RATE,
    )
    decided, rejected = jobs.registry_verification_job(
        clips.select(F.col("vec_id").alias("probe_id"), "samples"), enrolled, rate=ENROL_RATE
    )
    found = decided.select("probe_id", F.col("best.user_id").alias("best_user"), "decision")
    refused = rejected.withColumn("decision", F.lit(False))
    return found.unionByName(refused, allowMissingColumns=True)


@query(
    "enrolment_rejects",
    """
SELECT CAST(label AS VARCHAR) AS user_id, 'clips\\' || label || '/' || vec_id || '.WAV' AS ref_path,
       'too short' AS error
FROM embeddings WHERE vec_id % 3 = 2""",
)
def enrolment_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _enrolled(spark, sf_dir)[1]


@query(
    "voice_catalog",
    f"""
WITH {SAMPLES},
bounds AS (
  SELECT clip_id, min(pos) AS lo, max(pos) AS hi FROM samples
  WHERE pos < 500 AND abs(amp) > pow(10, -12 / 20.0) GROUP BY clip_id)
SELECT c.clip_id || '.ogg' AS orig_file, CAST(1000 AS BIGINT) AS sr,
       'len=' || (coalesce(hi - lo + 1, 0) + 50) AS ref_text
FROM (SELECT DISTINCT clip_id FROM samples) c LEFT JOIN bounds b ON b.clip_id = c.clip_id""",
)
def voice_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten vectors make a clip of 640 ms at 1 kHz; it is cut to 500 ms and trimmed at -12 dBFS."""
    voices, _, _ = _voices(spark, sf_dir)
    return voices.select("orig_file", F.col("sr").cast("bigint").alias("sr"), "ref_text")


def _voices(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    parts = F.array_sort(F.collect_list(F.struct("vec_id", "embedding")))
    clips = (
        table(spark, sf_dir, "embeddings")
        .groupBy(F.floor(F.col("vec_id") / PER_CLIP).alias("clip_id"))
        .agg(F.flatten(F.transform(parts, lambda p: p["embedding"])).alias("samples"))
        .select(F.concat(F.col("clip_id").cast("string"), F.lit(".ogg")).alias("orig_file"), "samples")
    )
    cache = spark.createDataFrame([], ENTRY_SCHEMA)
    return jobs.voice_catalog_job(clips, cache, rate=1000, cap_ms=500, soft_ms=250, edge_dbfs=-12.0)


def _le(value: str, size: int) -> str:
    """Little-endian hex digits of a number, in SQL."""
    return " || ".join(f"format('{{:02x}}', CAST(({value}) // {256**i} % 256 AS BIGINT))" for i in range(size))


@query(
    "voice_reference_wav",
    f"""
WITH {SAMPLES},
bounds AS (
  SELECT clip_id, min(pos) AS lo, max(pos) AS hi FROM samples
  WHERE pos < 500 AND abs(amp) > pow(10, -12 / 20.0) GROUP BY clip_id),
pcm AS (
  SELECT clip_id, pos, CAST(trunc(greatest(-1.0, least(1.0, amp)) * 32767) AS BIGINT) AS v
  FROM samples JOIN bounds USING (clip_id) WHERE pos BETWEEN lo AND hi),
body AS (
  SELECT clip_id, count(*) AS n, string_agg({_le("(v + 65536) % 65536", 2)}, '' ORDER BY pos) AS hex FROM pcm GROUP BY clip_id),
files AS (
  SELECT c.clip_id, coalesce(n, 0) + 50 AS n, coalesce(hex, '') || repeat('0000', 50) AS hex
  FROM (SELECT DISTINCT clip_id FROM samples) c LEFT JOIN body USING (clip_id))
SELECT clip_id || '.ogg' AS orig_file, 44 + 2 * n AS n_bytes,
       sha1(unhex('52494646' || {_le("36 + 2 * n", 4)} || '57415645666d742010000000' || '0100' || '0100'
            || {_le("1000", 4)} || {_le("2000", 4)} || '0200' || '1000' || '64617461' || {_le("2 * n", 4)} || hex)) AS wav_sha1
FROM files""",
)
def voice_reference_wav(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of every reference.wav, from the table they are written to."""
    voices, _, references = _voices(spark, sf_dir)
    root = scratch_path(spark, "reference-wavs")
    sinks.write_references(references, root)
    return (
        spark.read.parquet(root)
        .join(voices.select("voice_id", "orig_file"), "voice_id")
        .select(
            "orig_file",
            F.octet_length("reference_wav").cast("bigint").alias("n_bytes"),
            F.sha1("reference_wav").alias("wav_sha1"),
        )
    )


@query(
    "live_matching",
    f"""
WITH cells AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i,
         trunc(unnest(embedding)::DOUBLE * 32767) / 32767 AS x
  FROM embeddings),
bins AS (
  SELECT vec_id, label, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / {DIM})), 2)
                                + pow(sum(x * sin(2 * pi() * k * i / {DIM})), 2)) AS m
  FROM cells, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, label, k),
spectra AS (SELECT vec_id, label, list(m ORDER BY k) AS s FROM bins GROUP BY vec_id, label),
registry AS (SELECT CAST(label AS VARCHAR) AS user_id, arg_max(s, vec_id) AS s FROM spectra GROUP BY label),
scored AS (
  SELECT p.vec_id, r.user_id, (list_cosine_similarity(p.s, r.s) + 1) / 2 AS score FROM spectra p, registry r),
best AS (SELECT vec_id, max(score) AS score, arg_max(user_id, score) AS user_id FROM scored GROUP BY vec_id)
SELECT vec_id, 'final' AS type, 'client_stop' AS reason, score >= 0.9 AS decision,
       CASE WHEN score >= 0.9 THEN user_id END AS best_user, 2 AS n_matches
FROM best""",
)
def live_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is the audio of a live session, stopped after one frame and matched against
    the latest enrolment of each label."""
    rows = table(spark, sf_dir, "embeddings")
    payload = codec.encode_pcm16(F.col("embedding"))
    frame = rows.select(
        F.col("vec_id").cast("string").alias("session_id"),
        F.lit(1).cast("bigint").alias("seq"),
        F.timestamp_seconds(F.lit(1704067200)).alias("ts"),
        F.lit("audio").alias("kind"),
        payload.alias("payload"),
        F.lit(None).cast("string").alias("body"),
        F.lit(16000).alias("sample_rate"),
        F.lit(1).alias("channels"),
    )
    stop = frame.select(
        "session_id",
        F.lit(2).cast("bigint").alias("seq"),
        "ts",
        F.lit("control").alias("kind"),
        F.lit(None).cast("binary").alias("payload"),
        F.lit('{"event":"stop"}').alias("body"),
        "sample_rate",
        "channels",
    )
    source, out, checkpoint = (scratch_path(spark, n) for n in ("live", "live-out", "live-checkpoint"))
    frame.unionByName(stop).write.parquet(source)
    streams.write_clock(spark, source, F.timestamp_seconds(F.lit(1704067200 + 86400)))

    heard = rows.select("vec_id", "label", codec.decode_pcm16(payload).alias("samples"))
    newest = slot_jobs.embed(heard, builtin.EMBED).select(
        F.col("label").cast("string").alias("user_id"),
        F.col("vec_id").cast("string").alias("ref_path"),
        "embedding",
        F.col("vec_id").alias("enrolled_at"),
    )
    root = scratch_path(spark, "live-registry")
    write_version(matching.latest_enrolments(newest, ["enrolled_at"]), root)

    checks = streams.verify_checks(
        streams.read_frames(spark, source), SessionParams(window_samples=128000, min_samples=48)
    )
    run = streams.start_matching(
        checks, lambda s: read_latest(s, root), out, checkpoint, threshold=0.9, top_k=2, denoise=None
    )
    run.awaitTermination()
    return spark.read.parquet(out).where("type = 'final'").select(
        F.col("session_id").cast("bigint").alias("vec_id"),
        "type",
        "reason",
        "decision",
        F.col("best.user_id").alias("best_user"),
        F.size("matches").cast("bigint").alias("n_matches"),
    )
