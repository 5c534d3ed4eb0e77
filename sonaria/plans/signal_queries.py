"""Signal queries: ten neighbouring vectors of ``embeddings`` make one clip of 640 samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.functions import audio, codec
from sonaria.operators import signal
from sonaria.operators.scan import SLICE, sliced
from sonaria.plans.registered import query
from sonaria.plans.session_queries import ACTIONS, session_actions
from sonaria.session import table
from sonaria.slots import builtin, jobs

DIM = 64
PER_CLIP = 10
SMALL_BLOCK = 256


def samples_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        F.floor(vec / PER_CLIP).alias("clip_id"),
        (vec % PER_CLIP).alias("_part"),
        F.posexplode("embedding").alias("_i", "amp"),
    ).select(
        "clip_id",
        (F.col("_part") * DIM + F.col("_i")).cast("bigint").alias("pos"),
        F.col("amp").cast("double").alias("amp"),
    )


SAMPLES = """
cells AS (
  SELECT vec_id, label, unnest(embedding)::DOUBLE AS amp, generate_subscripts(embedding, 1) - 1 AS i
  FROM embeddings),
samples AS (SELECT vec_id // 10 AS clip_id, (vec_id % 10) * 64 + i AS pos, amp FROM cells)"""


@query(
    "downmix",
    f"WITH {SAMPLES} SELECT vec_id // 2 AS clip_id, i AS pos, round(avg(amp), 6) AS amp FROM cells GROUP BY 1, 2",
)
def downmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    channels = table(spark, sf_dir, "embeddings").select(
        F.floor(F.col("vec_id") / 2).alias("clip_id"), F.posexplode("embedding").alias("pos", "amp")
    )
    mono = signal.downmix(channels.withColumn("amp", F.col("amp").cast("double")))
    return mono.withColumn("amp", F.round("amp", 6))


@query(
    "rms_levels",
    f"""
WITH {SAMPLES}
SELECT clip_id, count(*) AS n, round(sqrt(avg(amp * amp)), 6) AS rms, round(max(abs(amp)), 6) AS peak,
       round(20 * log10(sqrt(avg(amp * amp))), 4) AS dbfs
FROM samples GROUP BY clip_id""",
)
def rms_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.levels(samples_of(spark, sf_dir))
    return out.select(
        "clip_id", "n", F.round("rms", 6).alias("rms"), F.round("peak", 6).alias("peak"), F.round("dbfs", 4).alias("dbfs")
    )


@query(
    "rms_normalise",
    f"""
WITH {SAMPLES},
scales AS (
  SELECT clip_id, CASE WHEN avg(amp * amp) > 0 THEN pow(10, -6 / 20.0) / (sqrt(avg(amp * amp)) + 1e-9) ELSE 1 END AS s
  FROM samples GROUP BY clip_id)
SELECT clip_id, pos, round(greatest(-1.0, least(1.0, amp * s)), 6) AS amp
FROM samples JOIN scales USING (clip_id)""",
)
def rms_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.normalise(samples_of(spark, sf_dir), target_dbfs=-6.0)
    return out.select("clip_id", "pos", F.round("amp", 6).alias("amp"))


SHAPED_SQL = """
shaped AS (
  SELECT vec_id, i, CASE WHEN i = 5 AND label = 0 THEN 'nan'::DOUBLE WHEN i = 6 AND label = 1 THEN 'inf'::DOUBLE
                         WHEN i = 7 AND label = 2 THEN '-inf'::DOUBLE ELSE amp * 4 END AS x
  FROM cells),
cut AS (SELECT *, greatest(-1.0, least(1.0, x)) AS y FROM shaped)"""


@query(
    "pcm16_encodings",
    f"""
WITH {SAMPLES}, {SHAPED_SQL}
SELECT vec_id, i AS pos,
       CAST(trunc(CASE WHEN isnan(x) THEN 0 ELSE y END * 32767) AS BIGINT) AS truncated,
       CAST(floor(CASE WHEN isnan(x) OR isinf(x) THEN 0 ELSE y END * 32767 + 0.5) AS BIGINT) AS rounded,
       CAST(CASE WHEN isnan(x) THEN 32767 WHEN y < 0 THEN trunc(y * 32768) ELSE trunc(y * 32767) END AS BIGINT) AS asymmetric,
       round(trunc(CASE WHEN isnan(x) THEN 0 ELSE y END * 32767) / 32767, 6) AS decoded
FROM cut""",
)
def pcm16_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.posexplode("embedding").alias("pos", "amp")
    )
    pos, label = F.col("pos"), F.col("label")
    x = (
        F.when((pos == 5) & (label == 0), F.lit(float("nan")))
        .when((pos == 6) & (label == 1), F.lit(float("inf")))
        .when((pos == 7) & (label == 2), F.lit(float("-inf")))
        .otherwise(F.col("amp").cast("double") * 4)
    )
    value = cells.withColumn("x", x)
    cut = audio.encode_truncating(F.col("x"))
    return value.select(
        "vec_id",
        F.col("pos").cast("bigint").alias("pos"),
        cut.cast("bigint").alias("truncated"),
        audio.encode_rounding(F.col("x")).cast("bigint").alias("rounded"),
        audio.encode_asymmetric(F.col("x")).cast("bigint").alias("asymmetric"),
        F.round(audio.pcm16_to_float(cut), 6).alias("decoded"),
    )


@query(
    "pcm16_bytes",
    f"""
WITH {SAMPLES},
enc AS (SELECT vec_id, i, trunc(greatest(-1.0, least(1.0, amp * 4)) * 32767) AS v FROM cells),
mono AS (SELECT vec_id, i // 2 AS j, avg(v) AS v FROM enc GROUP BY 1, 2)
SELECT e.vec_id, CAST(count(*) * 2 AS BIGINT) AS n_bytes, CAST(sum(v) AS BIGINT) AS service_sum,
       CAST(sum(v) AS BIGINT) AS buffer_sum,
       (SELECT CAST(sum(abs(m.v) * 2) AS BIGINT) FROM mono m WHERE m.vec_id = e.vec_id) AS stereo_abs_sum
FROM enc e GROUP BY e.vec_id""",
)
def pcm16_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples to PCM16 bytes and back with both scales, and as interleaved stereo."""
    loud = F.transform("embedding", lambda x: x.cast("double") * 4)
    frames = table(spark, sf_dir, "embeddings").select("vec_id", codec.encode_pcm16(loud).alias("payload"))
    service = codec.decode_pcm16(F.col("payload"))
    buffered = codec.decode_pcm16(F.col("payload"), scale=32768)
    stereo = codec.decode_pcm16(F.col("payload"), F.lit(2), clip=True)

    def total(samples, scale, absolute=False):
        """Sum in encoded units, which are whole numbers."""

        def add(s, v):
            units = F.round(v.cast("double") * scale, 0)
            return s + (F.abs(units) if absolute else units)

        return F.aggregate(samples, F.lit(0.0), add).cast("bigint")

    return frames.select(
        "vec_id",
        F.octet_length("payload").cast("bigint").alias("n_bytes"),
        total(service, 32767).alias("service_sum"),
        total(buffered, 32768).alias("buffer_sum"),
        total(stereo, 2 * 32767, True).alias("stereo_abs_sum"),
    )


RESAMPLED = """
lengths AS (SELECT clip_id, count(*) AS n FROM samples GROUP BY clip_id),
grid AS (SELECT clip_id, n, unnest(range((n - 1) * {dst} // {src} + 1)) AS t FROM lengths),
placed AS (SELECT clip_id, t, t * {src} // {dst} AS i, (t * {src} % {dst}) / {dst}.0 AS frac, n FROM grid)
SELECT p.clip_id, p.t AS pos, round(a.amp + (b.amp - a.amp) * p.frac, 6) AS amp
FROM placed p JOIN samples a ON a.clip_id = p.clip_id AND a.pos = p.i
JOIN samples b ON b.clip_id = p.clip_id AND b.pos = p.i + 1"""


@query("resample_up", f"WITH {SAMPLES}, {RESAMPLED.format(src=16000, dst=24000)}")
def resample_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.resample(samples_of(spark, sf_dir), 16000, 24000, block=SMALL_BLOCK)
    return out.withColumn("amp", F.round("amp", 6))


@query("resample_down", f"WITH {SAMPLES}, {RESAMPLED.format(src=44100, dst=16000)}")
def resample_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = signal.resample(samples_of(spark, sf_dir), 44100, 16000, block=SMALL_BLOCK)
    return out.withColumn("amp", F.round("amp", 6))


@query(
    "resample_clips",
    f"""
WITH {SAMPLES.replace("vec_id // 10 AS clip_id, (vec_id % 10) * 64 + i AS pos", "vec_id AS clip_id, i AS pos")},
out AS ({"SELECT * FROM (WITH " + RESAMPLED.format(src=16000, dst=22050).strip().replace("round(a.amp + (b.amp - a.amp) * p.frac, 6)", "a.amp + (b.amp - a.amp) * p.frac") + ")"})
SELECT clip_id AS vec_id, count(*) AS n, round(sum(amp), 4) AS total FROM out GROUP BY clip_id""",
)
def resample_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form used on whole clips: no shuffle."""
    moved = codec.resample_array(F.col("embedding"), F.lit(16000), F.lit(22050))
    total = F.aggregate("out", F.lit(0.0), lambda s, v: s + v.cast("double"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("out"))
    return rows.select("vec_id", F.size("out").cast("bigint").alias("n"), F.round(total, 4).alias("total"))


@query(
    "rechunk",
    f"""
WITH {ACTIONS},
placed AS (
  SELECT session_id, seq, n_samples AS n,
         sum(n_samples) OVER (PARTITION BY session_id ORDER BY ts, seq ROWS UNBOUNDED PRECEDING) AS hi,
         sum(n_samples) OVER (PARTITION BY session_id) // 3200 AS chunks
  FROM actions WHERE action = 'audio'),
parts AS (
  SELECT *, hi - n AS lo, unnest(range(CAST((hi - n) // 3200 AS BIGINT), CAST((hi - 1) // 3200 + 1 AS BIGINT))) AS chunk
  FROM placed WHERE n > 0)
SELECT session_id, chunk, seq, CAST(greatest(lo, chunk * 3200) - lo AS BIGINT) AS frame_start,
       CAST(least(hi, (chunk + 1) * 3200) - greatest(lo, chunk * 3200) AS BIGINT) AS count
FROM parts WHERE chunk < chunks""",
)
def rechunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = sliced(session_actions(spark, sf_dir).where("action = 'audio'"), ["session_id"], ["ts_us", "seq"])
    parts = signal.rechunk(frames, ["session_id"], SLICE, ["ts_us", "seq"], F.col("n_samples"), 3200)
    return parts.select("session_id", "chunk", "seq", "frame_start", "count")


SILENCE_FRAMES, SILENCE_DBFS = 8, -20.0

RUNS = f"""
windows AS (
  SELECT clip_id, pos AS frame, count(*) OVER w = {SILENCE_FRAMES}
         AND sqrt(avg(amp * amp) OVER w) <= pow(10, {SILENCE_DBFS} / 20) AS opens
  FROM samples
  WINDOW w AS (PARTITION BY clip_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND {SILENCE_FRAMES - 1} FOLLOWING)),
marked AS (
  SELECT clip_id, frame, max(CAST(opens AS INT)) OVER (PARTITION BY clip_id ORDER BY frame
         ROWS BETWEEN {SILENCE_FRAMES - 1} PRECEDING AND CURRENT ROW) AS silent
  FROM windows),
islands AS (
  SELECT clip_id, frame, frame - row_number() OVER (PARTITION BY clip_id ORDER BY frame) AS g
  FROM marked WHERE silent = 0),
runs AS (
  SELECT clip_id, row_number() OVER (PARTITION BY clip_id ORDER BY min(frame)) - 1 AS run,
         min(frame) AS start_frame, max(frame) + 1 AS end_frame
  FROM islands GROUP BY clip_id, g)"""


@query("speech_runs", f"WITH {SAMPLES}, {RUNS} SELECT * FROM runs")
def speech_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One sample per frame here; blocks are small so that runs cross block edges."""
    frames = signal.frame_energy(samples_of(spark, sf_dir), rate=1000, step_ms=1)
    return signal.speech_runs(frames, SILENCE_FRAMES, SILENCE_DBFS, block=128)


@query(
    "silence_segments",
    f"""
WITH {SAMPLES}, {RUNS},
near AS (
  SELECT *, lag(end_frame) OVER w AS prev_end, lead(start_frame) OVER w AS next_start
  FROM runs WINDOW w AS (PARTITION BY clip_id ORDER BY run))
SELECT clip_id, run,
       CAST(greatest(0, CASE WHEN prev_end + 6 > start_frame - 6 THEN (prev_end + start_frame) // 2
                             ELSE start_frame - 6 END) AS BIGINT) AS start_ms,
       CAST(least(640, CASE WHEN next_start - 6 < end_frame + 6 THEN (end_frame + next_start) // 2
                            ELSE end_frame + 6 END) AS BIGINT) AS end_ms
FROM near""",
)
def silence_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = signal.frame_energy(samples_of(spark, sf_dir), rate=1000, step_ms=1)
    return signal.split_on_silence(frames, (SILENCE_FRAMES, SILENCE_DBFS), keep_ms=6, step_ms=1)


@query(
    "duration_cap",
    """
WITH s AS (
  SELECT conv_id AS clip_id, turn AS run, length(text) AS n,
         sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS upto
  FROM conversations)
SELECT clip_id, run, CAST(upto - n AS BIGINT) AS offset_ms FROM s
WHERE NOT (upto - n > 600 AND upto > 1200)""",
)
def duration_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("clip_id"),
        F.col("turn").alias("run"),
        F.lit(0).cast("bigint").alias("start_ms"),
        F.length("text").cast("bigint").alias("end_ms"),
    )
    return signal.cap_segments(segments, 600, 1200, block=3).select("clip_id", "run", "offset_ms")


@query(
    "hard_cap",
    f"WITH {SAMPLES} SELECT clip_id, count(*) AS n, round(sum(amp), 4) AS total FROM samples WHERE pos < 500 GROUP BY clip_id",
)
def hard_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = signal.hard_cap(samples_of(spark, sf_dir), "pos", 500)
    return kept.groupBy("clip_id").agg(F.count("*").alias("n"), F.round(F.sum("amp"), 4).alias("total"))


@query(
    "edge_trim",
    f"""
WITH {SAMPLES},
bounds AS (
  SELECT clip_id, min(pos) AS lo, max(pos) AS hi FROM samples
  WHERE abs(amp) > 0 AND 20 * log10(abs(amp)) > -12 GROUP BY clip_id),
kept AS (SELECT s.clip_id, s.pos - lo AS pos, round(abs(s.amp), 6) AS level
         FROM samples s JOIN bounds b ON b.clip_id = s.clip_id AND s.pos BETWEEN lo AND hi),
ends AS (SELECT c.clip_id, coalesce(hi - lo + 1, 0) AS n
         FROM (SELECT DISTINCT clip_id FROM samples) c LEFT JOIN bounds b ON b.clip_id = c.clip_id)
SELECT * FROM kept
UNION ALL SELECT clip_id, n + unnest(range(50)), 0.0 FROM ends""",
)
def edge_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = samples_of(spark, sf_dir).select("clip_id", "pos", F.abs("amp").alias("level"))
    return signal.trim_edges(levels, threshold_dbfs=-12.0).withColumn("level", F.round("level", 6))


@query(
    "pad_and_tail",
    """
SELECT vec_id, greatest(64 + vec_id % 3 * 10, 72) AS padded, least(64 + vec_id % 3 * 10, 70) AS tail_size,
       round(CASE vec_id % 3 WHEN 0 THEN embedding[1] WHEN 1 THEN embedding[5] ELSE embedding[15] END::DOUBLE, 6)
         AS tail_first
FROM embeddings""",
)
def pad_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Appends vec-dependent samples, pads to 0.9 s at 80 Hz and takes a trailing window of 70."""
    extra = F.slice("embedding", F.lit(1), (F.col("vec_id") % 3 * 10).cast("int"))
    signal_ = F.concat("embedding", extra)
    kept = audio.tail(signal_, 70)
    return table(spark, sf_dir, "embeddings").select(
        "vec_id",
        F.size(audio.pad_to_model_minimum(signal_, 80)).cast("bigint").alias("padded"),
        F.size(kept).cast("bigint").alias("tail_size"),
        F.round(F.get(kept, F.lit(0)).cast("double"), 6).alias("tail_first"),
    )


@query(
    "embed_slot",
    """
WITH cells AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
bins AS (
  SELECT vec_id, k, sqrt(pow(sum(x * cos(2 * pi() * k * i / 64)), 2) + pow(sum(x * sin(2 * pi() * k * i / 64)), 2)) AS m
  FROM cells, (SELECT unnest(range(33)) AS k) GROUP BY vec_id, k),
norms AS (SELECT vec_id, sqrt(sum(m * m)) AS n FROM bins GROUP BY vec_id)
SELECT b.vec_id, b.k, round(b.m / n.n, 3) AS value FROM bins b JOIN norms n USING (vec_id)""",
)
def embed_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"))
    embedded = jobs.embed(clips, builtin.EMBED)
    return embedded.select("vec_id", F.posexplode("embedding").alias("k", "value")).select(
        "vec_id", F.col("k").cast("bigint").alias("k"), F.round(F.col("value").cast("double"), 3).alias("value")
    )


@query(
    "transcribe_slot",
    """
SELECT vec_id, CASE WHEN label = 0 THEN '' ELSE 'len=' || (64 - label) END AS text, 'ru' AS language FROM embeddings""",
)
def transcribe_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    keep = F.when(F.col("label") == 0, 0).otherwise(F.lit(DIM) - F.col("label"))
    clips = table(spark, sf_dir, "embeddings").select(
        "vec_id", F.slice("embedding", F.lit(1), keep).alias("samples")
    )
    return jobs.transcribe(clips).select("vec_id", "text", F.col("raw.language").alias("language"))


@query(
    "denoise_slot",
    """
WITH s AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
scales AS (SELECT vec_id, pow(10, -18 / 20.0) / (sqrt(sum(x * x) / 14400) + 1e-9) AS k FROM s GROUP BY vec_id)
SELECT s.vec_id, 14400 AS n, round(sum(greatest(-1.0, least(1.0, x * k))), 2) AS total,
       round(max(abs(greatest(-1.0, least(1.0, x * k)))), 3) AS peak
FROM s JOIN scales USING (vec_id) GROUP BY s.vec_id""",
)
def denoise_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    clips = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("samples"))
    clean = jobs.denoise(clips)
    add = lambda s, v: s + v.cast("double")
    return clean.select(
        "vec_id",
        F.size("samples").cast("bigint").alias("n"),
        F.round(F.aggregate("samples", F.lit(0.0), add), 2).alias("total"),
        F.round(F.array_max(F.transform("samples", lambda v: F.abs(v).cast("double"))), 3).alias("peak"),
    )
