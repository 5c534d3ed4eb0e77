"""Text, catalog and slot queries over ``documents``, ``conversations``, ``labels``, ``events``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.constants import LABEL_CASES, LABEL_MARKS
from sonaria.functions import messages, text
from sonaria.operators import catalog
from sonaria.plans.registered import query
from sonaria.session import scratch_path, table
from sonaria.slots import base, builtin, jobs
from sonaria.sources import sinks, voices

WS_SQL = "chr(9) || chr(10) || chr(13) || ' ' || chr(160)"
RAW_SQL = "chr(160) || ' ' || replace(text, '. ', '.   ') || chr(9) || chr(10)"


def padded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.lit("  "), F.replace(F.col("text"), F.lit(". "), F.lit(".   ")), F.lit("\t\n"))
    return table(spark, sf_dir, "documents").withColumn("raw", raw)


@query(
    "transcript_cleanup",
    f"""
WITH s AS (SELECT doc_id, trim({RAW_SQL}, {WS_SQL}) AS s FROM documents),
c AS (SELECT doc_id, s, replace(s, '  ', ' ') AS c FROM s)
SELECT doc_id, sha1(s) AS stripped, sha1(c) AS collapsed,
       CASE WHEN length(c) <= 120 THEN c
            WHEN contains(left(c, 120), ' ') THEN regexp_replace(left(c, 120), ' [^ ]*$', '')
            ELSE left(c, 120) END AS truncated,
       round(greatest(1.0, length(c) / 13.0), 6) AS est_seconds
FROM c""",
)
def transcript_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = padded_texts(spark, sf_dir)
    clean = text.clean_transcript(F.col("raw"))
    return rows.select(
        "doc_id",
        F.sha1(text.strip(F.col("raw"))).alias("stripped"),
        F.sha1(clean).alias("collapsed"),
        text.clean_transcript(F.col("raw"), 120).alias("truncated"),
        F.round(text.speech_seconds(clean), 6).alias("est_seconds"),
    )


@query(
    "blank_texts",
    """
SELECT doc_id, coalesce(n_chars % 5 IN (0, 1, 2), FALSE) AS blank FROM documents""",
)
def blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("n_chars") % 5
    body = (
        F.when(turn == 0, F.lit(None).cast("string"))
        .when(turn == 1, "")
        .when(turn == 2, "  \n")
        .otherwise(F.col("text"))
    )
    return table(spark, sf_dir, "documents").select("doc_id", text.is_blank(body).alias("blank"))


SUFFIXES_SQL = "['.WAV', '.mp3', '.Flac', '.m4a', '.ogg', '.txt', '', '.wav.bak']"


@query(
    "upload_checks",
    f"""
WITH p AS (
  SELECT doc_id, lang || '\\' || source || '/clip ' || n_chars || ({SUFFIXES_SQL})[1 + doc_id % 8] AS raw
  FROM documents),
n AS (SELECT doc_id, string_split(replace(raw, '\\', '/'), '/')[-1] AS name FROM p),
x AS (SELECT *, lower(regexp_extract(name, '(\\.[^.]+)$', 1)) AS suffix FROM n)
SELECT doc_id, name, left(name, length(name) - length(suffix)) AS stem, suffix,
       suffix IN ('.wav', '.mp3', '.flac', '.m4a', '.ogg') AS accepted,
       left(name, length(name) - length(suffix)) || '_enhanced.wav' AS enhanced,
       'upload_' || name AS upload, lower(name) AS done_key
FROM x""",
)
def upload_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    endings = [".WAV", ".mp3", ".Flac", ".m4a", ".ogg", ".txt", "", ".wav.bak"]
    ending = F.get(F.array(*[F.lit(e) for e in endings]), (F.col("doc_id") % 8).cast("int"))
    raw = F.concat(
        F.col("lang"), F.lit("\\"), F.col("source"), F.lit("/clip "), F.col("n_chars").cast("string"), ending
    )
    path = text.forward_slashes(F.col("raw"))
    name = text.basename(path)
    return table(spark, sf_dir, "documents").withColumn("raw", raw).select(
        "doc_id",
        name.alias("name"),
        text.stem(path).alias("stem"),
        text.suffix(path).alias("suffix"),
        catalog.accepted_upload(path).alias("accepted"),
        text.enhanced_name(path).alias("enhanced"),
        text.upload_name(name).alias("upload"),
        text.done_key(F.col("raw")).alias("done_key"),
    )


def _label_names() -> list[str]:
    return [f"{case}_{mark}" for case in LABEL_CASES for mark in LABEL_MARKS]


# Fixed values, written out for the statements: number of a label, its case, what follows the word.
MARKS_SQL = """
  (0, 'LOWER', ''), (1, 'LOWER', '.'), (2, 'LOWER', ','), (3, 'LOWER', '?'), (4, 'LOWER', '—'),
  (5, 'LOWER', ':'), (6, 'LOWER', '!'), (7, 'LOWER', ';'), (8, 'LOWER', '-'), (9, 'LOWER', '...'),
  (10, 'LOWER', '?!'),
  (11, 'UPPER', ''), (12, 'UPPER', '.'), (13, 'UPPER', ','), (14, 'UPPER', '?'), (15, 'UPPER', ' —'),
  (16, 'UPPER', ':'), (17, 'UPPER', '!'), (18, 'UPPER', ';'), (19, 'UPPER', '-'), (20, 'UPPER', '...'),
  (21, 'UPPER', '?!'),
  (22, 'UPPER_TOTAL', ''), (23, 'UPPER_TOTAL', '.'), (24, 'UPPER_TOTAL', ','), (25, 'UPPER_TOTAL', '?'),
  (26, 'UPPER_TOTAL', ' —'), (27, 'UPPER_TOTAL', ':'), (28, 'UPPER_TOTAL', '!'), (29, 'UPPER_TOTAL', ';'),
  (30, 'UPPER_TOTAL', '-'), (31, 'UPPER_TOTAL', '...'), (32, 'UPPER_TOTAL', '?!')"""


TOKENS_SQL = f"""
words AS (
  SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS word,
         generate_subscripts(string_split_regex(text, '\\s+'), 1) - 1 AS pos
  FROM documents),
marks(id, mode, suffix) AS (VALUES {MARKS_SQL}),
labelled AS (
  SELECT w.doc_id, w.pos, w.word, m.mode, m.suffix
  FROM words w LEFT JOIN marks m
    ON m.id = CASE WHEN w.doc_id % 10 = 7 AND w.pos = 3 THEN -1 ELSE (w.doc_id + w.pos) % 33 END),
rendered AS (
  SELECT *, CASE mode
      WHEN 'LOWER' THEN word
      WHEN 'UPPER' THEN CASE WHEN left(word, 1) = 'ß' THEN 'Ss' ELSE upper(left(word, 1)) END
                        || lower(substr(word, 2))
      ELSE upper(replace(word, 'ß', 'SS')) END || suffix AS token
  FROM labelled),
texts AS (
  SELECT doc_id, count(*) AS n_tokens, count(*) FILTER (WHERE mode IS NULL) AS n_unknown,
         string_agg(' ' || token, '' ORDER BY pos) AS text
  FROM rendered GROUP BY doc_id)"""


def labelled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(n) for n in _label_names()])
    # Texts move once, before they are exploded; everything after is grouped by the same key.
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")
    words = docs.select(
        "doc_id", F.posexplode(F.split("text", r"\s+")).alias("pos", "word")
    )
    unknown = (F.col("doc_id") % 10 == 7) & (F.col("pos") == 3)
    label = F.get(names, ((F.col("doc_id") + F.col("pos")) % 33).cast("int"))
    return words.withColumn("label", F.when(unknown, "OTHER_O").otherwise(label))


@query("label_tokens", f"WITH {TOKENS_SQL} SELECT doc_id, sha1(text) AS text_sha1 FROM texts WHERE n_unknown = 0")
def label_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts, _ = catalog.label_tokens(labelled_words(spark, sf_dir))
    return texts.select("doc_id", F.sha1("text").alias("text_sha1"))


@query("token_rejects", f"WITH {TOKENS_SQL} SELECT doc_id, pos, word, 'OTHER_O' AS label FROM labelled WHERE mode IS NULL")
def token_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.label_tokens(labelled_words(spark, sf_dir))[1].select("doc_id", "pos", "word", "label")


def _cycling_labels():
    import pandas as pd

    names = _label_names()

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda t: [{"word": w, "label": names[i % 33]} for i, w in enumerate(t.split())]
        )

    return run


CYCLING = base.Slot("punctuate.cycling", builtin.TOKENS, _cycling_labels)


@query(
    "punctuated_texts",
    f"""
WITH words AS (
  SELECT doc_id, unnest(string_split_regex(text, '\\s+')) AS word,
         generate_subscripts(string_split_regex(text, '\\s+'), 1) - 1 AS pos
  FROM documents WHERE lang = 'fr'),
marks(id, mode, suffix) AS (VALUES {MARKS_SQL}),
texts AS (
  SELECT doc_id, string_agg(' ' || CASE mode WHEN 'LOWER' THEN word
      WHEN 'UPPER' THEN upper(left(word, 1)) || lower(substr(word, 2)) ELSE upper(word) END || suffix,
      '' ORDER BY pos) AS text
  FROM words JOIN marks ON id = pos % 33 GROUP BY doc_id)
SELECT d.doc_id, sha1(coalesce(t.text, d.text)) AS text_sha1
FROM documents d LEFT JOIN texts t ON t.doc_id = d.doc_id""",
)
def punctuated_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows of the target language reach the punctuation and accent slots."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    chosen = text.is_language(F.lit(None).cast("string"), F.col("lang"), "fr")
    return jobs.postprocess(docs, chosen, CYCLING, builtin.ACCENT).select(
        "doc_id", F.sha1("text").alias("text_sha1")
    )


@query(
    "language_rule",
    """
SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN lang = 'fr' WHEN 1 THEN TRUE ELSE FALSE END AS chosen
FROM documents""",
)
def language_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("doc_id") % 3
    hint = F.when(turn == 1, "fr").when(turn == 2, "en")
    return table(spark, sf_dir, "documents").select(
        "doc_id", text.is_language(hint, F.col("lang"), "fr").alias("chosen")
    )


@query(
    "segment_concat",
    """
SELECT conv_id, sha1(trim(string_agg(text, '' ORDER BY turn), chr(9) || chr(10) || chr(13) || ' ')) AS text_sha1
FROM conversations GROUP BY conv_id""",
)
def segment_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = table(spark, sf_dir, "conversations")
    texts = catalog.ordered_text(segments, "conv_id", "turn", F.col("text"))
    return texts.select("conv_id", F.sha1(text.strip(F.col("text"))).alias("text_sha1"))


@query(
    "transcript_responses",
    """
SELECT conv_id, turn, CASE WHEN turn % 2 = 0
         THEN '{"text":' || to_json(text) || '}'
         ELSE '{"text":' || to_json(text) || ',"raw":{"text":' || to_json(' ' || text)
              || ',"language":"' || role || '","segments":[]}}' END AS body
FROM conversations""",
)
def transcript_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript answers; the raw result is part of verbose ones only."""
    raw = F.struct(
        F.concat(F.lit(" "), F.col("text")).alias("text"),
        F.col("role").alias("language"),
        F.array().cast(f"array<{builtin.SEGMENT}>").alias("segments"),
    )
    rows = table(spark, sf_dir, "conversations").withColumn("raw", raw)
    clean = text.strip(F.coalesce("raw.text", F.lit("")))
    shown = F.when(F.col("turn") % 2 == 1, F.col("raw"))
    return rows.select(
        "conv_id", "turn", messages.transcript_json(clean.alias("text"), shown.alias("raw")).alias("body")
    )


def _cache_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").select("doc_id")
    docs = table(spark, sf_dir, "documents").join(labelled, "doc_id", "left_semi")
    return docs.select(F.sha1("text").alias("sha1"), F.concat(F.lit("cached "), F.length("text").cast("string")).alias("text")).distinct()


CACHE_SQL = """
cache AS (
  SELECT DISTINCT sha1(text) AS sha1, 'cached ' || length(text) AS text FROM documents
  WHERE doc_id IN (SELECT doc_id FROM labels))"""


@query(
    "transcript_cache",
    f"""
WITH {CACHE_SQL}
SELECT d.doc_id, sha1(d.text) AS sha1, coalesce(c.text, 'len=' || length(d.text)) AS transcript,
       c.sha1 IS NOT NULL AS hit
FROM documents d LEFT JOIN cache c ON c.sha1 = sha1(d.text)""",
)
def transcript_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.sha1("text").alias("sha1"), F.length("text").alias("n")
    )
    lengths = docs.groupBy("sha1").agg(F.max("n").alias("n"))

    def compute(missing: DataFrame) -> DataFrame:
        return missing.join(lengths, "sha1").withColumn(
            "text", F.concat(F.lit("len="), F.col("n").cast("string"))
        )

    texts, _ = catalog.cached_transcripts(docs, _cache_of(spark, sf_dir), compute)
    return docs.join(texts, "sha1").select(
        "doc_id", "sha1", F.col("text").alias("transcript"), "hit"
    )


@query(
    "cache_write_back",
    f"""
WITH {CACHE_SQL},
files AS (SELECT source || '/' || n_chars AS key, 'file ' || max(doc_id) AS text FROM documents GROUP BY 1)
SELECT 'by_sha1' AS kind, sha1 AS key, text FROM cache
UNION ALL
SELECT DISTINCT 'by_sha1', sha1(text), 'len=' || length(text) FROM documents
WHERE sha1(text) NOT IN (SELECT sha1 FROM cache)
UNION ALL
SELECT 'by_path', key, text FROM files""",
)
def cache_write_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache table after two versions, a compaction, and a version with the computed misses;
    entries by file are written twice and the later text wins."""
    root = scratch_path(spark, "cache")
    cache = _cache_of(spark, sf_dir)
    stored = table(spark, sf_dir, "documents")
    file = F.concat("source", F.lit("/"), F.col("n_chars").cast("string"))
    named = stored.groupBy(file.alias("key")).agg(F.max("doc_id").alias("last"))
    by_path = named.select(
        F.lit(voices.BY_PATH).alias("kind"), "key", F.concat(F.lit("file "), F.col("last").cast("string")).alias("text")
    )
    by_sha1 = cache.select(F.lit(voices.BY_SHA1).alias("kind"), F.col("sha1").alias("key"), "text")
    sinks.write_cache(by_sha1.unionByName(by_path.withColumn("text", F.lit("outdated"))), root)
    sinks.write_cache(by_path, root)
    sinks.compact_cache(spark, root)
    docs = stored.select(F.sha1("text").alias("sha1"), F.length("text").alias("n"))
    lengths = docs.groupBy("sha1").agg(F.max("n").alias("n"))

    def compute(missing: DataFrame) -> DataFrame:
        return missing.join(lengths, "sha1").withColumn("text", F.concat(F.lit("len="), F.col("n").cast("string")))

    _, fresh = catalog.cached_transcripts(docs, voices.by_sha1(voices.read_cache(spark, root)), compute)
    sinks.write_cache(fresh.select(F.lit(voices.BY_SHA1).alias("kind"), F.col("sha1").alias("key"), "text"), root)
    return voices.read_cache(spark, root)


@query(
    "cache_documents",
    """
SELECT 'by_sha1' AS kind, sha1(text) AS key, max(text) AS text FROM documents WHERE lang <> 'es' GROUP BY text
UNION ALL
SELECT 'by_path', source || '/' || doc_id, text FROM documents WHERE lang <> 'es'""",
)
def cache_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caches kept as JSON documents, one per text, imported into a cache table and read from it;
    broken documents count as empty."""
    documents, root = scratch_path(spark, "cache-json"), scratch_path(spark, "cache")
    file = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    body = F.to_json(
        F.struct(
            F.create_map(F.sha1("text"), F.col("text")).alias("by_sha1"),
            F.create_map(file, F.col("text")).alias("by_path"),
        )
    )
    stored = F.when(F.col("lang") == "es", F.left(body, F.length(body) - 3)).otherwise(body)
    table(spark, sf_dir, "documents").select(stored.alias("value")).write.text(documents)
    sinks.write_cache(voices.parse_cache(spark.read.text(documents)), root)
    return voices.read_cache(spark, root)


@query(
    "voice_metadata",
    """
WITH v AS (SELECT source AS voice_id, max(n_chars) AS n, min(doc_id) AS first FROM documents GROUP BY source)
SELECT voice_id, CAST(CASE WHEN first % 3 = 0 THEN 0 ELSE 24000 END AS BIGINT) AS sr,
       CASE WHEN first % 3 = 0 THEN '' ELSE voice_id || '.mp3' END AS orig_file,
       CASE WHEN first % 3 = 0 OR first % 3 = 1 THEN '' ELSE 'len=' || n END AS ref_text
FROM v""",
)
def voice_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voice folders written and read back; a third have no metadata, a third no transcript."""
    found = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("voice_id")).agg(
        F.max("n_chars").alias("n"), F.min("doc_id").alias("first")
    )
    root = scratch_path(spark, "voices")
    kind = F.col("first") % 3
    sinks.write_voices(
        found.where(kind != 0).select(
            "voice_id",
            F.lit(24000).alias("sr"),
            F.concat("voice_id", F.lit(".mp3")).alias("orig_file"),
            F.when(kind == 2, F.concat(F.lit("len="), F.col("n").cast("string"))).alias("ref_text"),
        ),
        root,
    )
    return voices.read_voices(spark, root, found).withColumn("sr", F.col("sr").cast("bigint"))


@query(
    "voice_ids",
    "SELECT DISTINCT source AS voice_id FROM documents ORDER BY 1",
)
def voice_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("source").alias("voice_id")).distinct().orderBy("voice_id")


@query(
    "synthesis_requests",
    """
WITH r AS (
  SELECT doc_id, CASE WHEN n_chars % 11 = 0 THEN '  ' ELSE text || ' ' END AS text,
         CASE doc_id % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN source ELSE 'voice ' || lang END AS voice_id,
         (['wav', 'mp3', 'ogg', 'flac'])[1 + doc_id % 7 % 4] AS format
  FROM documents),
v AS (SELECT DISTINCT source AS voice_id, 'ref ' || source AS ref_text FROM documents
      UNION ALL SELECT '_default', 'ref default' UNION ALL SELECT 'voice fr', 'ref fr')
SELECT r.doc_id, coalesce(nullif(r.voice_id, ''), '_default') AS voice,
       CASE WHEN format = 'flac' THEN 422 WHEN trim(text) = '' THEN 400 WHEN v.voice_id IS NULL THEN 404
            ELSE 200 END AS status,
       CASE format WHEN 'wav' THEN 'audio/wav' WHEN 'mp3' THEN 'audio/mpeg' WHEN 'ogg' THEN 'audio/ogg' END AS mime,
       v.ref_text, round(greatest(1.0, length(trim(text)) / 13.0), 6) AS est_seconds
FROM r LEFT JOIN v ON v.voice_id = coalesce(nullif(r.voice_id, ''), '_default')""",
)
def synthesis_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    turn = F.col("doc_id") % 4
    voice = (
        F.when(turn == 1, "")
        .when(turn == 2, F.col("source"))
        .when(turn == 3, F.concat(F.lit("voice "), F.col("lang")))
    )
    formats = F.array(*[F.lit(f) for f in ("wav", "mp3", "ogg", "flac")])
    requests = docs.select(
        "doc_id",
        F.when(F.col("n_chars") % 11 == 0, "  ").otherwise(F.concat("text", F.lit(" "))).alias("text"),
        voice.alias("voice_id"),
        F.get(formats, (F.col("doc_id") % 7 % 4).cast("int")).alias("format"),
    )
    fixed = spark.createDataFrame(
        [("_default", "ref default"), ("voice fr", "ref fr")], "voice_id string, ref_text string"
    )
    known = (
        docs.select(F.col("source").alias("voice_id"))
        .distinct()
        .withColumn("ref_text", F.concat(F.lit("ref "), F.col("voice_id")))
        .unionByName(fixed)
    )
    return catalog.plan_requests(requests, known).select(
        "doc_id", "voice", "status", "mime", "ref_text", F.round("est_seconds", 6).alias("est_seconds")
    )


@query(
    "props_json",
    """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract(props, '$.k') AS BIGINT) END AS k
FROM events""",
)
def props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON that may be broken: no failure, a null field."""
    body = F.when(F.col("event_type") == "error", F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    return table(spark, sf_dir, "events").select("event_id", F.from_json(body, "k bigint")["k"].alias("k"))


@query("random_ids", "SELECT doc_id, 32 AS n, TRUE AS hex FROM documents")
def random_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn ids differ by design, so only their shape can be compared."""
    rows = table(spark, sf_dir, "documents").select("doc_id", text.hex_id().alias("voice_id"))
    return rows.select("doc_id", F.length("voice_id").alias("n"), F.rlike("voice_id", F.lit("^[0-9a-f]{32}$")).alias("hex"))
