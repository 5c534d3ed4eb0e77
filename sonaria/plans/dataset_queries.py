"""Corpus preparation over ``documents``: five splits by doc_id, one clip path per source and
length, so that the same clip occurs in several splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.operators import dataset
from sonaria.plans import jobs
from sonaria.plans.registered import query
from sonaria.session import scratch_path, table
from sonaria.slots.base import Slot
from sonaria.sources import corpus, sinks


def clip_path() -> Column:
    return F.concat(F.col("source"), F.lit("/"), F.col("n_chars").cast("string"), F.lit(".WAV"))


def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, sentence, file_rank, row_no. Some sentences are missing, empty or blank."""
    turn = F.col("n_chars") % 13
    sentence = (
        F.when(turn == 0, F.lit(None).cast("string"))
        .when(turn == 1, "")
        .when(turn == 2, "   ")
        .otherwise(F.concat(F.lit("\t "), F.col("text"), F.lit(" ")))
    )
    return table(spark, sf_dir, "documents").select(
        clip_path().alias("path"),
        sentence.alias("sentence"),
        (F.col("doc_id") % 5).cast("int").alias("file_rank"),
        F.col("doc_id").alias("row_no"),
    )


def existing_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips of every document whose labels do not call it toxic."""
    toxic = table(spark, sf_dir, "labels").where("toxic = 1").select("doc_id")
    return table(spark, sf_dir, "documents").join(toxic, "doc_id", "left_anti").select(clip_path().alias("path"))


def corpus_rows_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.usable_rows(split_rows(spark, sf_dir), existing_clips(spark, sf_dir))


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dataset.unique_rows(
        split_rows(spark, sf_dir), existing_clips(spark, sf_dir), ["file_rank", "row_no"]
    )


ROWS = """
raw AS (
  SELECT source || '/' || n_chars || '.WAV' AS path, doc_id % 5 AS file_rank, doc_id AS row_no,
         CASE n_chars % 13 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '' ELSE text END AS text,
         n_chars % 13 IN (0, 1) AS missing
  FROM documents),
clips AS (
  SELECT DISTINCT source || '/' || n_chars || '.WAV' AS path FROM documents
  WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)),
usable AS (SELECT * FROM raw WHERE NOT missing AND path IN (SELECT path FROM clips))"""

DEDUPED = (
    ROWS
    + """,
deduped AS (
  SELECT path, arg_max(text, file_rank * 1000000000 + row_no) AS text FROM usable GROUP BY path),
indexed AS (SELECT *, row_number() OVER (ORDER BY path) - 1 AS idx FROM deduped)"""
)


@query(
    "corpus_rows",
    f"WITH {ROWS} SELECT row_no, CAST(file_rank AS BIGINT) AS file_rank, path, sha1(text) AS text_sha1 FROM usable",
)
def corpus_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_rows_of(spark, sf_dir).select(
        "row_no", F.col("file_rank").cast("bigint").alias("file_rank"), "path", F.sha1("text").alias("text_sha1")
    )


@query("corpus_dedup", f"WITH {DEDUPED} SELECT path, sha1(text) AS text_sha1 FROM deduped")
def corpus_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, sf_dir).select("path", F.sha1("text").alias("text_sha1"))


@query(
    "corpus_ordered",
    f"WITH {DEDUPED} SELECT path, length(text) AS n_chars FROM deduped ORDER BY path",
)
def corpus_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, sf_dir).select("path", F.length("text").cast("bigint").alias("n_chars")).orderBy("path")


@query(
    "corpus_index",
    f"""
WITH {DEDUPED},
starts AS (
  SELECT least(greatest((SELECT count(*) FROM labels WHERE quality = 0),
                        (SELECT count(*) FROM labels WHERE toxic = 1)),
               (SELECT count(*) FROM deduped)) AS start)
SELECT idx, path, printf('cv_%07d.wav', idx) AS wav_name, (idx - start) // 64 AS batch,
       sha1(text) AS text_sha1
FROM indexed, starts WHERE idx >= start""",
)
def corpus_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches from the resume point; the marker and the written lines come from ``labels``."""
    labels = table(spark, sf_dir, "labels")
    rows = deduped(spark, sf_dir).select("path", F.sha1("text").alias("text_sha1"))
    indexed = dataset.stable_index(rows, ["path"])
    start = dataset.resume_start(
        labels.agg(F.count_if(F.col("quality") == 0)).scalar(),
        labels.agg(F.count_if(F.col("toxic") == 1)).scalar(),
        indexed.agg(F.count(F.lit(1))).scalar(),
    )
    return dataset.batches(indexed, start).select("idx", "path", "wav_name", "batch", "text_sha1")


@query(
    "resume_progress",
    f"""
WITH {DEDUPED}
SELECT count(*) AS progress, least(greatest(count(*), 7), count(*)) AS start FROM indexed""",
)
def resume_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    indexed = dataset.stable_index(deduped(spark, sf_dir).select("path"), ["path"])
    done = dataset.progress_after(indexed)
    start = dataset.resume_start(F.col("progress"), F.lit(7).cast("bigint"), F.col("progress"))
    return done.select("progress", start.alias("start"))


#: Appends a mark, so that a text that was not accented, or twice, shows.
ACCENT = Slot("accent.mark", "string", lambda: lambda texts: texts + "+")


@query(
    "corpus_run",
    f"""
WITH {ROWS},
early AS (SELECT path, arg_max(text, file_rank * 1000000000 + row_no) AS text FROM usable WHERE file_rank < 3 GROUP BY path),
late AS (SELECT path, arg_max(text, file_rank * 1000000000 + row_no) AS text FROM usable GROUP BY path),
first AS (SELECT path, text, row_number() OVER (ORDER BY path) - 1 AS idx FROM early),
changed AS (
  SELECT l.path, l.text, (SELECT count(*) FROM early) + row_number() OVER (ORDER BY l.path) - 1 AS idx
  FROM late l LEFT JOIN early e ON e.path = l.path WHERE e.path IS NULL OR e.text <> l.text)
SELECT idx, path, printf('cv_%07d.wav', idx) AS file, sha1(text || '+') AS text_sha1
FROM (SELECT * FROM changed UNION ALL SELECT * FROM first WHERE path NOT IN (SELECT path FROM changed))""",
)
def corpus_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From rows to the written corpus: a run that stops early, one that goes on, one that finds nothing to
    do, and one on more rows, some of which replace what is written."""
    out = scratch_path(spark, "corpus-run")
    rows, clips = split_rows(spark, sf_dir), existing_clips(spark, sf_dir)
    size = table(spark, sf_dir, "documents").count() // 4 + 1

    def run(found: DataFrame, batches: int | None = None) -> None:
        jobs.corpus_run(found, clips, out, ["file_rank", "row_no"], ACCENT, rows_per_batch=size, batches=batches)

    early = rows.where("file_rank < 3")
    run(early, batches=1)
    run(early)
    run(early)
    run(rows)
    return jobs.corpus_table(spark, out).select("idx", "path", "file", F.sha1("text").alias("text_sha1"))


@query(
    "resume_todo",
    """
WITH clips AS (SELECT doc_id, 'corpus\\' || source || '/' || n_chars || '.WAV' AS path FROM documents),
done AS (
  SELECT DISTINCT lower(d.n_chars || '.wav') AS k
  FROM labels l JOIN documents d USING (doc_id) WHERE l.quality = 1)
SELECT doc_id FROM clips WHERE lower(string_split(replace(path, '\\', '/'), '/')[-1]) NOT IN (SELECT k FROM done)""",
)
def resume_todo(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    clips = docs.select("doc_id", F.concat(F.lit("corpus\\"), clip_path()).alias("path"))
    metadata = (
        table(spark, sf_dir, "labels")
        .where("quality = 1")
        .join(docs, "doc_id")
        .select(F.concat(F.lit("wavs\\"), F.col("n_chars").cast("string"), F.lit(".Wav")).alias("file"))
    )
    return dataset.todo(clips, metadata).select("doc_id")


@query(
    "corpus_counts",
    f"""
WITH {DEDUPED}
SELECT (SELECT count(*) FROM raw) AS n_rows, (SELECT count(*) FROM usable) AS n_usable,
       (SELECT count(*) FROM deduped) AS n_unique""",
)
def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = corpus_rows_of(spark, sf_dir)
    return split_rows(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        usable.agg(F.count(F.lit(1))).scalar().alias("n_usable"),
        usable.select("path").distinct().agg(F.count(F.lit(1))).scalar().alias("n_unique"),
    )


@query(
    "tsv_round_trip",
    """
SELECT doc_id % 5 AS file_rank, source || '/' || n_chars || '.WAV' AS path, sha1(text) AS text_sha1
FROM documents""",
)
def tsv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus written as tab-separated splits with a header and read back by split."""
    root = scratch_path(spark, "splits")
    rows = table(spark, sf_dir, "documents").select(
        (F.col("doc_id") % 5).alias("split"), clip_path().alias("path"), F.col("text").alias("sentence")
    )
    sinks.write_tsv_splits(rows, root, "split")
    names = [f"split={rank}" for rank in range(5)] + ["split=missing"]
    read = corpus.read_tsv_splits(spark, root, names)
    return read.select(
        F.col("file_rank").cast("bigint").alias("file_rank"), "path", F.sha1("sentence").alias("text_sha1")
    )


@query(
    "tsv_last_wins",
    f"""
WITH {ROWS},
filled AS (SELECT path, text, row_no FROM raw WHERE NOT missing)
SELECT path, sha1(arg_max(text, row_no)) AS text_sha1 FROM filled GROUP BY path""",
)
def tsv_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last-wins dedup that relies on file row order alone: one sorted file per split."""
    root = scratch_path(spark, "ordered")
    rows = split_rows(spark, sf_dir)
    sinks.write_tsv_ordered(rows.select("path", "sentence", "row_no"), f"{root}/all.tsv", ["row_no"])
    read = corpus.read_tsv_splits(spark, root, ["all.tsv", "absent.tsv"])
    kept = dataset.usable_rows(read, read.select("path"))
    last = dataset.last_wins(kept, "path", corpus.FILE_ORDER)
    return last.select("path", F.sha1("text").alias("text_sha1"))


@query(
    "metadata_round_trip",
    """
SELECT source || '/' || n_chars || '|"' || lang || '".wav' AS file, sha1(text) AS text_sha1 FROM documents""",
)
def metadata_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quoted metadata: fields with pipes, quotes and line breaks survive."""
    root = scratch_path(spark, "metadata")
    name = F.concat(
        F.col("source"), F.lit("/"), F.col("n_chars").cast("string"), F.lit('|"'), F.col("lang"), F.lit('".wav')
    )
    rows = table(spark, sf_dir, "documents").select(name.alias("file"), "text")
    sinks.append_metadata(rows, root)
    return corpus.read_metadata(spark, root).select("file", F.sha1("text").alias("text_sha1"))


@query(
    "metadata_raw_lines",
    """
WITH lines AS (
  SELECT unnest(string_split(source || '/' || n_chars || '.wav|' || text, chr(10))) AS line FROM documents)
SELECT sha1(line) AS line_sha1, count(*) AS n FROM lines GROUP BY 1""",
)
def metadata_raw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unquoted metadata: a line break inside a text starts a new line, as in the plain format."""
    root = scratch_path(spark, "raw-metadata")
    name = F.concat(F.col("source"), F.lit("/"), F.col("n_chars").cast("string"), F.lit(".wav"))
    sinks.append_raw_metadata(table(spark, sf_dir, "documents").select(name.alias("file"), "text"), root)
    return (
        spark.read.text(root)
        .groupBy(F.sha1("value").alias("line_sha1"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "error_side_output",
    """
SELECT 'ok' AS output, 'doc/' || doc_id AS line FROM documents WHERE lang <> 'de'
UNION ALL
SELECT 'error', 'doc/' || doc_id || ' :: ValueError(''' || lang || ''')' FROM documents WHERE lang = 'de'""",
)
def error_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch_path(spark, "side-output")
    lang = F.col("lang")
    results = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"),
        F.when(lang == "de", F.concat(F.lit("ValueError('"), lang, F.lit("')"))).alias("error"),
    )
    sinks.write_results(results, f"{root}/ok", f"{root}/errors")
    ok = spark.read.text(f"{root}/ok").select(F.lit("ok").alias("output"), F.col("value").alias("line"))
    bad = spark.read.text(f"{root}/errors").select(F.lit("error").alias("output"), F.col("value").alias("line"))
    return ok.unionByName(bad)
