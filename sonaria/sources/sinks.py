"""Writers: metadata, errors, voices, caches. Every writer runs one distributed Spark job."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.sources import versions, voices

# Dialects. Quotes double inside quoted fields and blanks are kept.
CSV_DIALECT = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}
PIPE = {"sep": "|", **CSV_DIALECT}
TSV = {"sep": "\t", "header": "true", **CSV_DIALECT}


def append_metadata(rows: DataFrame, path: str) -> None:
    """``file|text`` with minimal quoting."""
    rows.select("file", "text").write.mode("append").options(**PIPE, emptyValue="").csv(path)


def append_raw_metadata(rows: DataFrame, path: str, mode: str = "append") -> None:
    """``file|text`` without any quoting."""
    rows.select(F.concat_ws("|", "file", "text")).write.mode(mode).text(path)


def write_results(results: DataFrame, ok_path: str, error_path: str) -> None:
    """Splits job results: finished paths, and ``path :: error`` lines."""
    good = results.where(F.col("error").isNull())
    bad = results.where(F.col("error").isNotNull())
    good.select("path").write.mode("append").text(ok_path)
    bad.select(F.concat_ws(" :: ", "path", "error")).write.mode("append").text(error_path)


def write_tsv_splits(rows: DataFrame, root: str, split: str) -> None:
    rows.write.mode("append").options(**TSV).partitionBy(split).csv(root)


def write_tsv_ordered(rows: DataFrame, path: str, order: list[str]) -> None:
    """Range-sorted parts: part names follow the order, so the folder reads back in file order."""
    keep = [c for c in rows.columns if c not in order]
    rows.orderBy(*order).select(*keep).write.mode("append").options(**TSV).csv(path)


def write_voices(voices: DataFrame, root: str) -> None:
    """One folder per voice with its metadata as JSON."""
    record = F.to_json(F.struct("voice_id", "sr", "orig_file", "ref_text"))
    voices.select("voice_id", record.alias("value")).write.mode("append").partitionBy("voice_id").text(root)


def write_voice_table(voices: DataFrame, root: str) -> None:
    """Voice metadata as one table; for many voices, where a folder each is too many small files."""
    voices.select("voice_id", "sr", "orig_file", "ref_text").write.mode("append").parquet(root)


def write_references(references: DataFrame, root: str) -> None:
    """Cleaned reference clips as one table: voice_id, sr and the bytes of reference.wav."""
    references.select("voice_id", "sr", F.col("wav").alias("reference_wav")).write.mode("append").parquet(root)


def _cache_version(spark: SparkSession, root: str) -> int:
    known = versions.numbers(spark, root, voices.VERSION) + versions.numbers(spark, root, voices.WHOLE)
    return max(known, default=-1) + 1


def write_cache(entries: DataFrame, root: str) -> int:
    """Adds (kind, key, text) entries to the cache table as its next version, and returns that."""
    number = _cache_version(entries.sparkSession, root)
    rows = entries.select("kind", "key", "text", F.lit(number).cast("long").alias("version"))
    rows.write.parquet(f"{root}/{voices.VERSION}{number}")
    return number


def compact_cache(spark: SparkSession, root: str) -> int:
    """Writes the entries that count as one whole version; readers then skip the older ones."""
    number = _cache_version(spark, root)
    rows = voices.read_cache(spark, root).withColumn("version", F.lit(number).cast("long"))
    rows.select("kind", "key", "text", "version").write.parquet(f"{root}/{voices.WHOLE}{number}")
    return number
