"""Voice folders and transcript caches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.sources import versions

META_SCHEMA = "voice_id string, sr int, orig_file string, ref_text string"
CACHE_SCHEMA = "by_sha1 map<string,string>, by_path map<string,string>"
# A cache table: versions that add entries, and compacted ones that hold all entries up to their number.
ENTRY_SCHEMA = "kind string, key string, text string, version long"
BY_SHA1, BY_PATH = "by_sha1", "by_path"
VERSION, WHOLE = "version-", "whole-"


def read_voices(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """Metadata of every voice id from its folder (meta.json, or what ``sinks.write_voices`` wrote); a voice
    without a readable file gets the defaults."""
    found = (
        spark.read.option("multiLine", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*.{json,txt}")
        .schema(META_SCHEMA)
        .json(root)
    )
    return with_defaults(ids, found)


def read_voice_table(spark: SparkSession, root: str, ids: DataFrame) -> DataFrame:
    """``read_voices`` of the one table that ``sinks.write_voice_table`` writes."""
    return with_defaults(ids, spark.read.schema(META_SCHEMA).parquet(root))


def with_defaults(ids: DataFrame, found: DataFrame) -> DataFrame:
    return ids.select("voice_id").join(found.where(F.col("voice_id").isNotNull()), "voice_id", "left").select(
        "voice_id",
        F.coalesce("sr", F.lit(0)).alias("sr"),
        F.coalesce("orig_file", F.lit("")).alias("orig_file"),
        F.coalesce("ref_text", F.lit("")).alias("ref_text"),
    )


def parse_cache(documents: DataFrame, body: str = "value") -> DataFrame:
    """(kind, key, text) of cache documents in JSON, kind being by_sha1 or by_path; a broken document
    counts as empty."""
    parsed = documents.select(F.from_json(F.col(body), CACHE_SCHEMA).alias("c"))
    kinds = F.explode(F.create_map(F.lit(BY_SHA1), F.col("c.by_sha1"), F.lit(BY_PATH), F.col("c.by_path")))
    return parsed.select(kinds.alias("kind", "entries")).select("kind", F.explode("entries").alias("key", "text"))


def import_cache(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a cache kept as a JSON file, to be written with ``sinks.write_cache``."""
    return parse_cache(spark.read.text(path, wholetext=True))


def read_cache(spark: SparkSession, root: str) -> DataFrame:
    """(kind, key, text) of the cache table: of each key the last version that has it.

    Versions up to the newest compacted one are not read.
    """
    entries = cache_entries(spark, root)
    newest = F.max_by("text", F.struct("version", "text")).alias("text")
    return entries.groupBy("kind", "key").agg(newest)


def cache_entries(spark: SparkSession, root: str) -> DataFrame:
    """(kind, key, text, version) of every version that still counts."""
    whole = versions.numbers(spark, root, WHOLE)
    base = whole[-1] if whole else -1
    folders = [f"{root}/{WHOLE}{base}"] if whole else []
    folders += [f"{root}/{VERSION}{n}" for n in versions.numbers(spark, root, VERSION) if n > base]
    if not folders:
        return spark.createDataFrame([], ENTRY_SCHEMA)
    return spark.read.schema(ENTRY_SCHEMA).parquet(*folders)


def by_sha1(cache: DataFrame) -> DataFrame:
    """(sha1, text) of the entries by content."""
    return cache.where(F.col("kind") == BY_SHA1).select(F.col("key").alias("sha1"), "text")


def by_path(cache: DataFrame) -> DataFrame:
    """(path, text) of the entries by file."""
    return cache.where(F.col("kind") == BY_PATH).select(F.col("key").alias("path"), "text")
