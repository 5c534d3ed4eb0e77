"""Audio clip sources: listing without content, and decoded signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.constants import AUDIO_SUFFIXES, SAMPLE_RATE
from sonaria.functions import codec

AUDIO_GLOB = "*.{" + ",".join(s[1:] for s in AUDIO_SUFFIXES) + "}"


def _files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(root)
    )


def list_audio(spark: SparkSession, root: str, glob: str = AUDIO_GLOB) -> DataFrame:
    """path, length of every audio file below ``root``; file bytes are not read."""
    return _files(spark, root, glob).select("path", "length")


def read_clips(
    spark: SparkSession, root: str, target_rate: int = SAMPLE_RATE, glob: str = AUDIO_GLOB
) -> DataFrame:
    """path, sample_rate, samples (mono, target rate, within [-1, 1]), error."""
    files = _files(spark, root, glob).select("path", codec.decode_wav(F.col("content")).alias("d"))
    return to_rate(
        files.select("path", F.col("d.sample_rate").alias("sample_rate"), "d.samples", "d.error"),
        target_rate,
    )


def to_rate(clips: DataFrame, target_rate: int = SAMPLE_RATE) -> DataFrame:
    same = F.col("sample_rate") == target_rate
    other = F.when(~same, F.col("samples"))
    moved = codec.resample_array(other, F.coalesce("sample_rate", F.lit(1)), F.lit(target_rate))
    return clips.withColumn(
        "samples", F.when(same, F.col("samples")).otherwise(moved.cast("array<float>"))
    ).withColumn("sample_rate", F.when(F.col("samples").isNotNull(), F.lit(target_rate)))
