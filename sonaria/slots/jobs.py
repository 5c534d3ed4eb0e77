"""Slot calls with their surrounding rules: empty input, padding, language condition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.constants import TARGET_DBFS
from sonaria.functions import audio, codec, text, vectors
from sonaria.functions.pieces import bounded_batches
from sonaria.slots import base, builtin
from sonaria.slots.base import Slot


def transcribe(
    clips: DataFrame, slot: Slot = builtin.TRANSCRIBE, language: Column | None = None
) -> DataFrame:
    """Adds raw, text and error. An empty signal gives an empty text without calling the model;
    a missing signal or a failed model gives no text."""
    language = F.lit("ru") if language is None else language
    sound = F.when(F.size("samples") > 0, F.col("samples"))
    empty = F.struct(
        F.lit("").alias("text"), language.alias("language"), F.array().cast(f"array<{builtin.SEGMENT}>").alias("segments")
    )
    ran = base.apply(clips, slot, [sound, F.coalesce(language, F.lit(""))], "raw")
    filled = F.when(F.size("samples") == 0, empty).otherwise(F.col("raw"))
    return ran.withColumn("raw", filled).withColumn(
        "text", F.when(F.col("raw").isNotNull(), text.strip(F.coalesce("raw.text", F.lit(""))))
    )


def embed(clips: DataFrame, slot: Slot = builtin.EMBED) -> DataFrame:
    """Adds embedding (unit length, null for an unusable signal) and error."""
    sound = F.when(vectors.is_usable_signal(F.col("samples")), F.col("samples"))
    ran = base.apply(clips, slot, [sound], "embedding")
    unit = vectors.l2_normalise(F.col("embedding")).cast("array<float>")
    return ran.withColumn("embedding", F.when(F.col("embedding").isNotNull(), unit))


def denoise(clips: DataFrame, slot: Slot = builtin.DENOISE, target_dbfs: float = TARGET_DBFS) -> DataFrame:
    """Pads short signals, runs the model and sets the level."""
    bounded_batches(clips.sparkSession)
    padded = clips.withColumn("samples", audio.pad_to_model_minimum(F.col("samples")))
    ran = base.apply(padded, slot, [F.col("samples")], "_clean")
    level = codec.normalise_level(F.col("_clean"), target_dbfs)
    return ran.withColumn("samples", F.when(F.col("error").isNull(), level)).drop("_clean")


def punctuate(rows: DataFrame, chosen: Column, slot: Slot = builtin.PUNCTUATE) -> DataFrame:
    """Punctuation of the chosen rows; a failure or an unknown label keeps the text."""
    ran = rows.withColumn("_slot", base.call(slot, F.when(chosen, F.col("text"))))
    rendered = text.render_tokens(F.col("_slot.value"))
    return ran.withColumn("text", F.coalesce(rendered, F.col("text"))).drop("_slot")


def accent(rows: DataFrame, chosen: Column, slot: Slot = builtin.ACCENT) -> DataFrame:
    return base.apply(
        rows, slot, [F.when(chosen, F.col("text"))], "text", base.KEEP_INPUT, F.col("text")
    )


def postprocess(
    rows: DataFrame,
    chosen: Column,
    punctuation: Slot | None = builtin.PUNCTUATE,
    accents: Slot | None = builtin.ACCENT,
) -> DataFrame:
    """Punctuation, then accents, for the chosen rows; all others pass unchanged."""
    marked = rows.withColumn("_chosen", chosen)
    if punctuation is not None:
        marked = punctuate(marked, F.col("_chosen"), punctuation)
    if accents is not None:
        marked = accent(marked, F.col("_chosen"), accents)
    return marked.drop("_chosen")
