"""Composed jobs: transcription, enrolment, voice catalog, corpus."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sonaria.constants import MATCH_THRESHOLD, MIN_ENROL_SEC, SAMPLE_RATE, TOP_K, TTS_SAMPLE_RATE
from sonaria.functions import codec, reference, text
from sonaria.operators import catalog, dataset, matching, signal
from sonaria.session import materialise
from sonaria.slots import builtin, jobs
from sonaria.slots.base import Slot
from sonaria.sources import ledger, sinks, voices


def transcription_job(
    clips: DataFrame,
    metadata: DataFrame,
    language: str | None = "ru",
    target_language: str = "ru",
    transcribe: Slot = builtin.TRANSCRIBE,
    punctuate: Slot | None = builtin.PUNCTUATE,
    accent: Slot | None = builtin.ACCENT,
) -> DataFrame:
    """path, file, text, error of the clips not yet in the metadata.

    ``clips``: path, samples and, optionally, a decode error, which is recorded like a model
    failure. The result is written once, so its three readers (metadata, errors, report) do not
    run the models again.
    """
    known = clips if "error" in clips.columns else clips.withColumn("error", F.lit(None).cast("string"))
    open_clips = dataset.todo(known.withColumnRenamed("error", "_decode"), metadata)
    hint = F.lit(language).cast("string")
    heard = jobs.transcribe(open_clips, transcribe, hint)
    chosen = text.is_language(hint, F.col("raw.language"), target_language)
    done = jobs.postprocess(heard, chosen & F.col("text").isNotNull(), punctuate, accent)
    results = done.select(
        "path",
        text.basename(text.forward_slashes(F.col("path"))).alias("file"),
        "text",
        F.coalesce("_decode", "error").alias("error"),
    )
    return materialise(results, "transcription")


def write_transcription(results: DataFrame, metadata_path: str, error_path: str) -> None:
    sinks.append_metadata(results.where(F.col("error").isNull()), metadata_path)
    bad = results.where(F.col("error").isNotNull())
    bad.select(F.concat_ws(" :: ", "path", "error")).write.mode("append").text(error_path)


def enhancement_job(
    clips: DataFrame, rate: int = SAMPLE_RATE, denoise: Slot = builtin.DENOISE
) -> DataFrame:
    """path, output_filename, wav, error: cleaned clips as PCM16 WAV files under their new names."""
    clean = jobs.denoise(clips.select("path", "samples"), denoise)
    wav = codec.encode_wav(F.when(F.col("error").isNull(), F.col("samples")), F.lit(rate))
    name = text.enhanced_name(text.forward_slashes(F.col("path")))
    return clean.select("path", name.alias("output_filename"), wav.alias("wav"), "error")


def pair_verification_job(
    probes: DataFrame, references: DataFrame, candidates: DataFrame, embed: Slot = builtin.EMBED
) -> tuple[DataFrame, DataFrame]:
    """(probe_id, ref_path, cosine, decision) and the rejected probes with their reason.

    ``probes``: probe_id, samples, ref_path or null; ``references``: path, samples; ``candidates``:
    rank, path of the fallbacks. The first fallback that exists serves every probe without its own
    reference. Each reference is embedded once, however many probes name it.
    """
    fallback = (
        candidates.join(references.select("path").distinct(), "path", "left_semi")
        .agg(F.min_by("path", "rank").alias("path"))
        .scalar()
    )
    heard = jobs.embed(probes.select("probe_id", "samples", "ref_path"), embed).select(
        "probe_id", "embedding", F.coalesce("ref_path", fallback).alias("ref_path")
    )
    heard = materialise(heard, "probe-embeddings")
    named = heard.select(F.col("ref_path").alias("path")).distinct()
    known = jobs.embed(references.join(named, "path", "left_semi"), embed).select(
        F.col("path").alias("ref_path"), "embedding"
    )
    known = materialise(known.where(F.col("embedding").isNotNull()), "reference-embeddings")
    usable = heard.where(F.col("embedding").isNotNull())
    scored = matching.verify_pairs(usable, known, "ref_path").select(
        "probe_id", "ref_path", "cosine", "decision"
    )
    missing = usable.join(known.select("ref_path"), "ref_path", "left_anti").select(
        "probe_id", F.lit("no usable reference").alias("error")
    )
    silent = heard.where(F.col("embedding").isNull()).select(
        "probe_id", F.lit("no usable signal").alias("error")
    )
    return scored, missing.unionByName(silent)


def _refusal(clips: DataFrame) -> Column:
    """Why a clip without enough samples is refused: the reader's error, if it had one."""
    short = F.lit("too short")
    return F.coalesce(F.col("error"), short) if "error" in clips.columns else short


def enrolment_job(
    clips: DataFrame,
    registry: DataFrame,
    rate: int = SAMPLE_RATE,
    denoise: Slot = builtin.DENOISE,
    embed: Slot = builtin.EMBED,
) -> tuple[DataFrame, DataFrame]:
    """(new registry, rejected clips). Clips: user_id, ref_path, samples, enrolled_at.

    The default user id stands for a new person, who gets a drawn id; clips under three seconds or
    without a usable signal are rejected.
    """
    named = clips.withColumn(
        "user_id",
        F.when(F.col("user_id") == "_default", text.hex_id()).otherwise(F.col("user_id")),
    )
    # Clips without samples are not long enough: every clip ends in one of the outputs.
    length = F.coalesce(F.size("samples"), F.lit(0))
    long = F.coalesce(signal.long_enough(length, F.lit(MIN_ENROL_SEC), F.lit(rate)), F.lit(False))
    short = materialise(
        named.where(~long).select("user_id", "ref_path", _refusal(clips).alias("error")), "short-clips"
    )
    sound = named.where(long).select("user_id", "ref_path", "samples", "enrolled_at")
    clean = jobs.denoise(sound, denoise).withColumnRenamed("error", "_denoise")
    vectors = jobs.embed(clean, embed).withColumn("error", F.coalesce("_denoise", "error"))
    # Drawn ids and model results are fixed here; both outputs read the written rows.
    fixed = materialise(
        vectors.select("user_id", "ref_path", "embedding", "enrolled_at", "error"), "enrolment"
    )
    failed = fixed.where(F.col("embedding").isNull()).select(
        "user_id", "ref_path", F.coalesce("error", F.lit("no usable signal")).alias("error")
    )
    enrolled = fixed.where(F.col("embedding").isNotNull()).drop("error")
    columns = ["user_id", "ref_path", "embedding", "enrolled_at"]
    updated = matching.upsert(registry.select(*columns), enrolled.select(*columns), ["enrolled_at"])
    return updated, short.unionByName(failed)


def registry_verification_job(
    clips: DataFrame,
    registry: DataFrame,
    rate: int = SAMPLE_RATE,
    threshold: float = MATCH_THRESHOLD,
    top_k: int = TOP_K,
    denoise: Slot = builtin.DENOISE,
    embed: Slot = builtin.EMBED,
) -> tuple[DataFrame, DataFrame]:
    """(decided clips, rejected clips). Clips: probe_id, samples; registry as of enrolment.

    Every clip ends in one of the two: too short, without a usable signal, or with its best
    matches and the decision.
    """
    length = F.coalesce(F.size("samples"), F.lit(0))
    long = F.coalesce(signal.long_enough(length, F.lit(MIN_ENROL_SEC), F.lit(rate)), F.lit(False))
    short = clips.where(~long).select("probe_id", _refusal(clips).alias("error"))
    sound = clips.where(long).select("probe_id", "samples")
    clean = jobs.denoise(sound, denoise).withColumnRenamed("error", "_denoise")
    heard = jobs.embed(clean, embed).withColumn("error", F.coalesce("_denoise", "error"))
    heard = materialise(heard.select("probe_id", "embedding", "error"), "clip-probes")
    probes = heard.where(F.col("embedding").isNotNull()).drop("error")
    decided = matching.decide(matching.top_matches(probes, registry, top_k), threshold)
    failed = heard.where(F.col("embedding").isNull()).select(
        "probe_id", F.coalesce("error", F.lit("no usable signal")).alias("error")
    )
    return decided, short.unionByName(failed)


def voice_catalog_job(
    clips: DataFrame,
    cache: DataFrame,
    rate: int = TTS_SAMPLE_RATE,
    language: str = "ru",
    transcribe: Slot = builtin.TRANSCRIBE,
    accent: Slot = builtin.ACCENT,
    **clean,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(voices, cache entries to add, references). Clips: orig_file, samples at the target rate;
    cache: kind, key, text.

    Every clip becomes a voice with a drawn id and a cleaned reference (voice_id, sr, wav). The text
    comes from the cache by the hash of the reference file; equal clips are transcribed once, and
    what was transcribed is remembered by hash and by file. A clip stays one row: cleaning runs on its
    array, and only hashes and texts are joined.
    """
    cleaned = clips.select(
        "orig_file",
        text.hex_id().alias("voice_id"),
        reference.clean_reference(F.col("samples"), rate, **clean).alias("samples"),
    )
    wav = codec.encode_wav(F.col("samples"), F.lit(rate))
    # Drawn ids and the files are fixed here; all outputs read the written rows.
    made = materialise(
        cleaned.withColumn("wav", wav).withColumn("sr", F.lit(rate)).withColumn("sha1", F.sha1("wav")), "references"
    )
    one = made.where(F.col("wav").isNotNull()).groupBy("sha1").agg(F.min("voice_id").alias("voice_id"))

    def compute(missing: DataFrame) -> DataFrame:
        chosen = one.join(missing, "sha1", "left_semi")
        source = made.select("voice_id", "sha1", "samples").join(chosen.select("voice_id"), "voice_id", "left_semi")
        return jobs.transcribe(source, transcribe, F.lit(language)).select("sha1", "text")

    texts, fresh = catalog.cached_transcripts(one, voices.by_sha1(cache), compute)
    accented = jobs.accent(texts.select("sha1", "text"), F.col("text").isNotNull(), accent)
    catalogued = (
        made.select("voice_id", "sr", "orig_file", "sha1")
        .join(accented, "sha1", "left")
        .select("voice_id", "sr", "orig_file", F.col("text").alias("ref_text"), "sha1")
    )
    path = F.concat("voice_id", F.lit("/reference.wav"))
    entries = fresh.select(F.lit(voices.BY_SHA1).alias("kind"), F.col("sha1").alias("key"), "text").unionByName(
        fresh.join(one, "sha1").select(F.lit(voices.BY_PATH).alias("kind"), path.alias("key"), "text")
    )
    return catalogued, entries, made.select("voice_id", "sr", "wav")


def deduplicated_corpus(rows: DataFrame, clips: DataFrame, order: list[str]) -> DataFrame:
    """Union rows to the final, indexed corpus table: path, text, idx."""
    kept = dataset.unique_rows(rows, clips, order)
    return dataset.stable_index(kept.select("path", "text"), ["path"])


INDEX_SCHEMA = "path string, text string, idx long"
CORPUS_SCHEMA = "idx long, path string, file string, text string, source_sha1 string"


def corpus_table(spark: SparkSession, out: str) -> DataFrame:
    """idx, path, file, text of everything written: of each path the row written last."""
    rows = ledger.read(spark, out, "corpus", CORPUS_SCHEMA)
    return dataset.last_wins(rows, "path", ["batch", "idx"]).drop("batch")


def corpus_run(
    rows: DataFrame,
    clips: DataFrame,
    out: str,
    order: list[str],
    accent: Slot = builtin.ACCENT,
    rows_per_batch: int = 10_000_000,
    batches: int | None = None,
    now: Callable[[], int] = ledger.now_us,
) -> DataFrame:
    """Builds the corpus below ``out`` and goes on where the last run stopped; returns the run records.

    Rows (path, sentence, ``order``) are deduplicated, indexed by path, accented and written in batches, each
    with a record in the ledger. A run that finds an index not yet written to its end finishes that
    first. Then paths that are new, or whose text differs from what is written, get the next indices and are
    written; readers of ``corpus_table`` see the last row of a path. So a run on the same rows
    changes nothing, and one on more rows writes the difference. ``batches`` stops a run early.
    """
    spark = rows.sparkSession
    left = _write_batches(spark, out, accent, rows_per_batch, batches, now)
    if left is None or left > 0:
        started = now()
        known = ledger.read(spark, out, "corpus", CORPUS_SCHEMA)
        written = dataset.last_wins(known, "path", ["batch", "idx"]).select("path", "source_sha1")
        kept = dataset.unique_rows(rows, clips, order).select("path", "text")
        fresh = kept.join(written, "path", "left").where(
            F.col("source_sha1").isNull() | (F.col("source_sha1") != F.sha1("text"))
        )
        base = ledger.progress(spark, out, "index")
        indexed = dataset.stable_index(fresh.select("path", "text"), ["path"])
        indexed = materialise(indexed.withColumn("idx", F.col("idx") + F.lit(base)), "corpus-index")
        end = indexed.agg(F.max("idx")).first()[0]
        if end is not None:
            ledger.commit(indexed.select("path", "text", "idx"), out, "index", end + 1, started, now)
            _write_batches(spark, out, accent, rows_per_batch, left, now)
    return ledger.records(spark, out)


def _write_batches(
    spark: SparkSession, out: str, accent: Slot, rows_per_batch: int, batches: int | None, now: Callable[[], int]
) -> int | None:
    """Writes what is indexed and not written; how many batches may still be written."""
    start, total = ledger.progress(spark, out, "corpus"), ledger.progress(spark, out, "index")
    indexed = ledger.read(spark, out, "index", INDEX_SCHEMA)
    while start < total and (batches is None or batches > 0):
        end, started = min(start + rows_per_batch, total), now()
        todo = indexed.where(F.col("idx").between(start, end - 1)).withColumn("source_sha1", F.sha1("text"))
        done = jobs.accent(dataset.batches(todo, F.lit(start)), F.lit(True), accent)
        written = done.select("idx", "path", F.col("wav_name").alias("file"), "text", "source_sha1")
        ledger.commit(written, out, "corpus", end, started, now)
        start, batches = end, None if batches is None else batches - 1
    return batches


TRANSCRIPT_SCHEMA = "path string, file string, text string, error string"


def transcripts(spark: SparkSession, out: str) -> DataFrame:
    """path, file, text, error of all committed transcription runs."""
    return ledger.read(spark, out, "transcription", TRANSCRIPT_SCHEMA)


def transcription_run(
    clips: DataFrame, out: str, now: Callable[[], int] = ledger.now_us, **options
) -> DataFrame:
    """One run of ``transcription_job`` below ``out`` with its report; returns the reports of all runs.

    Clips that an earlier run transcribed are passed over, failed ones are tried again. Results count
    once the record of the run is written, so a stopped run leaves nothing behind.
    """
    spark, started = clips.sparkSession, now()
    done = transcripts(spark, out).where(F.col("error").isNull()).select("file")
    results = transcription_job(clips, done, **options)
    number = ledger.progress(spark, out, "transcription") + 1
    ledger.commit(results, out, "transcription", number, started, now)
    return ledger.records(spark, out).where("kind = 'transcription'").select(
        F.col("next_idx").alias("run"), "n_rows", "n_ok", "n_bad", "minutes", "rows_per_sec"
    )
