"""Signal tables in long form: one row per (clip, position). Positions start at 0 without gaps.

Per-clip values are partial aggregates joined back; neighbour values come from sliced scans, so a
long clip is never sorted by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonaria.constants import (
    CHUNK_SAMPLES,
    EDGE_DBFS,
    KEEP_SILENCE_MS,
    LONG_SILENCE,
    SILENCE_STEP_MS,
    TAIL_SILENCE_MS,
    TARGET_DBFS,
    VOICE_CAP_MS,
    VOICE_SOFT_MS,
)
from sonaria.functions import audio
from sonaria.operators.scan import Running, block_slice, running, with_halo

BLOCK = 65536


def long_enough(n_samples: Column, seconds: Column, rate: Column) -> Column:
    return n_samples >= audio.seconds_to_samples(seconds, rate)


def downmix(samples: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mean over channels at each position."""
    keys = keys or ["clip_id", "pos"]
    return samples.groupBy(*keys).agg(F.avg("amp").alias("amp"))


def levels(samples: DataFrame) -> DataFrame:
    """Per clip: n, rms, peak, dBFS."""
    rms = F.sqrt(F.sum(F.col("amp") * F.col("amp")) / F.count("amp"))
    return samples.groupBy("clip_id").agg(
        F.count("amp").alias("n"),
        rms.alias("rms"),
        F.max(F.abs("amp")).alias("peak"),
    ).withColumn("dbfs", audio.amplitude_to_dbfs(F.col("rms")))


def normalise(samples: DataFrame, target_dbfs: float = TARGET_DBFS) -> DataFrame:
    """Scale every clip to the target level and clip at full scale."""
    scales = levels(samples).select(
        "clip_id", audio.rms_scale(F.col("rms"), target_dbfs).alias("_scale")
    )
    return (
        samples.join(scales, "clip_id")
        .withColumn("amp", audio.clamp(F.col("amp") * F.col("_scale")))
        .drop("_scale")
    )


def with_next(samples: DataFrame, block: int = BLOCK) -> DataFrame:
    """Adds ``next_amp``: within a block by lead, at a block end from the first row of the next."""
    keyed = samples.withColumn("_slice", block_slice(F.col("pos"), block))
    heads = samples.where(F.pmod(F.col("pos"), F.lit(block)) == 0).select(
        "clip_id",
        (block_slice(F.col("pos"), block) - 1).alias("_slice"),
        F.col("amp").alias("_head"),
    )
    inside = Window.partitionBy("clip_id", "_slice").orderBy("pos")
    local = keyed.withColumn("_lead", F.lead("amp").over(inside))
    return (
        local.join(heads, ["clip_id", "_slice"], "left")
        .withColumn("next_amp", F.coalesce("_lead", "_head"))
        .drop("_lead", "_head", "_slice")
    )


def resample(samples: DataFrame, src: int, dst: int, block: int = BLOCK) -> DataFrame:
    """Linear interpolation to another rate: output t sits at t*src/dst.

    Each input row yields the outputs between itself and its successor; the last row yields none.
    """
    if src == dst:
        return samples.select("clip_id", "pos", "amp")
    paired = with_next(samples, block).where(F.col("next_amp").isNotNull())
    pos = F.col("pos").cast("bigint")
    first = F.floor((pos * dst + (src - 1)) / src)
    last = F.floor(((pos + 1) * dst + (src - 1)) / src) - 1
    grid = F.when(last >= first, F.sequence(first, last))
    frac = (F.col("t") * src - F.col("pos") * dst) / F.lit(dst)
    return (
        paired.withColumn("t", F.explode(grid))
        .withColumn("_amp", F.col("amp") + (F.col("next_amp") - F.col("amp")) * frac)
        .select("clip_id", F.col("t").alias("pos"), F.col("_amp").alias("amp"))
    )


def rechunk(
    frames: DataFrame,
    keys: list[str],
    slice_col: str,
    order: list[str],
    n: Column,
    size: int = CHUNK_SAMPLES,
) -> DataFrame:
    """Which part of which frame goes into which fixed-size chunk; the incomplete tail is left out.

    One row per (frame, chunk) overlap: chunk, start inside the frame, count.
    """
    placed = running(frames, keys, slice_col, order, [Running("_end", "sum", n.cast("bigint"))])
    begin = F.col("_end") - n
    whole = Window.partitionBy(*keys)
    totals = (
        frames.groupBy(*keys, slice_col)
        .agg(F.sum(n).alias("_n"))
        .select(*keys, slice_col, F.floor(F.sum("_n").over(whole) / size).alias("_chunks"))
    )
    first, last = F.floor(begin / size), F.floor((F.col("_end") - 1) / size)
    parts = (
        placed.where(n > 0)
        .withColumn("_begin", begin)
        .withColumn("chunk", F.explode(F.sequence(first, last)))
        .join(totals, [*keys, slice_col])
        .where(F.col("chunk") < F.col("_chunks"))
    )
    lo = F.greatest(F.col("_begin"), F.col("chunk") * size)
    hi = F.least(F.col("_end"), (F.col("chunk") + 1) * size)
    return (
        parts.withColumn("frame_start", lo - F.col("_begin"))
        .withColumn("count", hi - lo)
        .drop("_begin", "_end", "_chunks")
    )


def frame_energy(samples: DataFrame, rate: int, step_ms: int = SILENCE_STEP_MS) -> DataFrame:
    """(clip_id, frame, energy): mean square of each step."""
    per = rate * step_ms // 1000
    return (
        samples.groupBy("clip_id", F.floor(F.col("pos") / per).alias("frame"))
        .agg(F.avg(F.col("amp") * F.col("amp")).alias("energy"))
    )


def speech_runs(
    frames: DataFrame, min_frames: int, threshold_dbfs: float, block: int = 8192
) -> DataFrame:
    """Runs of frames outside every silence: (clip_id, run, start_frame, end_frame), end exclusive.

    A silence is a stretch of ``min_frames`` frames whose RMS is at or below the threshold; silent
    stretches that touch or overlap merge. Frame blocks carry a halo of two stretches, so a window
    never needs a whole clip.
    """
    limit = audio.dbfs_to_amplitude(threshold_dbfs)
    haloed = with_halo(frames, "frame", max(block, 4 * min_frames), 2 * min_frames + 1)
    w = Window.partitionBy("clip_id", "_block").orderBy("frame")
    ahead = w.rowsBetween(0, min_frames - 1)
    rms = F.sqrt(F.avg("energy").over(ahead))
    starts = haloed.withColumn(
        "_opens", (F.count("energy").over(ahead) == min_frames) & (rms <= limit)
    )
    covered = starts.withColumn(
        "_silent", F.max("_opens").over(w.rowsBetween(-(min_frames - 1), 0))
    )
    edges = (
        covered.withColumn("_before", F.coalesce(F.lag("_silent").over(w), F.lit(True)))
        .withColumn("_after", F.coalesce(F.lead("_silent").over(w), F.lit(True)))
        .where(F.col("_home") & ~F.col("_silent"))
    )
    # Both ends of a run are rows of a short table: at most one run per silent stretch.
    marks = edges.where(F.col("_before") | F.col("_after")).select(
        "clip_id", "frame", F.col("_before").alias("opens"), F.col("_after").alias("closes")
    )
    by_clip = Window.partitionBy("clip_id").orderBy("frame")
    paired = marks.withColumn(
        "end_frame",
        F.when(F.col("closes"), F.col("frame")).otherwise(F.lead("frame").over(by_clip)) + 1,
    ).where("opens")
    return paired.select(
        "clip_id",
        (F.row_number().over(by_clip) - 1).alias("run"),
        F.col("frame").alias("start_frame"),
        "end_frame",
    )


def split_on_silence(
    frames: DataFrame,
    silence: tuple[int, float] = LONG_SILENCE,
    keep_ms: int = KEEP_SILENCE_MS,
    step_ms: int = SILENCE_STEP_MS,
) -> DataFrame:
    """Speech segments in ms with kept silence around; neighbours that would overlap meet halfway."""
    min_ms, threshold = silence
    runs = speech_runs(frames, min_ms // step_ms, threshold)
    length = frames.groupBy("clip_id").agg(((F.max("frame") + 1) * step_ms).alias("_len"))
    by_clip = Window.partitionBy("clip_id").orderBy("run")
    start, end = F.col("start_frame") * step_ms, F.col("end_frame") * step_ms
    prev_end = F.lag(end).over(by_clip)
    next_start = F.lead(start).over(by_clip)
    lo = F.when(prev_end + keep_ms > start - keep_ms, F.floor((prev_end + start) / 2)).otherwise(
        start - keep_ms
    )
    hi = F.when(next_start - keep_ms < end + keep_ms, F.floor((end + next_start) / 2)).otherwise(
        end + keep_ms
    )
    return (
        runs.withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .join(length, "clip_id")
        .select(
            "clip_id",
            "run",
            F.greatest(F.lit(0), "_lo").cast("bigint").alias("start_ms"),
            F.least("_len", "_hi").cast("bigint").alias("end_ms"),
        )
    )


def cap_segments(
    segments: DataFrame,
    soft_ms: int = VOICE_SOFT_MS,
    cap_ms: int = VOICE_CAP_MS,
    block: int = 4096,
) -> DataFrame:
    """Leading segments up to the cap: stop at the first that starts past the soft length and
    would end past the cap. Both sums only grow, so every later segment stops too."""
    keyed = segments.withColumn("_slice", block_slice(F.col("run"), block))
    length = (F.col("end_ms") - F.col("start_ms")).cast("bigint")
    placed = running(keyed, ["clip_id"], "_slice", ["run"], [Running("_upto", "sum", length)])
    before = F.col("_upto") - length
    return (
        placed.withColumn("offset_ms", before)
        .where(~((before > soft_ms) & (F.col("_upto") > cap_ms)))
        .drop("_upto", "_slice")
    )


def hard_cap(rows: DataFrame, pos_ms: str = "pos_ms", cap_ms: int = VOICE_CAP_MS) -> DataFrame:
    return rows.where(F.col(pos_ms) < cap_ms)


def trim_edges(
    frames: DataFrame, threshold_dbfs: float = EDGE_DBFS, pos: str = "pos"
) -> DataFrame:
    """Drops leading and trailing rows at or below the threshold, then adds 50 ms of silence.

    ``frames`` hold one row per ms with ``level``, an amplitude. Positions start at 0 again.
    """
    loud = audio.amplitude_to_dbfs(F.col("level")) > threshold_dbfs
    bounds = frames.where(loud).groupBy("clip_id").agg(
        F.min(pos).alias("_lo"), F.max(pos).alias("_hi")
    )
    kept = (
        frames.join(bounds, "clip_id")
        .where(F.col(pos).between(F.col("_lo"), F.col("_hi")))
        .select("clip_id", (F.col(pos) - F.col("_lo")).alias(pos), "level")
    )
    lengths = frames.select("clip_id").distinct().join(bounds, "clip_id", "left")
    tail = lengths.select(
        "clip_id",
        F.explode(F.sequence(F.lit(0), F.lit(TAIL_SILENCE_MS - 1))).alias("_i"),
        F.coalesce(F.col("_hi") - F.col("_lo") + 1, F.lit(0)).alias("_n"),
    ).select("clip_id", (F.col("_n") + F.col("_i")).alias(pos), F.lit(0.0).alias("level"))
    return kept.unionByName(tail)
