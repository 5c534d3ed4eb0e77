"""Sample-level expressions: levels, PCM16 encodings, padding and trailing windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sonaria.constants import MIN_MODEL_SEC, PCM16_MAX, SAMPLE_RATE, TARGET_DBFS


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))


def finite(x: Column) -> Column:
    """NaN to 0; infinities stay and are cut by ``clamp`` later."""
    return F.nanvl(x, F.lit(0.0))


def dbfs_to_amplitude(db) -> Column:
    db = F.lit(db) if not isinstance(db, Column) else db
    return F.pow(F.lit(10.0), db / 20.0)


def amplitude_to_dbfs(x: Column) -> Column:
    """20*log10, minus infinity for silence."""
    return F.when(x > 0, F.log10(x) * 20.0).otherwise(F.lit(float("-inf")))


def rms_scale(rms: Column, target_dbfs: float = TARGET_DBFS) -> Column:
    return F.when(rms > 0, dbfs_to_amplitude(target_dbfs) / (rms + F.lit(1e-9))).otherwise(
        F.lit(1.0)
    )


def seconds_to_samples(sec: Column, rate: Column) -> Column:
    return (sec * rate).cast("bigint")


def encode_truncating(x: Column) -> Column:
    """Service encoding: NaN to 0, clip, scale by 32767, cut towards zero."""
    return (clamp(finite(x)) * PCM16_MAX).cast("int")


def encode_rounding(x: Column) -> Column:
    """Client encoding: non-finite to 0, clip, round half up."""
    usable = F.when(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x)
    return F.floor(clamp(usable) * PCM16_MAX + 0.5).cast("int")


def encode_asymmetric(x: Column) -> Column:
    """Test-page encoding: negative samples use 32768, cut towards zero."""
    y = clamp(x)
    return F.when(y < 0, y * (PCM16_MAX + 1)).otherwise(y * PCM16_MAX).cast("int")


def pcm16_to_float(value: Column, scale: int = PCM16_MAX) -> Column:
    return value.cast("double") / float(scale)


def pad_to_model_minimum(samples: Column, rate: int = SAMPLE_RATE) -> Column:
    short = F.lit(int(MIN_MODEL_SEC * rate)) - F.size(samples)
    return F.when(
        short > 0, F.concat(samples, F.array_repeat(F.lit(0.0).cast("float"), short))
    ).otherwise(samples)


def tail(samples: Column, keep) -> Column:
    """Last ``keep`` items. A negative slice start is empty on a shorter array, hence the offset."""
    keep = F.lit(keep) if not isinstance(keep, Column) else keep
    return F.slice(samples, F.greatest(F.size(samples) - keep, F.lit(0)) + 1, keep)


def mean_of(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda x, y: ((x + y) / 2.0).cast("float"))
