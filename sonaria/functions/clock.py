"""Epoch numbers from timestamp columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def epoch_micros(df: DataFrame, name: str) -> Column:
    """Microseconds since 1970. A zone-free timestamp is read as UTC, whatever the session zone."""
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        instant = F.from_utc_timestamp(F.col(name).cast("timestamp"), F.current_timezone())
        return F.unix_micros(instant)
    return F.unix_micros(name)


def to_millis(micros: Column) -> Column:
    return F.floor(micros / 1000)
