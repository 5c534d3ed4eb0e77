"""Arrow batches in pieces of a bounded size, so that a task's Python holds one piece of values at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession

# Spark sends batches of up to 64 MB; as Python or double values they would be many times that.
PIECE_BYTES = 1 << 20
# What Spark sends at once where clips are large: the executor's JVM has several batches of each Python step of a task
# beside its heap, and keeps the rows of a batch until they are answered.
BATCH_BYTES = 4 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session sends Python batches of ``BATCH_BYTES``, unless it has a size of its own."""
    if _BATCH_SETTING not in spark.conf.getAll:
        spark.conf.set(_BATCH_SETTING, str(BATCH_BYTES))


def pieces(batches: Iterator[pa.Array], limit: int = PIECE_BYTES) -> Iterator[pa.Array]:
    """All rows in order, in slices of about ``limit`` bytes and of one row at least."""
    for batch in batches:
        rows = max(1, len(batch) * limit // max(batch.nbytes, 1))
        lo = 0
        while lo < len(batch):
            part = batch.slice(lo, rows)
            # Rows differ in size: a slice above the limit is halved.
            while len(part) > 1 and part.nbytes > 2 * limit:
                part = part.slice(0, len(part) // 2)
            yield part
            lo += len(part)


def by_pieces(one: Callable[[pa.Array], pa.Array], batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for part in pieces(batches):
        yield one(part)
