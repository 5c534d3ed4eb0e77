"""Small cases of the findings of round 4."""

import pyarrow as pa
from pyspark.sql import functions as F

from sonaria.functions.pieces import BATCH_BYTES
from sonaria.plans import jobs

SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_padded_clips_are_sent_in_small_batches(spark):
    """400 clips of 0.9 s, 23 MB, came to every Python step as one batch."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    if SETTING in spark.conf.getAll:
        spark.conf.unset(SETTING)
    clips = spark.range(400).coalesce(1).select(
        F.concat(F.lit("a/"), F.col("id"), F.lit(".WAV")).alias("path"),
        F.array_repeat((F.col("id") / 500).cast("float"), 14400).alias("samples"),
    )
    done = jobs.enhancement_job(clips)
    sent = [r.n for r in clips.mapInArrow(sizes, "n long").collect()]
    assert sum(sent) >= 400 * 4 * 14400 and max(sent) < 2 * BATCH_BYTES
    assert {r.n for r in done.select(F.octet_length("wav").alias("n")).collect()} == {44 + 2 * 14400}


def test_a_batch_size_of_the_session_is_kept(spark):
    before = SETTING in spark.conf.getAll and spark.conf.get(SETTING)
    spark.conf.set(SETTING, "1000000")
    try:
        jobs.enhancement_job(spark.range(1).select(F.lit("a.wav").alias("path"), F.array(F.lit(0.5)).alias("samples")))
        assert spark.conf.get(SETTING) == "1000000"
    finally:
        spark.conf.set(SETTING, before) if before else spark.conf.unset(SETTING)
