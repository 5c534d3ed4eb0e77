"""Small cases of the findings of round 3."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from sonaria.operators import catalog


def test_runs_of_pieces():
    """Pieces that follow each other leave a task as one row, not one by one."""
    rows = [(1, 0, 0, " ä"), (1, 0, 1, None), (1, 0, 2, " cc"), (1, 0, 2, ""), (1, 1, 3, "d"), (2, 1, 4, "e")]
    rows += [(None, 1, 5, "f"), (None, 1, 6, "g"), (None, None, None, "h"), (None, None, None, None)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.string()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
    batch = pa.RecordBatch.from_arrays(columns, ["k", "_block", "_order", "_piece"])
    (out,) = catalog._join_runs(iter([batch.slice(0, 0), batch]))
    got = [tuple(r.values()) for r in out.to_pylist()]

    def ends(*sizes):
        return b"".join(n.to_bytes(4, "big") for n in sizes)

    assert got == [
        (1, 0, 0, ends(3, 3, 6), " ä cc", 1),
        (1, 0, 2, ends(0), "", 0),
        (1, 1, 3, ends(1), "d", 0),
        (2, 1, 4, ends(1), "e", 0),
        (None, 1, 5, ends(1, 2), "fg", 0),
        (None, None, None, ends(1), "h", 0),
        (None, None, None, ends(0), "", 1),
    ]


def test_ordered_text_of_overlapping_and_shuffled_rows(spark):
    turn = random.Random(5)
    rows = []
    for key in range(30):
        starts = [(0, 11)] if key % 3 else [(0, 7), (3, 12), (-5, 9)]
        for begin, end in starts:
            mine = [(key, i, None if (key, i) == (4, 6) else turn.choice(["ö", "", "pq", " x"])) for i in range(begin, end)]
            if key % 2:
                turn.shuffle(mine)
            rows += mine
    rows = [(k, i, v if k % 3 else (v and str(i))) for k, i, v in rows] + [(None, 1, "b"), (None, 0, "a")]
    pieces = spark.createDataFrame(rows, "k long, i int, v string")
    for kind in ("int", "double"):
        for complete in (False, True):
            found = catalog.ordered_text(
                pieces.withColumn("i", F.col("i").cast(kind)), "k", "i", F.col("v"), lead="-", block=4, complete=complete
            )
            wanted = {}
            for k, i, v in sorted(rows, key=lambda r: r[1]):
                wanted[k] = wanted.get(k, "") + ("" if v is None else "-" + v)
            if complete:
                del wanted[4]
            assert dict((r["k"], r["text"]) for r in found.collect()) == wanted


def test_long_overlapping_rows(spark):
    """Two rows of one id whose pieces lie between each other's, thousands of them."""
    both = spark.range(2).selectExpr("1L AS k", "explode(sequence(id, 7998 + id, 2)) AS i")
    (found,) = catalog.ordered_text(both, "k", "i", F.col("i").cast("string"), lead=" ").collect()
    assert found["text"] == "".join(f" {i}" for i in range(8000))
    twice = spark.range(2).selectExpr("1L AS k", "posexplode(split(repeat('ä ', 4000), ' ')) AS (i, v)").where("i < 4000")
    (found,) = catalog.ordered_text(twice, "k", "i", F.col("v"), lead=" ").collect()
    assert found["text"] == " ä" * 8000
