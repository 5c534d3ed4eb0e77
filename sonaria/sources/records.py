"""Records of delimited text whose quoted fields may hold line breaks, read by byte ranges.

A file is read line by line in splits of any size. Whether a line begins inside a quoted field depends on
all lines before it, but only through one bit, so every split first says where it leads from either state
(outside, inside a quoted field); the splits of a file are folded in order, and then each split, knowing
its first state, joins its own lines to records. Only the pieces of records that cross splits, two for a
split at most, are brought together.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUOTE = '"'
_CLOSING = re.compile(r'(?:[^"]|"")*+"(?!")', re.S)


def ends_inside(line: str, inside: bool, sep: str) -> bool:
    """Whether a quoted field is open at the end of a line that begins in or outside of one.

    A quote opens a field only as its first character; in a quoted field two quotes are one.
    """
    at = 0
    while True:
        if inside or line.startswith(QUOTE, at):
            found = _CLOSING.match(line, at if inside else at + 1)
            if not found:
                return True
            at, inside = found.end(), False
        at = line.find(sep, at)
        if at < 0:
            return False
        at += 1


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, lineSep="\n").select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.coalesce("value", F.lit("")).alias("line"),
    )


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Runs of rows of one split, in the order of the file."""
    for batch in batches:
        blocks, files = batch.column("block").to_numpy(), batch.column("file").dictionary_encode().indices.to_numpy()
        edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(files) != 0)) + 1
        for begin, end in zip([0, *edges], [*edges, len(blocks)]):
            if end > begin:
                part = batch.slice(begin, end - begin)
                yield (part.column("file")[0].as_py(), part.column("block")[0].as_py()), part


def _leads(sep: str):
    """Arrow function: for each split the states it leads to from outside and from inside."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states: dict[tuple[str, int], list[bool]] = {}
        for split, rows in _stretches(batches):
            lead = states.setdefault(split, [False, True])
            lines = rows.column("line")
            # Lines without a quote leave the state as it is.
            for line in lines.filter(pc.match_substring(lines, QUOTE)).to_pylist():
                to = [ends_inside(line, inside, sep) for inside in (False, True)]
                lead[:] = [to[state] for state in lead]
        if states:
            yield pa.record_batch(
                {
                    "file": pa.array([s[0] for s in states], pa.string()),
                    "block": pa.array([s[1] for s in states], pa.int64()),
                    "outside": [v[0] for v in states.values()],
                    "inside": [v[1] for v in states.values()],
                }
            )

    return run


def _begin(splits: pa.Table) -> pa.Table:
    """The first state of every split of a file; a file has as many rows as splits."""
    splits = splits.sort_by("block")
    state, begins = False, []
    for outside, inside in zip(splits["outside"].to_pylist(), splits["inside"].to_pylist()):
        begins.append(state)
        state = inside if state else outside
    return splits.select(["file", "block"]).append_column("begins", pa.array(begins, pa.bool_()))


_PIECE = "file string, block long, row long, continues boolean, open boolean, record string"


def _joined(sep: str):
    """Arrow function: records of each split, and the pieces of those that do not begin or end in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, inside, row, held, continues = None, False, 0, [], False

        def pieces(found: list[tuple]) -> pa.RecordBatch:
            names = ["file", "block", "row", "continues", "open", "record"]
            types = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
            columns = zip(*found) if found else ([] for _ in names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        for now, rows in _stretches(batches):
            out = []
            if now != split:
                if held:
                    out.append((*split, row, continues, True, "\n".join(held)))
                split, row, held = now, 0, []
                inside = continues = rows.column("begins")[0].as_py()
            lines = rows.column("line")
            quoted = pc.match_substring(lines, QUOTE).to_numpy(zero_copy_only=False)
            for line, has_quote in zip(lines.to_pylist(), quoted):
                held.append(line)
                if has_quote:
                    inside = ends_inside(line, inside, sep)
                if not inside:
                    out.append((*split, row, continues, False, "\n".join(held)))
                    row, held, continues = row + 1, [], False
            yield pieces(out)
        if held:
            yield pieces([(*split, row, continues, True, "\n".join(held))])

    return run


def read_records(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, block, row, record: every record with its place (split and number in it); the order of a file is
    (block, row). Empty records are left out; a carriage return before the line break is not part of one."""
    lines = _lines(spark, path)
    leads = lines.mapInArrow(_leads(sep), "file string, block long, outside boolean, inside boolean")
    begins = leads.groupBy("file").applyInArrow(_begin, "file string, block long, begins boolean")
    # One row per split of the input, which bounds the broadcast; rows keep the order of the file.
    pieces = lines.join(F.broadcast(begins), ["file", "block"]).mapInArrow(_joined(sep), _PIECE)
    whole = pieces.where("not continues and not open").select("file", "block", "row", "record")
    upto = Window.partitionBy("file").orderBy("block", "row")
    crossing = (
        pieces.where("continues or open")
        .withColumn("_record", F.sum(F.when(F.col("continues"), 0).otherwise(1)).over(upto))
        .groupBy("file", "_record")
        .agg(
            F.min(F.struct("block", "row")).alias("at"),
            F.expr("listagg(record, '\n') WITHIN GROUP (ORDER BY block, row)").alias("record"),
        )
        .select("file", "at.block", "at.row", "record")
    )
    return (
        whole.unionByName(crossing)
        .withColumn("record", F.regexp_replace("record", "\r$", ""))
        .where(F.col("record") != "")
    )
