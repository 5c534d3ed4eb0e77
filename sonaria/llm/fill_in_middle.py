"""Fill-in-the-middle transformation of whole documents, one Arrow pipeline per batch.

A text is cut into units: white space with the word after it, or white space that ends the text. Units of a batch
become a list array; flattened with the index of their parent they get an ordinal, the ordinal
and the two cuts of the parent give a role (prefix, middle, suffix), a filter per role and offsets
from the cuts rebuild one list per text, and joining the lists gives the pieces, which are put together with
their markers. No text is handled on its own in Python.

Draws come from the sha256 of seed and id, so reruns and other partitionings agree. The cuts lie between units. A
text that is empty or contains a marker stays plain, so an output can always be split back.

Work goes batch by batch in slices of about SLICE_BYTES of text, so memory is bounded by the slice or by the
longest single text, whichever is more. Nothing is shuffled.

Defined cases: a null text is an empty one (plain, no units); a null id counts as the empty string in
the draws; a text of white space only is one unit; very long texts are processed whole; repeated rows give
repeated rows and equal draws; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Of 100 texts so many are transformed, and of 100 transformed ones so many have the suffix first.
RATE = 50
SUFFIX_FIRST = 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKERS = f"{PREFIX}|{SUFFIX}|{MIDDLE}"
UNIT = rb"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+)"
#: Stands between units; no byte of UTF-8 text.
BREAK = b"\xff"
SLICE_BYTES = 8 << 20

SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit numbers of an id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def units(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Units of each text: offsets (one more than texts) and the flat units, as bytes."""
    broken = pc.replace_substring_regex(texts, pattern=UNIT, replacement=b"\\1" + BREAK)
    lists = pc.split_pattern(broken, pattern=BREAK)
    flat, parents = pc.list_flatten(lists), pc.list_parent_indices(lists)
    # What follows the last break of a text is empty and no unit.
    length = pc.list_value_length(lists).to_numpy().astype(np.int64) - 1
    offsets = np.concatenate([[0], np.cumsum(length)])
    last = (offsets[1:] + np.arange(len(length)))[parents.to_numpy()]
    return offsets, flat.filter(pa.array(np.arange(len(flat)) != last))


def _modulo(number: pa.Array, by: pa.Array) -> pa.Array:
    return pc.subtract(number, pc.multiply(pc.divide(number, by), by))


def _pieces(texts: pa.Array, h1: pa.Array, h2: pa.Array) -> tuple[pa.Array, list[pa.Array]]:
    """Number of units of each text, and its prefix, middle and suffix."""
    offsets, flat = units(texts)
    n = pa.array(np.diff(offsets))
    cuts = [_modulo(h, pc.add(n, 1)) for h in (h1, h2)]
    first, second = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    parents = np.repeat(np.arange(len(texts)), np.diff(offsets))
    ordinal = pa.array(np.arange(len(flat)) - offsets[parents])
    after_first = pc.greater_equal(ordinal, pc.take(first, pa.array(parents)))
    after_second = pc.greater_equal(ordinal, pc.take(second, pa.array(parents)))
    roles = [
        (pc.invert(after_first), first),
        (pc.and_not(after_first, after_second), pc.subtract(second, first)),
        (after_second, pc.subtract(n, second)),
    ]
    joined = []
    for mask, count in roles:
        ends = np.cumsum(count.to_numpy())
        lists = pa.LargeListArray.from_arrays(
            pa.array(np.concatenate([[0], ends]).astype(np.int64)), flat.filter(mask)
        )
        joined.append(pc.binary_join(lists, pa.scalar(b"", pa.large_binary())))
    return n, joined


def _transform(rows: pa.RecordBatch, rate: int, suffix_first: int) -> pa.RecordBatch:
    text = pc.fill_null(rows["text"].cast(pa.large_binary()), b"")
    plain = pc.greater_equal(_modulo(rows["h3"], pa.scalar(100, pa.int64())), rate)
    plain = pc.or_(plain, pc.equal(pc.binary_length(text), 0))
    plain = pc.or_(plain, pc.match_substring_regex(text, pattern=MARKERS.encode()))
    spm = pc.less(_modulo(rows["h4"], pa.scalar(100, pa.int64())), suffix_first)
    n, pieces = _pieces(text, rows["h1"], rows["h2"])
    prefix, middle, suffix = (p.cast(pa.large_string()) for p in pieces)

    p, s, m, empty = (pa.scalar(x, pa.large_string()) for x in (PREFIX, SUFFIX, MIDDLE, ""))
    output = pc.case_when(
        pc.make_struct(plain, spm),
        text.cast(pa.large_string()),
        pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, empty),
        pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, empty),
    )
    none = pa.scalar(None, pa.int64())
    return pa.record_batch(
        {
            "doc_id": rows["doc_id"],
            "n": n,
            "form": pc.case_when(pc.make_struct(plain, spm), "plain", "spm", "psm"),
            "prefix_chars": pc.if_else(plain, none, pc.utf8_length(prefix).cast(pa.int64())),
            "middle_chars": pc.if_else(plain, none, pc.utf8_length(middle).cast(pa.int64())),
            "output": output.cast(pa.string()),
        }
    )


def _slices(rows: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text, one row at least."""
    size = pc.fill_null(pc.binary_length(rows["text"]), 0).to_numpy()
    part = np.cumsum(size) // most
    edges = np.flatnonzero(np.diff(part)) + 1
    for start, end in zip([0, *edges], [*edges, len(part)]):
        yield rows.slice(start, end - start)


def fill_in_middle(
    docs: DataFrame,
    seed: int = SEED,
    rate: int = RATE,
    suffix_first: int = SUFFIX_FIRST,
    slice_bytes: int = SLICE_BYTES,
) -> DataFrame:
    """doc_id, n (units), form (plain, spm, psm), prefix_chars, middle_chars, output; one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in _slices(batch, slice_bytes):
                if len(rows):
                    yield _transform(rows, rate, suffix_first)

    h = draws(F.col("doc_id"), seed)
    rows = docs.select("doc_id", "text", *[c.alias(f"h{i + 1}") for i, c in enumerate(h)])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, SCHEMA.replace("doc_id long", f"doc_id {kind}"))


def restored(form: Column, output: Column) -> Column:
    """The text an output was made from: no piece contains a marker, so four parts come back."""
    part = F.split(output, MARKERS, -1)
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(part[1], part[3], part[2]))
        .when(form == "spm", F.concat(part[2], part[3], part[1]))
    )
