"""Voice and transcript catalogs: cache look-up, request planning, ordered text assembly."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonaria.constants import AUDIO_SUFFIXES, DEFAULT_VOICE, FORMAT_MIME
from sonaria.functions import text
from sonaria.session import materialise


def accepted_upload(name: Column) -> Column:
    return text.suffix(name).isin(*AUDIO_SUFFIXES)


def cached_transcripts(
    keys: DataFrame,
    cache: DataFrame,
    compute: Callable[[DataFrame], DataFrame],
    key: list[str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Text of every content key: from the cache, else computed once per distinct key.

    Returns (key, text, hit) per distinct key and the cache rows to add. Copies collapse before
    anything is joined, so a clip that fills a third of the input is looked up and computed once.
    """
    key = key or ["sha1"]
    known = cache.select(*key, F.col("text"), F.lit(True).alias("hit"))
    # The distinct keys are looked up once; hits and misses are read from what that wrote.
    looked_up = materialise(
        keys.select(*key).distinct().join(known, key, "left").withColumn("hit", F.coalesce("hit", F.lit(False))),
        "looked-up",
    )
    fresh = compute(looked_up.where(~F.col("hit")).select(*key)).select(*key, "text")
    fresh = materialise(fresh, "transcripts")
    found = looked_up.where("hit").select(*key, "text", "hit")
    return found.unionByName(fresh.withColumn("hit", F.lit(False))), fresh


def effective_voice(voice_id: Column) -> Column:
    return F.coalesce(F.nullif(voice_id, F.lit("")), F.lit(DEFAULT_VOICE))


def mime_type(fmt: Column) -> Column:
    pairs = [F.lit(x) for item in FORMAT_MIME.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), fmt)


def plan_requests(requests: DataFrame, voices: DataFrame) -> DataFrame:
    """Checks synthesis requests and joins their voice; status 200, 400 (blank text), 404 (no such
    voice) or 422 (unknown format). Refused rows keep their place with the reason."""
    known = voices.select(
        F.col("voice_id").alias("voice"), F.col("ref_text"), F.lit(True).alias("_known")
    )
    joined = requests.withColumn("voice", effective_voice(F.col("voice_id"))).join(
        known, "voice", "left"
    )
    status = (
        F.when(mime_type(F.col("format")).isNull(), 422)
        .when(text.is_blank(F.col("text")), 400)
        .when(F.col("_known").isNull(), 404)
        .otherwise(200)
    )
    clean = text.strip(F.col("text"))
    return (
        joined.withColumn("status", status)
        .withColumn("text", clean)
        .withColumn("mime", mime_type(F.col("format")))
        .withColumn("est_seconds", text.speech_seconds(clean))
        .drop("_known")
    )


def _join_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one key and block whose orders follow each other as a run: its first order, where its pieces
    end (in bytes, four bytes each), their text, and how many were null. Orders that are no whole numbers are runs of
    their own."""
    for batch in batches:
        key, block, order, piece = batch.columns
        n = len(batch)
        if not n:
            continue
        new = np.ones(n, dtype=bool)
        if pa.types.is_integer(order.type):
            codes = [pc.dictionary_encode(c, null_encoding="encode").indices.to_numpy() for c in (key, block)]
            whole = order.cast(pa.int64())
            number = pc.fill_null(whole, 0).to_numpy()
            new[1:] = number[1:] != number[:-1] + 1
            for code in codes:
                new[1:] |= code[1:] != code[:-1]
            null = order.is_null().to_numpy(zero_copy_only=False)
            new[1:] |= null[1:] | null[:-1]
        first = np.flatnonzero(new)
        missing = np.add.reduceat(piece.is_null().to_numpy(zero_copy_only=False).astype(np.int64), first)
        piece = pc.fill_null(piece, "")
        # The texts of a run lie side by side, so a run is a stretch of the same bytes.
        large = piece.cast(pa.large_string())
        ends = np.frombuffer(large.buffers()[1], dtype=np.int64)[large.offset :][: n + 1]
        edges = np.append(first, n)
        text = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(ends[edges].copy()), large.buffers()[2])
        stops = ends[1:] - np.repeat(ends[first], np.diff(edges))
        at = pa.py_buffer((4 * edges).astype(np.int32))
        stops = pa.Array.from_buffers(pa.binary(), len(first), [None, at, pa.py_buffer(stops.astype(">i4"))])
        rows = pa.array(first)
        yield pa.RecordBatch.from_arrays(
            [key.take(rows), block.take(rows), order.take(rows), stops, text.cast(pa.string()), pa.array(missing)],
            [*batch.schema.names[:3], "_ends", "_text", "_missing"],
        )


def _in_order(runs: Column) -> Column:
    """The text of a group's runs. Runs that overlap, as those of repeated keys, are taken apart first."""

    def by_order(left: Column, right: Column) -> Column:
        a, b = left["_order"], right["_order"]
        return F.when(a.eqNullSafe(b), 0).when(a.isNull() | (a < b), -1).otherwise(1)

    def count(run: Column) -> Column:
        return (F.octet_length(run["_ends"]) / 4).cast("int")

    def pieces(run: Column) -> Column:
        def end(i: Column) -> Column:
            return F.conv(F.hex(F.substring(run["_ends"], 4 * i + 1, F.lit(4))), 16, 10).cast("int")

        def piece(i: Column) -> Column:
            begin = F.when(i == 0, 0).otherwise(end(i - 1))
            # Places of bytes, unlike those of characters, are found without a look at all before them.
            return F.substring(run["_text"].cast("binary"), begin + 1, end(i) - begin).cast("string")

        return F.transform(
            F.sequence(F.lit(0), count(run) - 1),
            lambda i: F.struct((run["_order"] + i).alias("_order"), piece(i).alias("_text")),
        )

    ordered = F.array_sort(runs, by_order)
    others = F.greatest(F.size(ordered) - 1, F.lit(0))
    follows = F.zip_with(
        F.slice(ordered, 1, others), F.slice(ordered, 2, others), lambda a, b: a["_order"] + count(a) <= b["_order"]
    )
    loose = F.array_sort(F.flatten(F.transform(runs, pieces)), by_order)
    apart = F.forall(follows, lambda x: F.coalesce(x, F.lit(True)))
    texts = [F.array_join(F.transform(parts, lambda part: part["_text"]), "") for parts in (ordered, loose)]
    return F.when(apart, texts[0]).otherwise(texts[1])


def ordered_text(
    rows: DataFrame,
    key: str,
    order: str,
    value: Column,
    lead: str = "",
    block: int = 4096,
    complete: bool = False,
) -> DataFrame:
    """Ordered concatenation per key. Rows that already follow each other are joined to runs before
    anything is grouped, so what is sorted and shuffled are texts and not their pieces; then runs to blocks, so that
    no group holds more than one block of loose pieces, and blocks to the text.

    Null pieces are skipped; with ``complete`` a key that has one is left out.
    """
    pieces = rows.select(
        key,
        F.floor(F.col(order) / block).alias("_block"),
        F.col(order).alias("_order"),
        F.concat(F.lit(lead), value).alias("_piece"),
    )
    kinds = {field.name: field.dataType.simpleString() for field in pieces.schema}
    runs = pieces.mapInArrow(
        _join_runs,
        f"`{key}` {kinds[key]}, _block {kinds['_block']}, _order {kinds['_order']}, "
        "_ends binary, _text string, _missing long",
    ).repartition(key)
    joined = runs.groupBy(key, "_block").agg(
        _in_order(F.collect_list(F.struct("_order", "_ends", "_text"))).alias("_piece"),
        F.sum("_missing").alias("_missing"),
    )
    texts = joined.groupBy(key).agg(
        F.expr("listagg(_piece, '') WITHIN GROUP (ORDER BY _block)").alias("text"),
        F.sum("_missing").alias("_missing"),
    )
    if complete:
        texts = texts.where(F.col("_missing") == 0)
    return texts.drop("_missing")


def label_tokens(tokens: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text) of the texts whose labels are all known, and the rejected tokens.

    The label table has a fixed 33 rows, which bounds its broadcast.
    """
    labels = F.broadcast(text.label_table(tokens.sparkSession))
    marked = tokens.join(labels, "label", "left")
    token = F.concat(text.apply_case(text.strip(F.col("word")), F.col("case_mode")), F.col("mark"))
    texts = ordered_text(marked, "doc_id", "pos", token, lead=" ", complete=True)
    rejects = marked.where(F.col("mark").isNull()).select(*tokens.columns)
    return texts, rejects
