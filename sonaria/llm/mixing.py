"""Mixing sources to target weights by subset-sum budget fitting.

Sizes are counted in words. Sources share the total by weight; a target stops at three times its
source and the excess is shared again. A source is then taken whole as often as it fits,
and the rest of its budget is fitted on the histogram of exact lengths: the same share of every
length first, long documents next, and a bounded-knapsack dynamic programme for the last words. Which
documents of a length are taken is decided by a seeded hash: the plan names a count per length, and a
cut through the hashes gives exactly that many documents, so no text is shuffled to choose. The cut
is found digit by digit of the hashes, on counts; documents are never ranked.

Defined cases: a null text has size 0; a null source is a source of its own, the last one; a null
id is hashed as ''; of documents with the hash of the cut (repeated rows) as many are taken as the plan
asks for, the smaller ids first; empty tables give an empty result; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonaria.operators.dataset import stable_index
from sonaria.session import materialise

MOST = 3
WEIGHTS = 3
SEED = 20
#: Words of a budget that the dynamic programme fits; the same share of every length takes the rest.
DP_BUDGET = 16_384
WORD = r"[^\x20\x09-\x0D]+"
#: Leading bits of the hashes by which the cut is narrowed down; at last whole hashes are counted.
DIGITS = (10, 20, 64)


def fit_counts(
    sizes: np.ndarray, counts: np.ndarray, budget: int, dp_budget: int = DP_BUDGET
) -> np.ndarray:
    """How many documents of each length to take so that their words come to ``budget``, or as
    near to it as the search finds."""
    total = int((sizes * counts).sum())
    take = np.zeros(len(sizes), dtype=np.int64)
    if total == 0 or budget <= 0:
        return take
    for i in range(len(sizes)):
        take[i] = min(int(counts[i]), int(counts[i]) * budget // total)
    rest = budget - int((sizes * take).sum())
    left = counts - take
    order = np.argsort(-sizes, kind="stable")
    for i in order:
        size = int(sizes[i])
        if rest <= dp_budget:
            break
        if 0 < size <= rest:
            more = min(int(left[i]), -(-(rest - dp_budget) // size), rest // size)
            take[i] += more
            left[i] -= more
            rest -= more * size
    # Reachable sums as bits of one integer; an item is a power of two of equal documents.
    rest = min(rest, dp_budget)
    mask, reach, steps = (1 << (rest + 1)) - 1, 1, []
    for i in order:
        size, free, bundle = int(sizes[i]), int(left[i]), 1
        if size == 0 or size > rest:
            continue
        free = min(free, rest // size)
        while free and not reach >> rest & 1:
            bundle = min(bundle, free)
            steps.append((i, bundle, reach))
            reach |= (reach << (bundle * size)) & mask
            free -= bundle
            bundle *= 2
    sum_now = reach.bit_length() - 1
    for i, bundle, before in reversed(steps):
        if not before >> sum_now & 1:
            take[i] += bundle
            sum_now -= bundle * int(sizes[i])
    # One more document if it lands nearer above the budget than the sum stays below it.
    gap = budget - int((sizes * take).sum())
    above = np.flatnonzero((take < counts) & (sizes > gap) & (sizes < 2 * gap))
    if len(above):
        take[above[sizes[above].argmin()]] += 1
    return take


def _fit_source(rows: pd.DataFrame) -> pd.DataFrame:
    """Repeats and extra documents for each length of one source; a source has at most as many rows
    here as it has different lengths."""
    sizes, counts = rows["size"].to_numpy(), rows["n"].to_numpy()
    target, whole = float(rows["target"].iloc[0]), int(rows["source_size"].iloc[0])
    repeats = min(MOST, int(target // whole)) if whole else 0
    budget = min(round(target - repeats * whole), whole) if repeats < MOST else 0
    extra = fit_counts(sizes, counts, budget)
    return rows[["s_null", "s_key", "size", "n", "source_size", "target"]].assign(
        repeats=repeats, extra=extra
    )


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds target to rows (s_null, s_key, source_size); the caller has written them.

    Water filling: at a level every source gets level times weight or its limit. Each round is one
    aggregate over the sources, and the level only rises.
    """
    ranked = stable_index(sources, ["s_null", "s_key"], "_rank").withColumn(
        "_weight", F.col("_rank") % WEIGHTS + 1
    )
    total, weight = ranked.agg(F.sum("source_size"), F.sum("_weight")).first()
    limit = MOST * F.col("source_size")
    level, capped = (total or 0) / (weight or 1), -1
    while True:
        above = limit < F.lit(level) * F.col("_weight")
        n, fixed, open_weight = ranked.agg(
            F.count_if(above),
            F.sum(F.when(above, limit).otherwise(0)),
            F.sum(F.when(above, 0).otherwise(F.col("_weight"))),
        ).first()
        if n == capped or not open_weight:
            break
        capped, level = n, (total - fixed) / open_weight
    return ranked.withColumn(
        "target", F.least(limit.cast("double"), F.lit(float(level)) * F.col("_weight"))
    ).drop("_rank", "_weight")


def measured(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The columns that decide: s_null, s_key, size and the seeded hash of a document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumns(
        {
            "s_null": F.col("source").isNull(),
            "s_key": F.coalesce(F.col("source").cast("string"), F.lit("")),
            "size": F.regexp_count(text, F.lit(WORD)).cast("long"),
            "_draw": F.xxhash64(
                F.lit(seed),
                F.coalesce(F.col("doc_id").cast("string"), F.lit("")),
                F.xxhash64(text),
            ),
        }
    )


def mixing_plan(rows: DataFrame) -> DataFrame:
    """(s_null, s_key, size) -> source_size, target, repeats and whom to take once more: draws below
    ``cut``, and ``at_cut`` of the ``n_cut`` with the draw itself. ``rows`` are measured and written."""
    key = ["s_null", "s_key", "size"]
    lengths = materialise(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), "lengths")
    sources = materialise(
        lengths.groupBy("s_null", "s_key").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
        "sources",
    )
    fitted = materialise(
        lengths.join(source_targets(sources), ["s_null", "s_key"])
        .groupBy("s_null", "s_key")
        .applyInPandas(
            _fit_source,
            "s_null boolean, s_key string, size long, n long, source_size long, target double,"
            " repeats int, extra long",
        ),
        "fitted",
    )
    drawn = rows.select(*key, "_draw")
    # Where the count is reached: in which digit, and after how many documents of it.
    edge = fitted.where(F.col("extra") > 0).select(*key, F.col("extra").alias("need"), F.lit(0).cast("long").alias("at"))
    upto = Window.partitionBy(*key).orderBy("digit")
    known = 0
    for bits in DIGITS:
        pool = drawn.withColumns({"at": _digit(known), "digit": _digit(bits)})
        counted = pool.groupBy(*key, "at", "digit").agg(F.count(F.lit(1)).alias("c"))
        reached = counted.join(edge.drop("c"), [*key, "at"]).withColumn("s", F.sum("c").over(upto))
        edge = reached.where((F.col("s") >= F.col("need")) & (F.col("s") - F.col("c") < F.col("need"))).select(
            *key, (F.col("need") - F.col("s") + F.col("c")).alias("need"), F.col("digit").alias("at"), "c"
        )
        edge, known = materialise(edge, "cuts"), bits
    cuts = edge.select(*key, F.col("at").alias("cut"), F.col("need").alias("at_cut"), F.col("c").alias("n_cut"))
    return fitted.join(cuts, key, "left").select(
        *key, "source_size", "target", "repeats", "cut", "at_cut", "n_cut"
    )


def _digit(bits: int):
    """The leading bits of a draw, in its order; no bits are one digit."""
    return F.shiftright("_draw", 64 - bits) if 0 < bits < 64 else F.col("_draw") if bits else F.lit(0).cast("long")


def _shared(planned: DataFrame, same: list[str]) -> tuple[DataFrame, DataFrame]:
    """``planned`` rows with the copies ``_times`` of each, and rows of which only some are taken once more:
    those have one row for all that are equal in ``same``, with ``_n`` of them and ``_more`` once more."""
    on_cut = F.coalesce((F.col("_draw") == F.col("cut")) & (F.col("at_cut") < F.col("n_cut")), F.lit(False))
    more = F.coalesce(F.col("_draw") <= F.col("cut"), F.lit(False)).cast("int")
    sure = planned.where(~on_cut).withColumn("_times", F.col("repeats") + more)
    key = ["s_null", "s_key", "size"]
    alike = planned.where(on_cut).groupBy(
        *key, "source_size", "target", "repeats", "at_cut", *same
    ).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy(*same).rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("at_cut") - F.coalesce(F.sum("_n").over(before), F.lit(0))
    return sure, alike.withColumn("_more", F.greatest(F.lit(0), F.least("_n", left)))


def mix(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken, one row per document."""
    rows = materialise(
        measured(docs.select("doc_id", "text", "source"), seed).select(
            "doc_id", "s_null", "s_key", "size", "_draw"
        ),
        "measured",
    )
    sure, alike = _shared(rows.join(mixing_plan(rows), ["s_null", "s_key", "size"]), ["doc_id"])
    each = alike.withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n")))).withColumn(
        "_times", F.col("repeats") + (F.col("_i") <= F.col("_more")).cast("int")
    )
    columns = ["doc_id", "size", "source_size", "target", "_times"]
    return sure.select(*columns).unionByName(each.select(*columns)).select(
        *columns[:-1], (F.col("size") * F.col("_times")).cast("long").alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """The mix itself: rows of ``docs`` with all their columns, each as often as it is taken."""
    names = docs.columns
    whole = docs.select(F.struct(*names).alias("_row"), "doc_id", "text", "source")
    rows = measured(whole, seed)
    plan = mixing_plan(
        materialise(rows.select("s_null", "s_key", "size", "_draw"), "measured")
    )
    planned = rows.drop("doc_id", "text", "source").join(plan, ["s_null", "s_key", "size"])
    sure, alike = _shared(planned, ["_row"])
    total = alike.withColumn("_times", F.col("repeats") * F.col("_n") + F.col("_more"))
    taken = sure.select("_row", "_times").unionByName(total.select("_row", "_times")).where("_times > 0")
    repeated = taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("_copy"))
    return repeated.select("_row.*")
