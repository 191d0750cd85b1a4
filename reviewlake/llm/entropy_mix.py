"""Mixing sources to target weights by entropy balancing, in DataFrame operations only.

Wanted are rates, copies per document, that meet token targets and are otherwise as even as possible: they minimize the
relative entropy to the corpus, counted in words.  The dual of that problem is convex and has one multiplier per
constrained value; the best rates are exponential tilts, exp(sum of the multipliers that apply to a document).  Newton
steps solve the dual over the distributed totals; documents under the same constraints share a rate, so the totals are
summed per such cell first, which loses nothing.

Rates become whole copies by error diffusion.  The documents of a source are dealt into cells by size class and a hash,
large documents first; a cell takes one copy more than the whole part of the rate if that brings the words taken so far
nearest to what the rates ask for.  What large documents miss, smaller ones make up, so the last error is about half of
a cell of small documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import ranked, stored
from reviewlake.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
BUCKETS = 256
MOST_COPIES = 3
STEP = 2.0
SWEEPS = 60
TOLERANCE = 1e-9


def words_in(text: Column) -> Column:
    """Number of words; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def capped_shares(sources: DataFrame, weight: str, size: str, most: float = MOST_COPIES) -> DataFrame:
    """Add ``target``: the total size shared by weight, no source above ``most`` times its own size.

    What a capped source leaves goes to the others by weight, so all uncapped targets are weight * level; each round
    finds the next level from two sums.
    """
    cap = F.col(size) * float(most)
    total, level = sources.agg(F.sum(size).cast("double"), (F.sum(size) / F.sum(weight)).cast("double")).first()
    while total:
        over = F.col(weight) * F.lit(level) > cap
        capped, free = sources.agg(F.sum(F.when(over, cap)), F.sum(F.when(~over, F.col(weight).cast("double")))).first()
        higher = (total - (capped or 0.0)) / free if free else level
        if higher <= level * (1 + 1e-15):
            break
        level = higher
    return sources.withColumn("target", F.least(cap, F.col(weight) * F.lit(level or 0.0)).cast("double"))


def tilted_rates(cells: DataFrame, tokens: str, margins: dict[str, DataFrame]) -> DataFrame:
    """Add ``rate`` to cells: for each margin, a column and its (value, target) rows, the rates meet the targets.

    ``cells`` has one row per combination of the margin columns, with its ``tokens``.  One sweep takes, for each margin
    in turn, the Newton step of its multipliers (their Hessian is diagonal), cut to +-STEP.  Null is a value like others.
    """
    kept = cells.columns
    cells = cells.withColumn("_tilt", F.lit(0.0))
    for _ in range(SWEEPS):
        worst = 0.0
        for column, targets in margins.items():
            now = cells.groupBy(column).agg(F.sum(F.col(tokens) * F.exp("_tilt")).alias("_now"))
            goal = targets.select(F.col("value").alias("_value"), F.col("target").alias("_goal"))
            step = F.greatest(F.lit(-STEP), F.least(F.lit(STEP), F.col("_goal") / F.col("_now") - 1))
            moved = now.join(goal, now[column].eqNullSafe(goal["_value"])).select(
                "_value", F.when(F.col("_now") > 0, step).otherwise(0.0).alias("_step"))
            cells = cells.join(moved, cells[column].eqNullSafe(moved["_value"]), "left").withColumn(
                "_tilt", F.col("_tilt") + F.coalesce("_step", F.lit(0.0))).select(*kept, "_tilt", "_step")
            cells = cut_lineage(cells)
            worst = max(worst, cells.agg(F.max(F.abs("_step"))).first()[0] or 0.0)
            cells = cells.drop("_step")
        if worst < TOLERANCE:
            break
    return cells.withColumn("rate", F.exp("_tilt")).drop("_tilt")


def _cells() -> tuple[Column, Column]:
    """Size class (power of two) and hash bucket of a sized row."""
    return F.ceil(F.log2(F.col("_size") + 1)).cast("int"), F.pmod(F.xxhash64("_key"), F.lit(BUCKETS)).cast("int")


def copies_by_cell(sized: DataFrame, rates: DataFrame) -> DataFrame:
    """(_source, _class, _bucket, _copies) for all non-empty cells.

    A source has at most 64 * BUCKETS cells, whatever its size; they are put in order in one row and folded.
    """
    cells = sized.groupBy("_source", "_class", "_bucket").agg(F.sum("_size").alias("_tokens"))
    cells = cells.join(rates.select(F.col("_source").alias("_s"), "_rate"), F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    entry = F.struct((-F.col("_class")).alias("order"), F.col("_bucket").alias("bucket"), F.col("_tokens").alias("tokens"))
    lists = cells.groupBy("_source", "_rate").agg(F.sort_array(F.collect_list(entry)).alias("cells"))
    base = F.floor(F.col("_rate"))

    def decided(state: Column, cell: Column) -> Column:
        owed = state["owed"] + (F.col("_rate") - base) * cell["tokens"]
        more = (owed > 0) & (owed * 2 >= cell["tokens"])
        return F.struct((owed - F.when(more, cell["tokens"]).otherwise(0)).cast("double").alias("owed"),
                        F.when(more, F.concat(state["taken"], F.array(F.struct(cell["order"], cell["bucket"]))))
                        .otherwise(state["taken"]).alias("taken"))

    start = F.struct(F.lit(0.0).alias("owed"), F.array().cast("array<struct<order:int,bucket:int>>").alias("taken"))
    chosen = lists.select("_source", base.alias("_base"), "cells", F.aggregate("cells", start, decided)["taken"].alias("taken"))
    return chosen.select("_source", "_base", F.explode("cells").alias("cell"), "taken").select(
        "_source", (-F.col("cell.order")).alias("_class"), F.col("cell.bucket").alias("_bucket"),
        (F.col("_base") + F.array_contains("taken", F.struct("cell.order", "cell.bucket")).cast("int")).cast("int").alias("_copies"))


def mixed(docs: DataFrame, source: Column, size: Column, key: Column, weights: tuple[int, ...] = (5, 2, 1)) -> DataFrame:
    """Add ``source_size``, ``target`` (words, its source's) and ``copies`` (0 to MOST_COPIES) to every document.

    * Sources in code point order, null last, get the weights in turn; they share all words, capped at MOST_COPIES times
      their own.  ``size`` gives a row's words, ``key`` what its place is drawn from, so reruns agree.
    * Rows equal in source, size and key get equal copies; a document without words takes none of them.
    * A source without words has target 0.  An empty table stays empty.
    * Other columns are kept; columns named like the added ones are replaced.
    """
    docs = docs.drop("source_size", "target", "copies")
    sized = docs.withColumns({"_source": source, "_size": size, "_key": key})
    spot = dict(zip(("_class", "_bucket"), _cells()))
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("_total"))
    sources = ranked(totals, [F.col("_source").asc_nulls_last()], "_rank")
    turn = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sources = stored(capped_shares(cut_lineage(sources.withColumn("_weight", turn)), "_weight", "_total"), "shares")
    rates = tilted_rates(sources.select("_source", "_total"), "_total",
                         {"_source": sources.select(F.col("_source").alias("value"), "target")})
    rates = rates.select("_source", F.least("rate", F.lit(float(MOST_COPIES))).alias("_rate"))
    plan = copies_by_cell(sized.withColumns(spot).select("_source", "_size", "_class", "_bucket"), rates)
    plan = plan.join(sources.select(F.col("_source").alias("_s"), "_total", "target"), F.col("_source").eqNullSafe(F.col("_s")))
    plan = stored(plan.select(F.col("_source").alias("_s"), F.col("_class").alias("_c"), F.col("_bucket").alias("_b"),
                              F.col("_total").alias("source_size"), "target", F.col("_copies").alias("copies")), "mix-plan")
    return (
        sized.withColumns(spot)
        .join(plan, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_bucket") == F.col("_b")))
        .select(*docs.columns, "source_size", "target", F.when(F.col("_size") > 0, F.col("copies")).otherwise(0).alias("copies")))
