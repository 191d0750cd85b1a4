"""Run observability: token pricing, summaries and rollups over run metrics."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.jsnum import exact_sum, half_up, round_micro, total
from reviewlake.session import cut_lineage, local_table

# Where a run can come from.
SOURCES = ("pipeline", "application", "ide")


Prices = list[tuple[int, str, float, float]]


def _listed_price(prices: Prices) -> tuple[Column, Column]:
    """Input and output price of ``model`` from a constant list, as expressions over one CASE."""
    model = F.col("model")
    row = F.when(model.isNull(), F.lit(None).cast("int"))
    for position, (_, key, _, _) in enumerate(prices):
        row = row.when(model == key, position)
    for position, (_, key, _, _) in enumerate(prices):
        row = row.when(model.startswith(key), position)
    return (F.get(F.array(*[F.lit(float(p[2])) for p in prices]), row),
            F.get(F.array(*[F.lit(float(p[3])) for p in prices]), row))


def _cost(price_in: Column, price_out: Column) -> Column:
    usd = (F.coalesce("input_tokens", F.lit(0)) / F.lit(1e6) * price_in
           + F.coalesce("output_tokens", F.lit(0)) / F.lit(1e6) * price_out)
    return F.coalesce(round_micro(usd), F.lit(0.0)).alias("cost_usd")


def token_cost(runs: DataFrame, pricing: DataFrame | Prices, longest_prefix: bool = False) -> DataFrame:
    """Add ``cost_usd``: exact model match, else the first price key that is a prefix; unknown is free.

    A price list given as rows becomes part of the projection: no join, no shuffle, and it works on
    streams.  For a price table only the distinct model names meet the price list (a handful of rows after partial
    aggregation); the runs then join their model's price by equality.
    """
    if isinstance(pricing, list):
        ranked = sorted(pricing, key=lambda p: -len(p[1])) if longest_prefix else pricing
        return runs.select("*", _cost(*_listed_price(ranked)))
    order = -F.length("model_key") if longest_prefix else F.col("ordinal")
    preference = F.struct(F.when(F.col("model") == F.col("model_key"), 0).otherwise(1), order)
    # Every prefix of the few model names, so that the join is by equality.
    prefixes = F.explode(F.transform(F.sequence(F.lit(1), F.length("model")), lambda n: F.left("model", n)))
    resolved = (
        runs.select("model").where(F.coalesce("model", F.lit("")) != "").distinct()
        .select("model", prefixes.alias("model_key"))
        .join(pricing, "model_key")
        .groupBy("model")
        .agg(F.min_by(F.struct("input_per_m", "output_per_m"), preference).alias("price"))
        .select("model", "price.input_per_m", "price.output_per_m")
    )
    priced = runs.join(resolved, "model", "left")
    return priced.select(*runs.columns, _cost(F.col("input_per_m"), F.col("output_per_m")))


def _measures() -> list[Column]:
    return [
        F.count("*").alias("total_runs"),
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failure").alias("failure_count"),
        *[total(c).alias(n) for c, n in (
            ("total_tokens", "total_tokens_consumed"), ("input_tokens", "total_input_tokens"),
            ("output_tokens", "total_output_tokens"), ("request_count", "total_requests"),
            ("files_reviewed", "total_files_reviewed"), ("issues_found", "total_issues_found"),
            ("critical_count", "total_critical"), ("high_count", "total_high"), ("latency_ms", "latency_sum"),
        )],
        F.count("latency_ms").alias("latency_rows"),
        F.coalesce(F.sum(F.col("cost_usd").cast("decimal(18,6)")), F.lit(0).cast("decimal(28,6)")).alias("cost"),
    ]


_ADDITIVE = (
    "total_runs", "success_count", "failure_count", "total_tokens_consumed", "total_input_tokens",
    "total_output_tokens", "total_requests", "total_files_reviewed", "total_issues_found", "total_critical",
    "total_high", "latency_sum", "latency_rows", "cost",
)


def _summary_columns() -> list[Column]:
    runs = F.col("total_runs")
    cost = F.col("cost").cast("double")

    def per_run(value: Column) -> Column:
        return F.when(runs > 0, value / F.nullif(runs, F.lit(0)))

    zero = F.lit(0)
    return [
        runs, F.col("success_count"), F.col("failure_count"),
        F.coalesce(half_up(per_run(F.col("success_count")) * 100), zero).alias("success_rate"),
        F.col("total_tokens_consumed"), F.col("total_input_tokens"), F.col("total_output_tokens"),
        F.col("total_requests"),
        F.coalesce(F.round(F.try_divide("latency_sum", "latency_rows")), F.lit(0.0)).alias("avg_latency_ms"),
        F.coalesce(half_up(per_run(F.col("total_tokens_consumed"))), zero).alias("avg_tokens_per_run"),
        F.col("total_files_reviewed"), F.col("total_issues_found"), F.col("total_critical"), F.col("total_high"),
        round_micro(cost).alias("total_cost_usd"),
        F.coalesce(round_micro(per_run(cost)), F.lit(0.0)).alias("avg_cost_per_run"),
        F.col("repositories"), F.col("projects"),
    ]


def _totals(groups: DataFrame, by: list[str]) -> DataFrame:
    """Second level of the summary: the groups are one row per (by, repository, project)."""
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _ADDITIVE]
    distinct = [F.count_distinct("repository").alias("repositories"), F.count_distinct("project_id").alias("projects")]
    return groups.groupBy(*by).agg(*sums, *distinct)


def summary_groups(runs: DataFrame, by: list[str]) -> DataFrame:
    """Sums per (``by``, repository, project) that add up over parts of the runs."""
    return runs.groupBy(*by, "repository", "project_id").agg(*_measures())


def summary_of_groups(groups: DataFrame, by: list[str]) -> DataFrame:
    """The 18 measures per ``by`` from any number of stored :func:`summary_groups`."""
    merged = groups.groupBy(*by, "repository", "project_id").agg(*[F.sum(c).alias(c) for c in _ADDITIVE])
    return _totals(merged, by).select(*by, *_summary_columns())


def metrics_summary(runs: DataFrame) -> DataFrame:
    """The 18 dashboard measures over all given runs; zeros when there are none.

    Two levels: sums per (repository, project) first, then the totals and both distinct counts over
    those few groups, so the distinct counts never see the run rows.
    """
    return _totals(runs.groupBy("repository", "project_id").agg(*_measures()), []).select(*_summary_columns())


def metrics_by_source(runs: DataFrame) -> DataFrame:
    """The summary per source; a source without runs keeps a row of zeros."""
    groups = runs.groupBy("source", "repository", "project_id").agg(*_measures())
    domain = local_table(runs.sparkSession, [(s,) for s in SOURCES], "source string")
    filled = domain.join(_totals(groups, ["source"]), "source", "left")
    zeros = {c: F.coalesce(c, F.lit(0)) for c in (*_ADDITIVE, "repositories", "projects")}
    return filled.withColumns(zeros).select("source", *_summary_columns())


def projects_rollup(runs: DataFrame) -> DataFrame:
    """Runs, last run, success rate and cost per project and repository, latest first."""
    success = F.count_if(F.col("status") == "success")
    return (
        runs.groupBy("project_id", "repository")
        .agg(
            F.count("*").alias("run_count"),
            F.max("ts").alias("last_run"),
            F.round(success / F.count("*") * 100).alias("success_rate"),
            exact_sum(F.col("cost_usd")).alias("total_cost_usd"),
        )
        .orderBy(F.desc("last_run"), "project_id", "repository")
    )


def distinct_repositories(runs: DataFrame) -> DataFrame:
    return runs.select("repository").where(F.coalesce("repository", F.lit("")) != "").distinct()


def token_totals(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Token totals, number of calls and the model of the last call."""
    return runs.groupBy(*(by or [])).agg(
        total("input_tokens").alias("total_input_tokens"),
        total("output_tokens").alias("total_output_tokens"),
        F.count("*").alias("call_count"),
        F.max_by(F.coalesce("model", F.lit("")), F.struct("ts", "id")).alias("last_model"),
    )


def running_token_totals(runs: DataFrame, by: tuple[str, ...] = ("source",), order: tuple[str, ...] = ("ts", "id")) -> DataFrame:
    """The totals after each call: one row per call with its keys, in the order of ``order`` within ``by``.

    A prefix scan in two levels: rows are sorted by ranges, so a source with most of the rows spans many tasks; a row's totals are
    those of its range so far plus the sums of the source's ranges before.
    """
    counts = {"total_input_tokens": F.coalesce("input_tokens", F.lit(0)), "total_output_tokens": F.coalesce("output_tokens", F.lit(0)),
              "call_count": F.lit(1).cast("long")}
    keys = [F.col(c) for c in (*by, *order)]
    rows = runs.select(*keys, *[c.alias(n) for n, c in counts.items()], F.coalesce("model", F.lit("")).alias("last_model"))
    laid = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id())
    laid = cut_lineage(laid).withColumn("range", F.shiftright("place", 33))
    ranges = laid.groupBy(*by, "range").agg(*[F.sum(c).alias(c) for c in counts])
    earlier = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*[F.col(c).alias(f"of_{c}") for c in (*by, "range")], *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in counts])
    so_far = Window.partitionBy(*by, "range").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in (*by, "range")])
    summed = laid.withColumns({c: F.sum(c).over(so_far) for c in counts}).join(ranges, same)
    return summed.select(*keys, *[(F.col(c) + F.col(f"before_{c}")).alias(c) for c in counts], "last_model")


def summary_bands(summary: DataFrame, band) -> DataFrame:
    """Summary with the band of its success rate."""
    return summary.withColumn("success_band", band(F.col("success_rate")))
