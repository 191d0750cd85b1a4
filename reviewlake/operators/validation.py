"""Validation with a reject reason, and defaults for missing fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.jsnum import is_blank
from reviewlake.operators.metrics import Prices, token_cost

# Allowed states.
STATUSES = ("success", "failure", "partial")
GATES = ("pass", "fail")
ACTIONS = ("accept", "reject", "modify")
CHANNELS = ("dashboard", "gh", "pr")


def _missing(fields: list[str]) -> Column:
    """'Missing required fields: a, b' or NULL."""
    names = F.array_compact(F.array(*[F.when(is_blank(F.col(f)), f) for f in fields]))
    return F.when(F.size(names) > 0, F.concat(F.lit("Missing required fields: "), F.array_join(names, ", ")))


def _outside(column: str, allowed: tuple[str, ...]) -> Column:
    return ~is_blank(F.col(column)) & ~F.col(column).isin(*allowed)


def metric_reject_reason() -> Column:
    return F.when(
        _outside("status", STATUSES),
        F.concat(F.lit("Invalid status: "), "status", F.lit(". Must be success|failure|partial.")),
    ).otherwise(_missing(["repository", "project_id", "workflow_run_id"]))


def run_reject_reason() -> Column:
    return F.coalesce(
        _missing(["run_id", "repository", "workflow_run_id"]),
        F.when(_outside("status", STATUSES), F.concat(F.lit("Invalid status: "), "status")),
        F.when(_outside("gate_status", GATES), F.concat(F.lit("Invalid gate_status: "), "gate_status")),
    )


def _split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    return checked.where("reject_reason IS NULL").drop("reject_reason"), checked.where("reject_reason IS NOT NULL")


def validate_metrics(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with ``reject_reason``)."""
    return _split(df.withColumn("reject_reason", metric_reject_reason()))


def validate_runs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(df.withColumn("reject_reason", run_reject_reason()))


def check_feedback(df: DataFrame, records: DataFrame) -> DataFrame:
    """Feedback with ``record_id`` and ``reject_reason``: run given, known action, run has a record."""
    known = records.select("run_id", F.col("id").alias("record_id"))
    reason = (
        F.when(is_blank(F.col("run_id")), "run_id is required")
        .when(is_blank(F.col("action")) | ~F.col("action").isin(*ACTIONS),
              "action must be 'accept', 'reject', or 'modify'")
        .when(F.col("record_id").isNull(), F.concat(F.lit("No training record found for run_id: "), "run_id"))
    )
    # Rows without a run id are decided already: they would all meet under one key.
    named = df.where(~is_blank(F.col("run_id"))).join(known, "run_id", "left")
    unnamed = df.where(is_blank(F.col("run_id"))).withColumn("record_id", F.lit(None).cast(records.schema["id"].dataType))
    return named.unionByName(unnamed).withColumn("reject_reason", reason)


def validate_feedback(df: DataFrame, records: DataFrame) -> tuple[DataFrame, DataFrame]:
    return _split(check_feedback(df, records))


def normalise_metrics(df: DataFrame, pricing: DataFrame | Prices) -> DataFrame:
    """Defaults: counters 0, status success, source pipeline, total = in + out, cost from the price list."""
    counters = ["request_count", "input_tokens", "output_tokens", "latency_ms", "files_reviewed", "issues_found",
                "critical_count", "high_count"]
    filled = df.withColumns({c: F.coalesce(c, F.lit(0)) for c in counters}).withColumns({
        "total_tokens": F.coalesce("total_tokens", F.col("input_tokens") + F.col("output_tokens")),
        "status": F.coalesce("status", F.lit("success")),
        "source": F.coalesce("source", F.lit("pipeline")),
    }).withColumnRenamed("cost_usd", "given_cost")
    priced = token_cost(filled, pricing)
    return priced.withColumn("cost_usd", F.coalesce("given_cost", "cost_usd")).select(*df.columns)


def normalise_runs(df: DataFrame) -> DataFrame:
    """Defaults for a stored run; a missing runtime is the latency."""
    counters = ["total_issues", "critical_count", "high_count", "medium_count", "low_count", "files_reviewed",
                "input_tokens", "output_tokens", "total_tokens", "latency_ms"]
    zeros = F.struct(*[F.lit(0).cast("long").alias(s) for s in ("critical", "high", "medium", "low", "info")])
    has = set(df.columns)

    def given(name: str, default: Column) -> Column:
        return F.coalesce(name, default) if name in has else default

    out = {c: given(c, F.lit(0).cast("long")) for c in counters}
    out |= {
        "runtime_ms": F.coalesce(*([F.col("runtime_ms")] if "runtime_ms" in has else []),
                                 *([F.col("latency_ms")] if "latency_ms" in has else []), F.lit(0).cast("long")),
        "gate_status": given("gate_status", F.lit("pass")),
        "status": given("status", F.lit("success")),
        "source": given("source", F.lit("pipeline")),
        "cost_usd": given("cost_usd", F.lit(0.0)),
        "severity_distribution": given("severity_distribution", zeros),
    }
    return df.withColumns(out)


def normalise_feedback(df: DataFrame, records: DataFrame) -> DataFrame:
    """Valid feedback with its record id, default channel and empty corrections."""
    valid, _ = validate_feedback(df, records)
    corrected = F.col("corrected_findings") if "corrected_findings" in df.columns else F.lit(None).cast("string")
    return valid.withColumns({
        "feedback_channel": F.coalesce("feedback_channel", F.lit("dashboard")),
        "corrected_findings": F.coalesce(corrected, F.lit("[]")),
    })


def valid_files(files: DataFrame) -> DataFrame:
    """Reviewable files: path, content and language are present."""
    return files.where(~is_blank(F.col("path")) & ~is_blank(F.col("content")) & ~is_blank(F.col("language")))


def check_review_requests(requests: DataFrame, files: DataFrame) -> DataFrame:
    """Requests with ``reject_reason``: no files, no repository or no workflow run."""
    counts = files.groupBy("run_id").agg(F.count("*").alias("file_count"))
    reason = (
        F.when(F.coalesce("file_count", F.lit(0)) == 0, "files array is required and must not be empty")
        .when(is_blank(F.col("repository")), "metadata.repository is required")
        .when(is_blank(F.col("workflow_run_id")), "metadata.workflow_run_id is required")
    )
    return requests.join(counts, "run_id", "left").withColumn("reject_reason", reason)


def normalise_ide_run(df: DataFrame) -> DataFrame:
    """Defaults of an editor or web run: one inline file, an actor by source, a repository by language."""
    source = F.when(F.col("source") == "application", "application").otherwise("ide")
    actor = F.trim(F.coalesce("user_id", F.lit("")))
    default_actor = F.when(source == "application", "webapp-user").otherwise("terminal-user")
    return df.select(
        "run_id",
        source.alias("source"),
        F.when(actor != "", actor).otherwise(default_actor).alias("actor"),
        F.when(is_blank(F.col("repository")), F.concat(F.lit("ide-review/"), "language"))
        .otherwise(F.col("repository")).alias("repository"),
        F.when(is_blank(F.col("project_id")), "ide").otherwise(F.col("project_id")).alias("project_id"),
        F.col("run_id").alias("workflow_run_id"),
        F.concat(F.lit("inline."), "language").alias("file"),
        "language",
        F.lit(1).alias("files_reviewed"),
        F.lit(1).alias("request_count"),
        F.lit("success").alias("status"),
    )


def review_to_metric(results: DataFrame) -> DataFrame:
    """Stored review result as a metric row."""
    tokens_in, tokens_out = F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0))
    return results.select(
        "repository", F.col("repository").alias("project_id"), "workflow_run_id", "ts",
        F.when(F.col("total_files") > 0, 1).otherwise(0).alias("request_count"),
        tokens_in.alias("input_tokens"), tokens_out.alias("output_tokens"),
        (tokens_in + tokens_out).alias("total_tokens"),
        F.coalesce("duration", F.lit(0)).alias("latency_ms"),
        F.when(F.col("pass_threshold"), "success").otherwise("failure").alias("status"),
        F.col("total_files").alias("files_reviewed"), F.col("total_issues").alias("issues_found"),
        "critical_count", "high_count", "model",
    )


def failure_metric(errors: DataFrame) -> DataFrame:
    """Error message as a failure metric row with zero counters."""
    zero = ("request_count", "input_tokens", "output_tokens", "total_tokens", "latency_ms", "files_reviewed",
            "issues_found", "critical_count", "high_count")
    return errors.select(
        F.coalesce("repository", F.lit("unknown/unknown")).alias("repository"),
        F.coalesce("project_id", "repository", F.lit("unknown/unknown")).alias("project_id"),
        "workflow_run_id", "ts", F.lit("failure").alias("status"), "error_message",
        *[F.lit(0).alias(c) for c in zero],
    )
