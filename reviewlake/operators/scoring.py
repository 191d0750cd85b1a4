"""Severity breakdowns, file and category scores, batch summary, advice and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.jsnum import half_up
from reviewlake.functions.severity import SEVERITIES, clamp_score, count_severities, deduction, lookup
from reviewlake.operators.skew import CHUNK, first_rows, nested

# Issue cap per file, pass mark, and the weights of the overall score.
MAX_ISSUES_PER_FILE = 50
PASS_MARK = 70
WEIGHTS = {"performance": 0.35, "security": 0.25, "code_quality": 0.2, "maintainability": 0.2}
SCORE_GROUPS = {
    "performance": ("performance",),
    "security": ("security",),
    "code_quality": ("code-structure", "best-practice", "logging"),
    "maintainability": ("maintainability", "data-quality", "exception-handling"),
}
LANGUAGE_NAMES = {
    "pyspark": "PySpark", "python": "Python", "scala": "Scala", "sql": "SQL", "terraform": "Terraform", "tf": "Terraform",
}


def severity_breakdown(findings: DataFrame, by: list[str]) -> DataFrame:
    """Counts per severity; unknown severities count in the total only."""
    return findings.groupBy(*by).agg(F.count("*").alias("total_issues"), *count_severities())


def per_file_counts(files: DataFrame, rules: DataFrame, models: DataFrame, keys: tuple[str, ...] = ("run_id", "path")) -> DataFrame:
    """File, language and the number of rule and model findings, in one aggregation."""
    none = F.lit(None).cast("string")
    rows = (
        files.select(*keys, "language", F.lit(0).alias("v"), F.lit(0).alias("l"), F.lit(1).alias("f"))
        .unionByName(rules.select(*keys, none.alias("language"), F.lit(1).alias("v"), F.lit(0).alias("l"), F.lit(0).alias("f")))
        .unionByName(models.select(*keys, none.alias("language"), F.lit(0).alias("v"), F.lit(1).alias("l"), F.lit(0).alias("f")))
    )
    counted = rows.groupBy(*keys).agg(
        F.max("language").alias("language"), F.sum("v").alias("validation_count"), F.sum("l").alias("llm_count"),
        F.sum("f").alias("f"),
    )
    return counted.where(F.col("f") > 0).drop("f")


def per_file_results(files: DataFrame, rules: DataFrame, models: DataFrame, merged: DataFrame,
                     keys: tuple[str, ...] = ("run_id", "path"), chunk: int = CHUNK) -> DataFrame:
    """Per file: counts and the merged issues in order; a file with a huge list comes in parts."""
    lists = nested(merged, list(keys),
                   F.struct("target_model", "ordinal", "severity", "category", "message", "suggestion",
                            "reasoning", "line_number"),
                   "issues", ["target_model", "ordinal"], chunk)
    counts = per_file_counts(files, rules, models, keys)
    empty = F.array().cast(lists.schema["issues"].dataType)
    return counts.join(lists, list(keys), "left").withColumns({
        "issues": F.coalesce("issues", empty), "part": F.coalesce("part", F.lit(0)), "parts": F.coalesce("parts", F.lit(1)),
    })


def pr_gate(files: DataFrame, rules: DataFrame, models: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Run gate: any rule finding or a critical model finding fails; findings of files with ``errors`` do not count.

    Files, findings and errors become one stream of small rows with one aggregation per run; the
    map-side step reduces a run with a third of all rows to one row per task.
    """

    if errors is not None and "path" in errors.columns:
        failed_files = errors.select("run_id", "path").distinct()
        rules, models = (df.join(failed_files, ["run_id", "path"], "left_anti") for df in (rules, models))

    def rows(df: DataFrame, kind: str, severity: Column) -> DataFrame:
        return df.select("run_id", F.lit(kind).alias("kind"), severity.alias("severity"))

    none = F.lit(None).cast("string")
    both = (
        rows(files, "file", none).unionByName(rows(rules, "rule", F.col("severity")))
        .unionByName(rows(models, "model", F.col("severity")))
    )
    if errors is not None:
        both = both.unionByName(rows(errors, "error", none))
    kind = F.col("kind")
    finding = kind.isin("rule", "model")
    counted = both.groupBy("run_id").agg(
        F.count_if(kind == "file").alias("files_reviewed"),
        F.count_if(kind == "rule").alias("validation_failures"),
        F.count_if(kind == "model").alias("llm_findings"),
        F.count_if(finding).alias("total_issues"),
        *[F.count_if(finding & (F.col("severity") == s)).alias(f"{s}_count") for s in SEVERITIES],
        F.count_if((kind == "model") & (F.col("severity") == "critical")).alias("critical_models"),
        F.count_if(kind == "error").alias("errors"),
    )
    failed = (F.col("validation_failures") > 0) | (F.col("critical_models") > 0)
    return counted.withColumns({
        "gate_status": F.when(failed, "fail").otherwise("pass"),
        "status": F.when((F.col("errors") > 0) & (F.col("total_issues") == 0), "partial")
        .when(failed, "failure").otherwise("success"),
    }).drop("critical_models", "errors")


def ide_gate(merged: DataFrame, by: list[str]) -> DataFrame:
    """Single-file run: only a critical merged issue fails; the status is always success."""
    return severity_breakdown(merged, by).withColumns({
        "gate_status": F.when(F.col("critical_count") > 0, "fail").otherwise("pass"),
        "status": F.lit("success"),
    })


def file_score(files: DataFrame, findings: DataFrame, max_issues: int = MAX_ISSUES_PER_FILE,
               keys: tuple[str, ...] = ("run_id", "path"), order: tuple[str, ...] = ("ordinal",)) -> DataFrame:
    """Score per file: 100 minus the deductions of its first ``max_issues`` issues, within 0..100."""
    kept = first_rows(findings, list(keys), [F.col(c) for c in order], max_issues)
    sums = kept.groupBy(*keys).agg(
        F.count("*").alias("issues"), *count_severities(), F.sum(deduction(F.col("severity"))).alias("lost")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("issues", "lost", *[f"{s}_count" for s in SEVERITIES])}
    scored = files.select(*keys, "language").join(sums, list(keys), "left").withColumns(zero)
    return scored.withColumn("score", clamp_score(F.lit(100) - F.col("lost"))).drop("lost")


def batch_summary(scores: DataFrame, threshold: int = PASS_MARK, fail_on_critical: bool = True,
                  fail_on_high: bool = False, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Summary per run from the file scores: counts, rounded mean score, verdict and advice."""
    totals = scores.groupBy(*by).agg(
        F.count("*").alias("total_files"),
        F.count_if(F.col("issues") > 0).alias("files_with_issues"),
        F.coalesce(F.sum("issues"), F.lit(0)).alias("total_issues"),
        *[F.coalesce(F.sum(f"{s}_count"), F.lit(0)).alias(f"{s}_count") for s in SEVERITIES],
        F.sum("score").alias("score_sum"),
    )
    mean = F.when(F.col("total_files") > 0, half_up(F.try_divide("score_sum", "total_files"))).otherwise(100)
    out = totals.withColumn("average_score", mean).drop("score_sum")
    passed = F.col("average_score") >= threshold
    if fail_on_critical:
        passed = passed & (F.col("critical_count") == 0)
    if fail_on_high:
        passed = passed & (F.col("high_count") == 0)
    # The four recommendation texts.
    advice = (
        F.when(F.col("pass_threshold"), "Code review passed. Minor improvements recommended.")
        .when(F.col("critical_count") > 0, "BLOCK: Critical issues found that must be addressed before merge.")
        .when(F.col("high_count") > 0, "WARN: High severity issues found. Review recommended before merge.")
        .otherwise(F.concat(F.lit("Average score ("), F.col("average_score").cast("string"),
                            F.lit(f") is below threshold ({threshold}).")))
    )
    return out.withColumn("pass_threshold", passed).withColumn("recommendation", advice)


def ci_decision(summary: DataFrame, fail_on_critical: bool = True, fail_on_high: bool = False) -> DataFrame:
    """Exit code and reason of a build step: critical, then high, then score below the mark."""

    def issues(column: str, what: str) -> Column:
        return F.concat(F.lit("Failing due to "), F.col(column).cast("string"), F.lit(f" {what}"))

    reason = F.when(F.lit(fail_on_critical) & (F.col("critical_count") > 0), issues("critical_count", "critical issue(s)"))
    reason = reason.when(F.lit(fail_on_high) & (F.col("high_count") > 0), issues("high_count", "high severity issue(s)"))
    reason = reason.when(~F.col("pass_threshold"), F.concat(
        F.lit("Failing due to score ("), F.col("average_score").cast("string"), F.lit(") below threshold")))
    return summary.withColumn("reason", reason).withColumn("exit_code", F.when(F.col("reason").isNotNull(), 1).otherwise(0))


def content_signals(content: Column) -> dict[str, Column]:
    """Positive signals of a text."""
    has = content.contains
    return {
        "caching": has(".cache()") | has(".persist()"),
        "broadcast": has("broadcast(") | has("broadcast "),
        "error_handling": has("try") | has("Try {"),
        "partitions": has("coalesce(") | has("repartition("),
        "schema": has("StructType") | has("schema ="),
    }


def category_scores(files: DataFrame, findings: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Four category scores, the weighted overall score and the advice of one file.

    ``files`` needs ``content`` and ``language``.  The text is reduced to flags before the join, so
    it is never shuffled.  The overall score weighs the unclamped scores.
    """
    text = F.col("content")
    signal = content_signals(text)
    flags = files.select(
        *keys, "language", *[c.alias(f"has_{n}") for n, c in signal.items()],
        (~text.contains(".cache()") & (F.regexp_count(text, F.lit(r"df\.")) > 5)).alias("reuse"),
        (text.contains("join") & ~text.contains("broadcast")).alias("join_hint"),
        (~text.contains("partitionBy") & text.contains(".write")).alias("write_hint"),
    )
    lost = deduction(F.col("severity"))
    sums = findings.groupBy(*keys).agg(
        F.count("*").alias("issues"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"),
        *[F.sum(F.when(F.col("category").isin(*cats), lost).otherwise(0)).alias(f"lost_{name}")
          for name, cats in SCORE_GROUPS.items()],
    )
    names = ("issues", "critical_count", "high_count", *[f"lost_{n}" for n in SCORE_GROUPS])
    joined = flags.join(sums, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})

    def bonus(name: str, points: int) -> Column:
        return F.when(F.col(f"has_{name}"), points).otherwise(0)

    raw = joined.withColumns({
        "raw_performance": F.lit(100) - F.col("lost_performance") + bonus("caching", 5) + bonus("broadcast", 5)
        + bonus("partitions", 3) + bonus("schema", 5),
        "raw_security": F.lit(100) - F.col("lost_security"),
        "raw_code_quality": F.lit(100) - F.col("lost_code_quality") + bonus("error_handling", 5),
        "raw_maintainability": F.lit(100) - F.col("lost_maintainability"),
    })
    overall = half_up(
        F.col("raw_performance") * WEIGHTS["performance"] + F.col("raw_security") * WEIGHTS["security"]
        + F.col("raw_code_quality") * WEIGHTS["code_quality"] + F.col("raw_maintainability") * WEIGHTS["maintainability"]
    )
    return raw.withColumn("raw_overall", overall).select(
        "*", clamp_score(F.col("raw_overall")).alias("overall_score"),
        *[clamp_score(F.col(f"raw_{n}")).alias(n) for n in SCORE_GROUPS],
    )


def with_merged_issues(scores: DataFrame, merged: DataFrame, keys: tuple[str, ...] = ("run_id", "path")) -> DataFrame:
    """Scores of :func:`category_scores` with the counts of the merged issues; the scores stay those of the rules."""
    counts = merged.groupBy(*keys).agg(
        F.count("*").alias("issues"),
        F.count_if(F.col("severity") == "critical").alias("critical_count"),
        F.count_if(F.col("severity") == "high").alias("high_count"),
    )
    names = ("issues", "critical_count", "high_count")
    return scores.drop(*names).join(counts, list(keys), "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in names})


def model_notes(reviews: DataFrame, keys: tuple[str, ...] = ("run_id", "path")) -> DataFrame:
    """Strengths and recommendations of all answers of a file (``model_strengths``, ``model_recommendations``).

    ``reviews``: parsed answers with ``response_id``.  A note counts once, where it comes first in the order of the answers.
    """
    kinds = ("strengths", "recommendations")

    def tagged(kind: str) -> Column:
        return F.transform(kind, lambda note, pos: F.struct(F.lit(kind).alias("kind"), pos.alias("pos"), note.alias("note")))

    told = F.concat(*map(tagged, kinds))
    rows = reviews.select(*keys, "response_id", F.explode(told).alias("told")).select(*keys, "response_id", "told.*")
    first = rows.groupBy(*keys, "kind", "note").agg(F.min(F.struct("response_id", "pos")).alias("at"))
    return first.groupBy(*keys).agg(*[
        F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("at", "note"))))["note"].alias(f"model_{kind}")
        for kind in kinds])


def review_advice(scores: DataFrame, notes: DataFrame | None = None, keys: tuple[str, ...] = ("run_id", "path")) -> DataFrame:
    """Strengths and recommendations from the signals and scores of :func:`category_scores`.

    The model's own (``notes``, see :func:`model_notes`) come first.
    """
    # The advice texts, in order.
    strengths = F.array_compact(F.array(
        F.when(F.col("has_caching"), "Proper DataFrame caching implemented"),
        F.when(F.col("has_broadcast"), "Using broadcast hints for join optimization"),
        F.when(F.col("has_error_handling"), "Error handling implemented"),
        F.when(F.col("has_partitions"), "Partition management for output optimization"),
        F.when(F.col("has_schema"), "Explicit schema definition used"),
    ))
    recommendations = F.array_compact(F.array(
        F.when(F.col("raw_performance") < 85, "Review and optimize query performance patterns"),
        F.when(F.col("reuse"), "Consider caching DataFrames that are reused multiple times"),
        F.when(F.col("join_hint"), "Consider broadcast hints for small lookup tables in joins"),
        F.when(F.col("write_hint"), "Consider partitioning output data for better query performance"),
        F.when(F.col("issues") > 0, "Address high-severity issues first for maximum impact"),
        F.lit("Add comprehensive unit tests for transformation logic"),
        F.lit("Implement logging for pipeline monitoring and debugging"),
    ))
    if notes is not None:
        none = F.array().cast("array<string>")
        scores = scores.join(notes, list(keys), "left")
        strengths = F.concat(F.coalesce("model_strengths", none), strengths)
        recommendations = F.concat(F.coalesce("model_recommendations", none), recommendations)
    return scores.withColumn("strengths", strengths).withColumns({
        "strengths": F.when(F.size("strengths") > 0, F.col("strengths")).otherwise(F.array(F.lit("Code structure is clean"))),
        "recommendations": recommendations,
    })


def effort_estimate(scores: DataFrame) -> DataFrame:
    """Effort bin (4 per critical, 2 per high, 1 per issue) and the summary sentence."""
    effort = F.col("critical_count") * 4 + F.col("high_count") * 2 + F.col("issues")
    bins = F.when(effort <= 4, "1-2 hours").when(effort <= 8, "2-4 hours").when(effort <= 15, "4-8 hours").otherwise("1-2 days")
    shown = lookup(F.lower("language"), LANGUAGE_NAMES, F.col("language"))
    head = F.concat(F.lit("Analyzed "), shown, F.lit(" code. Overall score: "), F.col("raw_overall").cast("string"), F.lit("/100"))
    tail = F.concat(F.lit(". Found "), F.col("issues").cast("string"), F.lit(" issue(s): "),
                    F.col("critical_count").cast("string"), F.lit(" critical, "),
                    F.col("high_count").cast("string"), F.lit(" high"))
    return scores.withColumns({
        "effort": effort, "estimate": bins,
        "summary": F.when(F.col("issues") > 0, F.concat(head, tail)).otherwise(head),
    })
