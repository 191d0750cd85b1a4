"""The flagship job: files and stored model answers to gated, priced and merged review runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.operators import merge, responses, rules, scoring
from reviewlake.operators.metrics import token_cost
from reviewlake.operators.validation import valid_files
from reviewlake.session import cut_lineage

KEYS = ("run_id", "path")
# Issues of one answer: up to 2 ** 20.
POSITION_BITS = 20
# Fixed value: the model of a run that names none.
DEFAULT_MODEL = "claude-sonnet-4-20250514"


def model_issues(answers: DataFrame) -> DataFrame:
    """Issues of all answers of a file; ``ordinal`` grows with (answer, position), so no file has to be numbered in one task."""
    parsed = responses.parse_findings(answers, keys=("run_id", "path", "response_id"))
    ordinal = F.shiftleft(F.col("response_id").cast("long"), POSITION_BITS) + F.col("pos")
    return parsed.withColumn("ordinal", ordinal).drop("response_id", "pos")


def _stored(df: DataFrame) -> DataFrame:
    """Findings are small next to the texts: store them once instead of scanning the texts again."""
    return cut_lineage(df)


def _findings(files: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(reviewed files, rule findings, model findings of those files)."""
    reviewed = valid_files(files)
    found = model_issues(answers).join(reviewed.select(*KEYS).distinct(), list(KEYS), "left_semi")
    return reviewed, _stored(rules.rule_scan(reviewed, keys=KEYS)), found


def _runs(files: DataFrame, rule_findings: DataFrame, own: DataFrame, usage: DataFrame, pricing: DataFrame,
          errors: DataFrame | None = None) -> DataFrame:
    # Files that are skipped still count as reviewed.
    gates = scoring.pr_gate(files, rule_findings, own, errors).where(F.col("files_reviewed") > 0)
    spent = {c: F.coalesce(c, F.lit(0)) for c in ("input_tokens", "output_tokens", "cost_usd")}
    return gates.join(token_cost(usage, pricing), "run_id", "left").withColumns(spent).withColumns({
        "model": F.coalesce("model", F.lit(DEFAULT_MODEL)), "total_tokens": F.col("input_tokens") + F.col("output_tokens"),
    })


def _without_failed(df: DataFrame, errors: DataFrame | None) -> DataFrame:
    """Findings of files that did not fail."""
    return df if errors is None else df.join(errors.select(*KEYS).distinct(), list(KEYS), "left_anti")


def review_runs(files: DataFrame, answers: DataFrame, usage: DataFrame, pricing: DataFrame,
                errors: DataFrame | None = None) -> DataFrame:
    """One row per run: counts, gate, status, tokens and cost.  ``errors``: run_id, path and error of failed files."""
    _, rule_findings, found = _findings(files, answers)
    return _runs(files, rule_findings, merge.llm_findings_exact(rule_findings, found), usage, pricing, errors)


def review_run(files: DataFrame, answers: DataFrame, usage: DataFrame, pricing: DataFrame,
               errors: DataFrame | None = None) -> dict[str, DataFrame]:
    """All outputs of a review as tables.

    ``runs``: see :func:`review_runs`.  ``validation_failures`` and ``llm_findings``: flat findings.
    ``merged``: issues after the greedy merge.  ``files``: counts per file and the ``error`` of a failed one, which
    has no findings.  ``records``: training records of the runs.  Lists stay tables, so a run or file of any size stays
    distributed.
    """
    reviewed, rule_findings, found = _findings(files, answers)
    rule_findings, found = _without_failed(rule_findings, errors), _stored(_without_failed(found, errors))
    own = merge.llm_findings_exact(rule_findings, found)
    counts = scoring.per_file_counts(reviewed, rule_findings, own)
    if errors is not None:
        counts = counts.join(errors.groupBy(*KEYS).agg(F.min("error").alias("error")), list(KEYS), "left")
    runs = _runs(files, rule_findings, own, usage, pricing, errors)
    return {
        "runs": runs,
        "validation_failures": rule_findings,
        "llm_findings": own,
        "merged": merge.merge_findings(rule_findings, found),
        "files": counts,
        "records": training_records(runs),
    }


def batch_issues(files: DataFrame, rule_findings: DataFrame, found: DataFrame,
                 max_issues: int = scoring.MAX_ISSUES_PER_FILE) -> DataFrame:
    """Issues of the batch flow per file: merged by line and category, the first ``max_issues`` kept and numbered (``place``)."""
    merged = merge.merge_batch_findings(rule_findings, found, files)
    place = F.row_number().over(Window.partitionBy(*KEYS).orderBy("is_model", "ordinal"))
    kept = merged.withColumn("place", place).where(F.col("place") <= max_issues)
    return kept.join(files.select(*KEYS, "file_no"), list(KEYS))


def training_records(runs: DataFrame, prompts: DataFrame | None = None, template_version: str = "1.0") -> DataFrame:
    """Record columns of a finished run, for ``insert_first``."""
    out = runs.withColumns({
        "schema_version": F.lit("1.0"), "prompt_template_version": F.lit(template_version),
        "model_version": F.col("model"), "source": F.lit("pipeline"),
    })
    return out if prompts is None else out.join(prompts, "run_id", "left")
