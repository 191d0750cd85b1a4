"""Every operator as a query over the given tables, with its oracle where SQL can state it."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake import schemas
from reviewlake.functions import language as lang
from reviewlake.functions.rule_ids import finding_rule_id
from reviewlake.operators import (
    feedback,
    filters,
    merge,
    metrics,
    responses,
    rules,
    validation,
)
from reviewlake.plans import oracles
from reviewlake.session import cut_lineage, local_table, scratch_path, spread, tune
from reviewlake.sources import corpus, pricing, rule_catalog, sinks, tables

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The domain tables of one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir
        self._findings: DataFrame | None = None

    def __getattr__(self, name: str) -> DataFrame:
        return corpus.table(self.spark, self.sf_dir, name)

    @property
    def files(self) -> DataFrame:
        return spread(corpus.table(self.spark, self.sf_dir, "source_files"))

    @property
    def model_findings(self) -> DataFrame:
        return corpus.table(self.spark, self.sf_dir, "model_findings", ("events", "documents"))

    @property
    def model_responses(self) -> DataFrame:
        return corpus.table(self.spark, self.sf_dir, "model_responses", ("events", "documents"))

    @property
    def batch_responses(self) -> DataFrame:
        return corpus.table(self.spark, self.sf_dir, "batch_responses", ("events", "documents"))

    @property
    def prices(self) -> metrics.Prices:
        return pricing.price_rows()

    @property
    def priced(self) -> DataFrame:
        return metrics.token_cost(self.run_metrics, self.prices)

    @property
    def rule_findings(self) -> DataFrame:
        return rules.rule_scan(self.files, keys=("run_id", "file_no", "path", "language"))

    @property
    def stored_findings(self) -> DataFrame:
        """Rule findings, stored once, for queries that use them more than once."""
        if self._findings is None:
            self._findings = cut_lineage(self.rule_findings)
        return self._findings

    @property
    def labels(self) -> DataFrame:
        """Labels of all feedback (the given table of that name holds something else)."""
        return feedback.labels_of(self.training_feedback)

    def scratch(self, name: str) -> str:
        return scratch_path(self.spark, name)


def query(name: str, oracle: str | None = None) -> Callable[[Callable[[Tables], DataFrame]], Query]:
    def register(build: Callable[[Tables], DataFrame]) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return build(Tables(tune(spark), sf_dir))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracles.oracle(oracle)
        return run

    return register


# --------------------------------------------------------------------------- sources and sinks

@query("scan_run_metrics", """
SELECT id, repository, project_id, ts, input_tokens, status, model, CAST(NULL AS VARCHAR) AS branch, cost_usd
FROM {priced_metrics}""")
def _(t: Tables) -> DataFrame:
    path = t.scratch("metrics")
    t.priced.write.parquet(path)
    return tables.scan_run_metrics(t.spark, path).select(
        "id", "repository", "project_id", "ts", "input_tokens", "status", "model", "branch", "cost_usd")


@query("scan_run_details", """
SELECT run_id, CASE WHEN run_id IS NULL OR validation_failures IS NULL OR validation_failures = '[{{"severity": ' THEN 0 ELSE 1 END
    AS validation_failure_count,
  2 AS llm_finding_count,
  CASE WHEN severity_distribution = 'n/a' THEN 0 ELSE CAST(json_extract_string(severity_distribution, '$.critical') AS BIGINT) END AS critical,
  CASE WHEN severity_distribution = 'n/a' THEN 0 ELSE 1 END AS high,
  coalesce(source, 'pipeline') AS source
FROM {stored_runs}""")
def _(t: Tables) -> DataFrame:
    path = t.scratch("runs")
    t.stored_runs.write.parquet(path)
    runs = filters.run_list(tables.scan_run_details(t.spark, path))
    return runs.select("run_id", "validation_failure_count", "llm_finding_count",
                       F.col("severity_distribution.critical").alias("critical"),
                       F.col("severity_distribution.high").alias("high"), "source")


@query("scan_training", """
SELECT r.id, r.run_id, r.model_version, CAST(NULL AS VARCHAR) AS full_diff, count(f.record_id) AS feedback_rows,
  any_value(l.supervised_label) AS supervised_label, any_value(l.rl_reward) AS rl_reward
FROM {training_records} r LEFT JOIN {training_feedback} f ON f.record_id = r.id LEFT JOIN {labels_all} l ON l.record_id = r.id
GROUP BY r.id, r.run_id, r.model_version""")
def _(t: Tables) -> DataFrame:
    paths = [t.scratch(n) for n in ("records", "feedback", "labels")]
    for df, path in zip((t.training_records, t.training_feedback, t.labels), paths):
        df.write.parquet(path)
    stored = tables.scan_training(t.spark, *paths)
    counts = stored["feedback"].groupBy(F.col("record_id").alias("id")).agg(F.count("*").alias("n"))
    labels = stored["labels"].select(F.col("record_id").alias("id"), "supervised_label", "rl_reward")
    return stored["records"].join(counts, "id", "left").join(labels, "id", "left").select(
        "id", "run_id", "model_version", "full_diff", F.coalesce("n", F.lit(0)).alias("feedback_rows"), "supervised_label", "rl_reward")


@query("scan_source_files", """
SELECT doc_id, length(text) + 1 AS chars, len(string_split(text, chr(10))) AS lines, md5(concat(text, chr(10))) AS text_md5 FROM {documents}""")
def _(t: Tables) -> DataFrame:
    path = t.scratch("texts")
    sinks.write_text_files(t.documents, path, "doc_id", "text")
    # The folder and a glob name every file twice; the scan keeps one.
    read = tables.scan_source_files(t.spark, [path, f"{path}/folder=*/doc_id=*"])
    return read.select(F.regexp_extract("path", "doc_id=([^/.]*)", 1).cast("long").alias("doc_id"), F.length("content").alias("chars"),
                       F.regexp_count("content", F.lit("\n")).alias("lines"), F.md5("content").alias("text_md5"))


_RULE_LANGUAGES = ", ".join(
    f"('{r.id}', {str(r.enabled).lower()}, '{name}')" for r in rule_catalog.builtin_rules(True) for name in r.languages)


@query("scan_rule_catalog", f"""
SELECT id AS rule_id, enabled, count(f.path) AS files
FROM (VALUES {_RULE_LANGUAGES}) c(id, enabled, language) LEFT JOIN {{source_files}} f ON f.language = c.language
GROUP BY id, enabled""")
def _(t: Tables) -> DataFrame:
    per_language = t.source_files.groupBy("language").agg(F.count("*").alias("n"))
    catalog = rule_catalog.scan_rule_catalog(t.spark).select(
        F.col("id").alias("rule_id"), "enabled", F.explode("languages").alias("language"))
    return catalog.join(per_language, "language", "left").groupBy("rule_id", "enabled").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


_OVERRIDES = '{"gpt-4o": {"inputPerMillion": 7, "outputPerMillion": 9}, "unknown": {"inputPerMillion": 2, "outputPerMillion": 4}}'


@query("scan_pricing", """
WITH price_list AS (
  SELECT ordinal, model_key, CASE WHEN model_key = 'gpt-4o' THEN 7.0 ELSE input_per_m END::DOUBLE AS input_per_m,
    CASE WHEN model_key = 'gpt-4o' THEN 9.0 ELSE output_per_m END::DOUBLE AS output_per_m FROM {prices}
  UNION ALL SELECT 100, 'unknown', 2.0, 4.0),
costs AS (""" + oracles.priced("run_metrics", "price_list").replace("{price_list}", "price_list") + """)
SELECT model, count(*) AS runs, sum(CAST(cost_usd AS DECIMAL(18,6)))::DOUBLE AS cost_usd FROM costs GROUP BY model""")
def _(t: Tables) -> DataFrame:
    prices = pricing.scan_pricing(t.spark, pricing.read_price_overrides(t.spark, _OVERRIDES))
    return metrics.token_cost(t.run_metrics, prices).groupBy("model").agg(
        F.count("*").alias("runs"), F.sum(F.col("cost_usd").cast("decimal(18,6)")).cast("double").alias("cost_usd"))


_RESULT_METRIC = """
SELECT repository, workflow_run_id, ts, CASE WHEN total_files > 0 THEN 1 ELSE 0 END AS request_count,
  coalesce(input_tokens, 0) + coalesce(output_tokens, 0) AS total_tokens, coalesce(duration, 0) AS latency_ms,
  CASE WHEN pass_threshold THEN 'success' ELSE 'failure' END AS status, total_files AS files_reviewed,
  total_issues AS issues_found, critical_count, high_count, model
FROM {review_results}"""
_RESULT_COLUMNS = ["repository", "workflow_run_id", "ts", "request_count", "total_tokens", "latency_ms", "status",
                   "files_reviewed", "issues_found", "critical_count", "high_count", "model"]


@query("scan_review_results", _RESULT_METRIC)
def _(t: Tables) -> DataFrame:
    path = t.scratch("results")
    t.review_results.select(
        "workflow_run_id", "repository", F.col("ts").alias("timestamp"), "duration",
        F.struct(F.col("total_files").alias("totalFiles"), F.col("total_issues").alias("totalIssues"),
                 F.col("critical_count").alias("criticalCount"), F.col("high_count").alias("highCount"),
                 F.col("pass_threshold").alias("passThreshold")).alias("summary"),
        F.when(F.col("model").isNotNull(), F.struct(
            F.col("input_tokens").alias("inputTokens"), F.col("output_tokens").alias("outputTokens"), "model")).alias("tokenUsage"),
    ).write.json(path)
    return validation.review_to_metric(tables.scan_review_results(t.spark, path, multi_line=False)).select(_RESULT_COLUMNS)


@query("append_metrics", """
SELECT repository, workflow_run_id, ts, source, status, total_tokens, 1 AS equal_ids FROM {run_metrics}""")
def _(t: Tables) -> DataFrame:
    path = t.scratch("metrics")
    failed = F.col("status") == "failure"
    sinks.append_metrics(t.run_metrics.where(failed), path, "a")
    sinks.append_metrics(t.run_metrics.where(~failed).drop("id"), path, "b")
    stored = t.spark.read.parquet(path)
    uses = stored.groupBy("id").agg(F.count("*").cast("int").alias("equal_ids"))
    return stored.join(uses, "id").select("repository", "workflow_run_id", "ts", "source", "status", "total_tokens", "equal_ids")


@query("upsert_run_details", """
SELECT run_id, max(ingest_seq) AS ingest_seq, arg_max(status, ingest_seq) AS status,
  arg_max(total_issues, ingest_seq) AS total_issues FROM {run_writes} GROUP BY run_id""")
def _(t: Tables) -> DataFrame:
    path, first = t.scratch("runs"), F.col("status") == "F"
    for writes in (t.run_writes.where(first), t.run_writes.where(~first)):
        sinks.upsert_table(writes, path, "run_id", "ingest_seq")
    return t.spark.read.parquet(path).select("run_id", "ingest_seq", "status", "total_issues")


@query("insert_training_records", """
SELECT run_id, min(ingest_seq) AS ingest_seq, arg_min(status, ingest_seq) AS status, arg_min(total_issues, ingest_seq) AS total_issues
FROM {run_writes} WHERE status <> 'F' AND run_id NOT IN (SELECT run_id FROM {run_writes} WHERE status = 'F') GROUP BY run_id""")
def _(t: Tables) -> DataFrame:
    stored = t.run_writes.where("status = 'F'")
    return sinks.insert_first(stored, t.run_writes.where("status <> 'F'"))


@query("append_feedback", """
SELECT feedback_channel, action, count(*) AS stored FROM {training_feedback} GROUP BY feedback_channel, action""")
def _(t: Tables) -> DataFrame:
    path = t.scratch("feedback")
    for action in validation.ACTIONS:
        sinks.append_feedback(t.training_feedback.where(F.col("action") == action), path)
    return t.spark.read.parquet(path).groupBy("feedback_channel", "action").agg(F.count("*").alias("stored"))


_LABEL_COLUMNS = ["record_id", "true_positives", "false_positives", "false_negatives", "precision_score", "recall_score",
                  "gate_correct", "rl_reward", "supervised_label"]


@query("upsert_labels", "SELECT * FROM {labels_all}")
def _(t: Tables) -> DataFrame:
    early = t.training_feedback.where("created_at < timestamp_ntz'1998-01-01'")
    late = t.training_feedback.where("created_at >= timestamp_ntz'1998-01-01'")
    touched = t.training_feedback.join(late.select("record_id").distinct(), "record_id", "left_semi")
    path = t.scratch("labels")
    for changed in (early, touched):
        sinks.upsert_table(feedback.labels_of(changed), path, "record_id")
    return t.spark.read.parquet(path).select(_LABEL_COLUMNS)


@query("add_columns_with_default", """
SELECT id, repository, CASE WHEN id % 2 = 0 THEN 0.0 ELSE coalesce(cost_usd, 0.0) END::DOUBLE AS cost_usd,
  CASE WHEN id % 2 = 0 THEN 'pipeline' ELSE coalesce(source, 'pipeline') END AS source, CAST(NULL AS VARCHAR) AS branch FROM {priced_metrics}""")
def _(t: Tables) -> DataFrame:
    """Half of the rows were written before the two columns existed, into the same folder."""
    path, old = t.scratch("metrics"), F.col("id") % 2 == 0
    t.priced.where(old).drop("cost_usd", "source").write.parquet(path)
    t.priced.where(~old).write.mode("append").parquet(path)
    return tables.scan_versions(t.spark, path, schemas.RUN_METRICS, tables.METRIC_DEFAULTS).select(
        "id", "repository", "cost_usd", "source", "branch")


@query("export_dataset", """
SELECT form, r.id, r.run_id, r.created_at, count(f.record_id) AS feedback_rows, any_value(l.supervised_label) AS supervised_label
FROM {training_records} r LEFT JOIN {training_feedback} f ON f.record_id = r.id LEFT JOIN {labels_all} l ON l.record_id = r.id,
  (VALUES ('jsonl'), ('json'), ('parquet')) v(form)
GROUP BY form, r.id, r.run_id, r.created_at""")
def _(t: Tables) -> DataFrame:
    """The three forms, each read back from its files; the text forms are compressed and made from the Parquet files."""
    export = feedback.training_export(t.training_records, t.labels, t.training_feedback, limit=None)
    schema = ("id bigint, run_id string, created_at timestamp_ntz, human_feedback array<struct<action:string>>, "
              "outcome_labels struct<supervised_label:string>")
    found = []
    for form in ("parquet", "jsonl", "json"):
        path = t.scratch(form)
        sinks.export_dataset(export, path, form, compression="gzip")
        if form == "jsonl":
            rows = t.spark.read.schema(schema).json(path)
        elif form == "parquet":
            export = rows = t.spark.read.parquet(path)
        else:  # the document's lines between its head and its end are its records
            lines = t.spark.read.text(path).where(~F.col("value").startswith('{"count":') & (F.col("value") != "]}"))
            rows = lines.select(F.from_json(F.regexp_replace("value", "^,", ""), schema).alias("r")).select("r.*")
        found.append(rows.groupBy("id", "run_id", "created_at").agg(
            F.sum(F.size("human_feedback")).cast("long").alias("feedback_rows"),
            F.max("outcome_labels.supervised_label").alias("supervised_label")).withColumn("form", F.lit(form)))
    return found[0].unionByName(found[1]).unionByName(found[2])


# ------------------------------------------------------- projections, validation, filters

@query("validate_metrics", """
SELECT id, CASE WHEN status NOT IN ('success', 'failure', 'partial') THEN concat('Invalid status: ', status, '. Must be success|failure|partial.')
  WHEN coalesce(repository, '') = '' AND coalesce(project_id, '') = '' THEN 'Missing required fields: repository, project_id'
  WHEN coalesce(repository, '') = '' THEN 'Missing required fields: repository'
  WHEN coalesce(project_id, '') = '' THEN 'Missing required fields: project_id' END AS reject_reason
FROM {raw_metrics}""")
def _(t: Tables) -> DataFrame:
    valid, rejected = validation.validate_metrics(t.raw_metrics)
    return rejected.select("id", "reject_reason").unionByName(
        valid.select("id", F.lit(None).cast("string").alias("reject_reason")))


@query("normalise_metrics", """
WITH filled AS (
  SELECT id, coalesce(request_count, 0) AS request_count, coalesce(input_tokens, 0) AS input_tokens,
    coalesce(output_tokens, 0) AS output_tokens,
    coalesce(total_tokens, coalesce(input_tokens, 0) + coalesce(output_tokens, 0)) AS total_tokens,
    coalesce(latency_ms, 0) AS latency_ms, coalesce(status, 'success') AS status, coalesce(source, 'pipeline') AS source,
    model, cost_usd AS given FROM {raw_metrics}),
costs AS (""" + oracles.priced("filled").replace("{filled}", "filled") + """)
SELECT id, request_count, input_tokens, output_tokens, total_tokens, latency_ms, status, source,
  coalesce(given, cost_usd) AS cost_usd FROM costs""")
def _(t: Tables) -> DataFrame:
    return validation.normalise_metrics(t.raw_metrics, t.prices).select(
        "id", "request_count", "input_tokens", "output_tokens", "total_tokens", "latency_ms", "status", "source", "cost_usd")


@query("validate_runs", """
SELECT run_id, ts, CASE
  WHEN run_id IS NULL AND workflow_run_id = '' THEN 'Missing required fields: run_id, workflow_run_id'
  WHEN run_id IS NULL THEN 'Missing required fields: run_id'
  WHEN workflow_run_id = '' THEN 'Missing required fields: workflow_run_id'
  WHEN status NOT IN ('success', 'failure', 'partial') THEN concat('Invalid status: ', status)
  WHEN gate_status NOT IN ('pass', 'fail') THEN concat('Invalid gate_status: ', gate_status) END AS reject_reason
FROM {raw_runs}""")
def _(t: Tables) -> DataFrame:
    valid, rejected = validation.validate_runs(t.raw_runs)
    return rejected.select("run_id", "ts", "reject_reason").unionByName(
        valid.select("run_id", "ts", F.lit(None).cast("string").alias("reject_reason")))


@query("normalise_runs", """
SELECT run_id, workflow_run_id, coalesce(gate_status, 'pass') AS gate_status, coalesce(status, 'success') AS status,
  coalesce(total_issues, 0) AS total_issues, coalesce(latency_ms, 0) AS latency_ms,
  coalesce(runtime_ms, latency_ms, 0) AS runtime_ms, coalesce(source, 'pipeline') AS source,
  CAST(0 AS BIGINT) AS files_reviewed, CAST(0 AS BIGINT) AS critical, CAST(0 AS DOUBLE) AS cost_usd
FROM {raw_runs}""")
def _(t: Tables) -> DataFrame:
    return validation.normalise_runs(t.raw_runs).select(
        "run_id", "workflow_run_id", "gate_status", "status", "total_issues", "latency_ms", "runtime_ms", "source",
        "files_reviewed", F.col("severity_distribution.critical").alias("critical"), "cost_usd")


_FEEDBACK_REASON = """CASE WHEN f.run_id IS NULL THEN 'run_id is required'
  WHEN action NOT IN ('accept', 'reject', 'modify') THEN 'action must be ''accept'', ''reject'', or ''modify'''
  WHEN r.id IS NULL THEN concat('No training record found for run_id: ', f.run_id) END"""


@query("validate_feedback", f"""
SELECT f.run_id, action, reviewer_id, f.created_at, {_FEEDBACK_REASON} AS reject_reason
FROM {{raw_feedback}} f LEFT JOIN {{training_records}} r ON r.run_id = f.run_id""")
def _(t: Tables) -> DataFrame:
    return validation.check_feedback(t.raw_feedback, t.training_records).select(
        "run_id", "action", "reviewer_id", "created_at", "reject_reason")


@query("normalise_feedback", f"""
SELECT r.id AS record_id, f.run_id, action, finding_index, finding_type, coalesce(feedback_channel, 'dashboard') AS feedback_channel,
  '[]' AS corrected_findings, reviewer_id, f.created_at
FROM {{raw_feedback}} f JOIN {{training_records}} r ON r.run_id = f.run_id WHERE {_FEEDBACK_REASON} IS NULL""")
def _(t: Tables) -> DataFrame:
    return validation.normalise_feedback(t.raw_feedback, t.training_records).select(
        "record_id", "run_id", "action", "finding_index", "finding_type", "feedback_channel", "corrected_findings",
        "reviewer_id", "created_at")


@query("valid_files", """
SELECT q.run_id, CASE WHEN f.n IS NULL THEN 'files array is required and must not be empty'
  WHEN coalesce(repository, '') = '' THEN 'metadata.repository is required'
  WHEN coalesce(workflow_run_id, '') = '' THEN 'metadata.workflow_run_id is required' END AS reject_reason,
  coalesce(f.usable, 0) AS usable_files
FROM {review_requests} q LEFT JOIN (
  SELECT run_id, count(*) AS n, count(*) FILTER (coalesce(content, '') <> '') AS usable FROM {source_files} GROUP BY run_id) f
  ON f.run_id = q.run_id""")
def _(t: Tables) -> DataFrame:
    usable = validation.valid_files(t.source_files).groupBy("run_id").agg(F.count("*").alias("usable"))
    checked = validation.check_review_requests(t.review_requests, t.source_files)
    return checked.join(usable, "run_id", "left").select(
        "run_id", "reject_reason", F.coalesce("usable", F.lit(0)).alias("usable_files"))


@query("normalise_ide_run", """
SELECT run_id, CASE WHEN source = 'application' THEN 'application' ELSE 'ide' END AS source,
  CASE WHEN trim(coalesce(user_id, '')) <> '' THEN trim(user_id) WHEN source = 'application' THEN 'webapp-user'
       ELSE 'terminal-user' END AS actor,
  coalesce(repository, concat('ide-review/', language)) AS repository, coalesce(project_id, 'ide') AS project_id,
  concat('inline.', language) AS file FROM {ide_runs}""")
def _(t: Tables) -> DataFrame:
    return validation.normalise_ide_run(t.ide_runs).select("run_id", "source", "actor", "repository", "project_id", "file")


@query("filter_metrics", """
SELECT id, repository, status, ts FROM {run_metrics}
WHERE source = 'ide' AND status = 'success' AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-20'
ORDER BY ts DESC, id DESC LIMIT 100 OFFSET 20""")
def _(t: Tables) -> DataFrame:
    path = t.scratch("days")
    sinks.append_by_day(t.run_metrics, path)
    return filters.filter_metrics(t.spark.read.parquet(path), source="ide", status="success", ts_from="2024-01-05", ts_to="2024-01-20",
                                  limit=0, offset=20).select("id", "repository", "status", "ts")


@query("filter_runs", """
SELECT run_id, gate_status, status, ts FROM {stored_runs} WHERE gate_status = 'pass' AND repository = 'org/repo-3'
ORDER BY ts DESC, run_id DESC LIMIT 50""")
def _(t: Tables) -> DataFrame:
    path = t.scratch("days")
    sinks.append_by_day(t.stored_runs, path)
    return filters.filter_runs(t.spark.read.parquet(path), gate_status="pass", repository="org/repo-3").select(
        "run_id", "gate_status", "status", "ts")


@query("run_lookup", "SELECT run_id, repository, status, total_issues, ts FROM {stored_runs} WHERE run_id = 'run-77'")
def _(t: Tables) -> DataFrame:
    return filters.run_lookup(t.stored_runs, "run-77").select("run_id", "repository", "status", "total_issues", "ts")


@query("run_list", """
SELECT run_id, repository, gate_status, CASE WHEN validation_failures IS NULL OR validation_failures = '[{{"severity": '
  THEN 0 ELSE 1 END AS validation_failure_count, 2 AS llm_finding_count, total_issues FROM {stored_runs}""")
def _(t: Tables) -> DataFrame:
    full = tables.decode_run_details(t.stored_runs.withColumn("per_file_results", F.lit(None).cast("string")))
    return filters.run_list(full).select(
        "run_id", "repository", "gate_status", "validation_failure_count", "llm_finding_count", "total_issues")


@query("skip_paths", """
SELECT path, language FROM {source_files}
WHERE NOT regexp_matches(path, 'src1.*.py') AND NOT regexp_matches(path, 'pages/p1')""")
def _(t: Tables) -> DataFrame:
    return filters.skip_paths(t.source_files, ["src1*.py", "pages/p1"]).select("path", "language")


@query("skip_globs", """
SELECT path, language FROM {source_files}
WHERE NOT regexp_matches(path, 'src2/.[^/]*') AND NOT regexp_matches(path, '.[^/]*/p[^/]*\\.scala')""")
def _(t: Tables) -> DataFrame:
    return filters.skip_globs(t.source_files, ["src2/**", "**/p*.scala"]).select("path", "language")


@query("select_files", """
SELECT run_id, path FROM (
  SELECT run_id, path, row_number() OVER (PARTITION BY run_id ORDER BY file_no, path) AS rn
  FROM {source_files} WHERE regexp_matches(path, '\\.(py|scala)$')) s WHERE rn <= 2""")
def _(t: Tables) -> DataFrame:
    return filters.select_files(t.source_files, ("py", "scala"), max_files=2).select("run_id", "path")


@query("review_to_metric", _RESULT_METRIC)
def _(t: Tables) -> DataFrame:
    return validation.review_to_metric(t.review_results).select(_RESULT_COLUMNS)


@query("failure_metric", """
SELECT repository, repository AS project_id, workflow_run_id, ts, 'failure' AS status, concat('stopped after ', CAST(latency_ms AS STRING)) AS error_message,
  0 AS request_count, 0 AS total_tokens FROM {run_metrics} WHERE status = 'failure'""")
def _(t: Tables) -> DataFrame:
    failed = t.run_metrics.where("status = 'failure'").select(
        "repository", F.lit(None).cast("string").alias("project_id"), "workflow_run_id", "ts",
        F.concat(F.lit("stopped after "), F.col("latency_ms").cast("string")).alias("error_message"))
    return validation.failure_metric(failed).select(
        "repository", "project_id", "workflow_run_id", "ts", "status", "error_message", "request_count", "total_tokens")


@query("severity_filter", """
SELECT m.path, ordinal, CASE severity WHEN 'critical' THEN 'error' WHEN 'high' THEN 'error' WHEN 'medium' THEN 'warning' ELSE 'information' END AS level,
  least(greatest(0, coalesce(line_number, 1) - 1), n - 1)::INT AS editor_line, concat('[', upper(severity), '] ', message) AS title
FROM {model_findings} m JOIN (SELECT run_id, path, len(string_split(content, chr(10))) AS n FROM {source_files}) f
  ON f.run_id = m.run_id AND f.path = m.path
WHERE severity <> 'info'""")
def _(t: Tables) -> DataFrame:
    # Only the line count of each text is joined, not the text.
    sizes = t.source_files.select("run_id", "path", (F.regexp_count("content", F.lit("\n")) + 1).alias("line_count"))
    return filters.severity_filter(t.model_findings.join(sizes, ["run_id", "path"]), line_count=F.col("line_count")).select(
        "path", "ordinal", "level", F.col("editor_line").cast("int").alias("editor_line"), "title")


@query("issues_sorted", """
SELECT path, ordinal, severity, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3
  WHEN 'info' THEN 4 ELSE -1 END AS severity_rank FROM {model_findings}""")
def _(t: Tables) -> DataFrame:
    return filters.issues_sorted(t.model_findings).select("path", "ordinal", "severity", "severity_rank")


_ACTIVE = ", ".join(
    f"('{r.id}', '{name}')" for r in rule_catalog.builtin_rules() for name in r.languages if r.id not in ("pyspark-002", "sql-009"))


@query("rules_active", f"""
SELECT f.path, count(*) AS rules FROM {{source_files}} f JOIN (VALUES {_ACTIVE}) c(id, language) ON c.language = f.language
GROUP BY f.path""")
def _(t: Tables) -> DataFrame:
    catalog = rule_catalog.scan_rule_catalog(t.spark)
    active = rules.rules_active(catalog, disabled=["pyspark-002", "sql-009"])
    per_language = active.groupBy("language").agg(F.count("*").alias("rules"))
    return t.source_files.select("path", "language").join(per_language, "language").select("path", "rules")


@query("rule_overrides", """
SELECT severity, message, count(*) AS findings FROM (
  SELECT CASE WHEN rule_id = 'common-001' THEN 'high' ELSE severity END AS severity,
         CASE WHEN rule_id = 'scala-001' THEN 'no var please' ELSE message END AS message
  FROM {rule_findings} WHERE rule_id NOT IN ('common-003', 'sql-010')) f GROUP BY severity, message""")
def _(t: Tables) -> DataFrame:
    schema = "id string, enabled boolean, severity string, message string, deleted boolean"
    changes = local_table(t.spark, [
        ("common-001", None, "high", None, False), ("scala-001", None, None, "no var please", False),
        ("common-003", False, None, None, False), ("sql-010", None, None, None, True)], schema)
    catalog = rules.apply_overrides(rule_catalog.scan_rule_catalog(t.spark), changes)
    kept = catalog.where("enabled").select(F.col("id").alias("rule_id"), "severity", "message")
    found = t.rule_findings.groupBy("rule_id").agg(F.count("*").alias("n"))
    return found.join(kept, "rule_id").groupBy("severity", "message").agg(F.sum("n").alias("findings"))


# ---------------------------------------------------------------------- language detection

@query("language_by_extension", """
SELECT path, CASE lower(split_part(path, '.', -1)) WHEN 'py' THEN 'python' WHEN 'scala' THEN 'scala' WHEN 'sql' THEN 'sql'
  WHEN 'tf' THEN 'terraform' ELSE 'text' END AS detected FROM {source_files}
UNION ALL
SELECT url AS path, CASE lower(split_part(url, '.', -1)) WHEN 'js' THEN 'javascript' WHEN 'json' THEN 'json' ELSE 'text' END FROM {pages}""")
def _(t: Tables) -> DataFrame:
    paths = t.source_files.select("path").unionByName(t.pages.select(F.col("url").alias("path")))
    return paths.select("path", lang.language_by_extension(F.col("path")).alias("detected"))


@query("language_by_extension_cli", """
SELECT path, CASE lower(split_part(path, '.', -1)) WHEN 'scala' THEN 'scala' WHEN 'sql' THEN 'sql' WHEN 'tf' THEN 'terraform'
  ELSE 'python' END AS detected FROM {source_files}""")
def _(t: Tables) -> DataFrame:
    return t.source_files.select("path", lang.language_by_extension_cli(F.col("path")).alias("detected"))


_INDICATORS = " OR ".join(f"contains(content, '{i}')" for i in lang.PYSPARK_INDICATORS)


@query("effective_language", f"""
SELECT path, CASE WHEN named = 'python' AND ({_INDICATORS}) THEN 'pyspark' ELSE named END AS effective
FROM (SELECT path, content, CASE WHEN language <> 'pyspark' THEN language WHEN path LIKE '%.py' THEN 'python' ELSE 'scala' END AS named
      FROM {{source_files}}) s""")
def _(t: Tables) -> DataFrame:
    given = F.when(F.col("language") != "pyspark", F.col("language"))
    return t.source_files.select("path", lang.effective_language(F.col("path"), F.col("content"), given).alias("effective"))


@query("editor_language", """
SELECT path, CASE id WHEN 'python' THEN CASE WHEN regexp_matches(content, '(from|import)[\\s\\x{a0}\\x{feff}]+pyspark') THEN 'pyspark' ELSE 'python' END
  WHEN 'scala' THEN 'scala' WHEN 'sql' THEN 'sql' WHEN 'hcl' THEN 'terraform' WHEN 'terraform' THEN 'terraform' END AS language
FROM (SELECT path, CASE file_no % 7 WHEN 0 THEN 'hcl' WHEN 1 THEN 'go' ELSE CASE language WHEN 'pyspark' THEN 'python' ELSE language END END AS id,
        CASE file_no % 3 WHEN 0 THEN concat('import pyspark', chr(10), content) WHEN 1 THEN concat('from', chr(10), ' pyspark', content) ELSE content END AS content
      FROM {source_files}) s""".replace("{a0}", "{{a0}}").replace("{feff}", "{{feff}}"))
def _(t: Tables) -> DataFrame:
    number = F.col("file_no")
    given = F.when(number % 7 == 0, "hcl").when(number % 7 == 1, "go").when(F.col("language") == "pyspark", "python").otherwise(F.col("language"))
    content = F.when(number % 3 == 0, F.concat(F.lit("import pyspark\n"), "content")).when(
        number % 3 == 1, F.concat(F.lit("from\n pyspark"), "content")).otherwise(F.col("content"))
    return t.source_files.select("path", lang.editor_language(given, content).alias("language"))


def _signal_sql(signals) -> str:
    parts = [s if isinstance(s, tuple) else (s,) for s in signals]
    return " OR ".join("(" + " AND ".join(f"contains(c, {oracles.text_literal(p)})" for p in s) + ")" for s in parts)


_STATEMENTS = " OR ".join(f"regexp_matches(content, '(?im){p}')" for p in lang.SQL_STATEMENTS)


@query("language_by_content", f"""
SELECT path, CASE WHEN {_signal_sql(lang.TERRAFORM_SIGNALS)} THEN 'terraform' WHEN {_signal_sql(lang.SCALA_SIGNALS)} THEN 'scala'
  WHEN {_signal_sql(lang.PYSPARK_SIGNALS)} THEN 'pyspark' WHEN {_signal_sql(lang.PYTHON_SIGNALS)} THEN 'python'
  WHEN {_STATEMENTS} THEN 'sql' ELSE 'python' END AS detected
FROM (SELECT path, content, lower(content) AS c FROM {{source_files}}) s""")
def _(t: Tables) -> DataFrame:
    lowered = t.files.withColumn("lowered", F.lower("content"))
    return lowered.select("path", lang.language_by_content(F.col("content"), F.col("lowered")).alias("detected"))


# --------------------------------------------------------------------------------- rule scan

@query("rule_scan", """
SELECT path, ordinal, rule_id, severity, category, message, suggestion, line_number FROM {rule_findings}""")
def _(t: Tables) -> DataFrame:
    return rules.rule_scan(t.files)


@query("first_match_line", """
SELECT rule_id, count(*) AS findings, count(line_number) AS with_line, min(line_number) AS lowest, max(line_number) AS highest,
  sum(line_number)::BIGINT AS line_sum FROM {rule_findings} GROUP BY rule_id""")
def _(t: Tables) -> DataFrame:
    return rules.rule_scan(t.files).groupBy("rule_id").agg(
        F.count("*").alias("findings"), F.count("line_number").alias("with_line"), F.min("line_number").alias("lowest"),
        F.max("line_number").alias("highest"), F.sum("line_number").alias("line_sum"))


_CUSTOM = [
    (1, "custom-001", "Tracking", True, "custom", r"track\(", None, "high", "security", "tracking call", "remove", ["python", "scala"]),
    (2, "custom-002", "Template", True, "custom", r"<ARTICLE|<MAIN", "", "low", "logging", "upper case tag", "lower", ["python"]),
    (3, "custom-003", "Quoted", True, "custom", r"secret\s*=|passw", "i", "critical", "security", "secret", "vault",
     ["sql", "terraform", "pyspark"]),
    (4, "custom-004", "Off", False, "custom", r".", None, "info", "logging", "never", "never", ["python"]),
]


@query("rule_scan_custom", """
SELECT path, rule_id, severity, nullif(list_position(list_transform(string_split(content, chr(10)), lambda l: regexp_matches(l, regex)), true), 0)::INT AS line_number
FROM {source_files} JOIN (VALUES ('custom-001', 'high', '(?i)track\\(', ['python', 'scala']), ('custom-002', 'low', '<ARTICLE|<MAIN', ['python']),
  ('custom-003', 'critical', '(?i)secret\\s*=|passw', ['sql', 'terraform', 'pyspark'])) c(rule_id, severity, regex, languages)
  ON list_contains(languages, language) WHERE regexp_matches(content, regex)""")
def _(t: Tables) -> DataFrame:
    catalog = local_table(t.spark, _CUSTOM, rule_catalog.RULE_SCHEMA)
    return rules.rule_scan_custom(t.files, catalog).select("path", "rule_id", "severity", "line_number")


_RULE_FILE = [
    {"id": "team-001", "name": "Tracking", "pattern": r"TRACK\(", "severity": "high", "category": "security",
     "message": "tracking call", "suggestion": "remove", "languages": ["python", "scala"]},
    {"id": "team-002", "name": "Article", "enabled": True, "pattern": {"source": "<article", "flags": ""}, "severity": "low",
     "category": "logging", "message": "article tag", "suggestion": "drop", "languages": ["python"]},
    {"id": "team-003", "name": "Off", "enabled": False, "pattern": ".", "severity": "info", "category": "logging",
     "message": "never", "suggestion": "never", "languages": ["python"]},
    {"id": "team-004", "name": "Broken", "pattern": "(", "severity": "info", "category": "logging",
     "message": "never", "suggestion": "never", "languages": ["python"]},
]


@query("rule_files_scan", """
SELECT path, rule_id, severity, nullif(list_position(list_transform(string_split(content, chr(10)), lambda l: regexp_matches(l, regex)), true), 0)::INT AS line_number
FROM {source_files} JOIN (VALUES ('team-001', 'high', '(?i)TRACK\\(', ['python', 'scala']), ('team-002', 'low', '<article', ['python']))
  c(rule_id, severity, regex, languages) ON list_contains(languages, language) WHERE regexp_matches(content, regex)
UNION ALL SELECT 'rejected', 'team-004', 'info', NULL""")
def _(t: Tables) -> DataFrame:
    path = t.scratch("rule-files")
    local_table(t.spark, [(json.dumps(_RULE_FILE),)], "value string").write.text(path)
    catalog = rule_catalog.scan_rule_files(t.spark, path)
    found = rules.rule_scan_custom(t.files, catalog).select("path", "rule_id", "severity", "line_number")
    rejected = rules.rejected_rules(catalog).select(
        F.lit("rejected").alias("path"), F.col("id").alias("rule_id"), "severity", F.lit(None).cast("int").alias("line_number"))
    return found.unionByName(rejected)


@query("rule_hit_counts", """
SELECT 'rule' AS level, rule_id AS key, count(*) AS findings, count(DISTINCT path) AS files FROM {rule_findings} GROUP BY rule_id
UNION ALL SELECT 'severity', severity, count(*), count(DISTINCT path) FROM {rule_findings} GROUP BY severity
UNION ALL SELECT 'category', category, count(*), count(DISTINCT path) FROM {rule_findings} GROUP BY category""")
def _(t: Tables) -> DataFrame:
    # One scan: each finding is counted under its three keys.
    keyed = rules.rule_scan(t.files, keys=("run_id", "path")).select("run_id", "path", F.explode(F.array(*[
        F.struct(F.lit(level).alias("level"), F.col(c).alias("key"))
        for level, c in (("rule", "rule_id"), ("severity", "severity"), ("category", "category"))])).alias("k")
    ).select("run_id", "path", "k.level", "k.key")
    return rules.rule_hit_counts(keyed, ["level", "key"])


@query("structural_rules", """
SELECT path, rule_id FROM {rule_findings} WHERE rule_id IN ('pyspark-001', 'python-001', 'python-006', 'scala-009', 'scala-010',
  'scala-013', 'scala-014', 'scala-017', 'terraform-002', 'terraform-003', 'terraform-005', 'terraform-006', 'terraform-008')""")
def _(t: Tables) -> DataFrame:
    structural = [r for r in rule_catalog.builtin_rules() if not r.pattern]
    return rules.rule_scan(t.files, structural).select("path", "rule_id")


# ------------------------------------------------------------ model responses and merge

@query("parse_findings", """
SELECT path, response_id, pos, severity, category, message, line_number, suggestion, reasoning FROM {answer_issues}""")
def _(t: Tables) -> DataFrame:
    return responses.parse_findings(t.model_responses)


@query("parse_review", f"""
SELECT path, ordinal AS response_id, ordinal % 11 <> 0 AS readable, CASE WHEN ordinal % 11 = 0 THEN 0 ELSE 2 END AS issue_count,
  CASE WHEN ordinal % 11 = 0 THEN '' ELSE concat('clear ', category, '|tested') END AS strengths,
  CASE WHEN ordinal % 11 = 0 THEN '{responses.UNREADABLE_REVIEW}' ELSE suggestion END AS recommendations,
  CASE WHEN ordinal % 11 <> 0 THEN concat('x = ', CAST(ordinal AS STRING)) END AS refactored_code
FROM {{model_findings}}""")
def _(t: Tables) -> DataFrame:
    return responses.parse_review(t.model_responses).select(
        "path", "response_id", "readable", F.size("issues").alias("issue_count"), F.array_join("strengths", "|").alias("strengths"),
        F.array_join("recommendations", "|").alias("recommendations"), "refactored_code")


@query("parse_batch_response", f"""
SELECT 'file' AS kind, ordinal AS response_id, path, message,
  {oracles.rule_id_sql('category', 'message')} AS rule_id,
  CASE WHEN ordinal % 3 = 0 OR ordinal % 101 = 0 THEN 70.0 ELSE ordinal % 101 END::DOUBLE AS score
FROM {{model_findings}} WHERE ordinal % 13 <> 0
UNION ALL
SELECT 'cross', ordinal, NULL, concat('cross ', suggestion), {oracles.rule_id_sql("'ARCH'", "concat('cross ', suggestion)")}, NULL
FROM {{model_findings}} WHERE ordinal % 13 <> 0""")
def _(t: Tables) -> DataFrame:
    parsed = responses.parse_batch_response(t.batch_responses)
    scores = parsed["files"].select("response_id", "path", "score")
    files = parsed["issues"].join(scores, ["response_id", "path"]).select(
        F.lit("file").alias("kind"), "response_id", "path", "message", "rule_id", "score")
    cross = parsed["cross_file"].select(
        F.lit("cross").alias("kind"), "response_id", F.lit(None).cast("string").alias("path"), "message", "rule_id",
        F.lit(None).cast("double").alias("score"))
    return files.unionByName(cross)


@query("issue_similarity", """
SELECT m.path, m.ordinal, s.first AS similar_rule, s.first IS NOT NULL AS is_similar
FROM {candidates} m LEFT JOIN (
  SELECT b.path, b.ordinal, min(a.ordinal) AS first FROM {candidates} a JOIN {candidates} b
    ON a.path = b.path AND a.run_id = b.run_id AND a.is_model = 0 AND b.is_model = 1
  WHERE (a.line <> 0 AND a.line = b.line) OR (a.keywords & b.keywords) <> 0 OR (a.category = b.category AND
    len(list_intersect(a.words, b.words)) / greatest(len(a.words), len(b.words)) > 0.6)
  GROUP BY b.path, b.ordinal) s ON s.path = m.path AND s.ordinal = m.ordinal
WHERE m.is_model = 1""")
def _(t: Tables) -> DataFrame:
    return merge.first_similar_rule(t.stored_findings, t.model_findings).select("path", "ordinal", "similar_rule", "is_similar")


@query("similar_pairs", """
WITH c AS (SELECT *, min(is_model * 1000000000 + ordinal) OVER w AS head, count(*) OVER w AS members FROM {candidates}
  WINDOW w AS (PARTITION BY run_id, path, line, keywords, category, list_sort(words)))
SELECT a.run_id, a.path, a.is_model AS kind, a.ordinal, any_value(a.head) // 1000000000 AS class_kind, any_value(a.head) % 1000000000 AS class_ordinal,
  any_value(a.members) AS members, count(b.place) AS links
FROM c a LEFT JOIN c b ON a.run_id = b.run_id AND a.path = b.path AND a.place <> b.place AND (
  (a.line <> 0 AND a.line = b.line) OR (a.keywords & b.keywords) <> 0 OR (a.category IS NOT DISTINCT FROM b.category AND
    len(list_intersect(a.words, b.words)) / greatest(len(a.words), len(b.words)) > 0.6))
GROUP BY a.run_id, a.path, a.is_model, a.ordinal""")
def _(t: Tables) -> DataFrame:
    return merge.similar_links(t.stored_findings, t.model_findings)


@query("merge_findings", oracles.MERGED + """
SELECT b.path, b.is_model AS target_model, b.ordinal, b.severity, b.category, b.message, b.line_number,
  concat(b.suggestion, coalesce(n.added, '')) AS suggestion, coalesce(n.last, b.reasoning) AS reasoning, coalesce(n.attached, 0) AS merged_count
FROM placed b LEFT JOIN notes n ON n.run_id = b.run_id AND n.path = b.path AND n.target = b.place WHERE b.place = b.target""")
def _(t: Tables) -> DataFrame:
    return merge.merge_findings(t.stored_findings, t.model_findings).select(
        "path", "target_model", "ordinal", "severity", "category", "message", "line_number", "suggestion", "reasoning", "merged_count")


@query("merge_findings_tagged", oracles.MERGED + """
SELECT b.path, b.ordinal, b.message,
  concat(b.suggestion, CASE WHEN b.is_model = 1 AND b.reasoning <> '' THEN concat(chr(10), chr(10), 'Reasoning: ', b.reasoning) ELSE '' END,
         coalesce(n.added, '')) AS suggestion,
  CASE WHEN n.attached > 0 THEN 'both' WHEN b.is_model = 0 THEN 'internal' ELSE 'external' END AS validation_source
FROM placed b LEFT JOIN notes n ON n.run_id = b.run_id AND n.path = b.path AND n.target = b.place WHERE b.place = b.target""")
def _(t: Tables) -> DataFrame:
    return merge.merge_findings_tagged(t.stored_findings, t.model_findings).select(
        "path", "ordinal", "message", "suggestion", "validation_source")


@query("merge_batch_findings", """
WITH keyed AS (SELECT *, row_number() OVER w AS rn, count(*) FILTER (is_model = 1) OVER g AS models
  FROM {candidates} WINDOW g AS (PARTITION BY path, line_number, lower(category)),
    w AS (PARTITION BY path, line_number, lower(category) ORDER BY is_model, ordinal)),
last AS (SELECT path, line_number, lower(category) AS cat, arg_max(reasoning, ordinal) AS reasoning FROM keyed
  WHERE is_model = 1 AND rn > 1 AND reasoning <> '' GROUP BY path, line_number, lower(category))
SELECT k.path, k.is_model, k.ordinal, k.message,
  CASE WHEN k.rn = 1 THEN coalesce(l.reasoning, k.reasoning) END AS reasoning,
  CASE WHEN k.rn = 1 AND k.models - k.is_model > 0 THEN 'both' WHEN k.is_model = 0 THEN 'pattern' ELSE 'ai' END AS source
FROM keyed k LEFT JOIN last l ON l.path = k.path AND l.line_number IS NOT DISTINCT FROM k.line_number AND l.cat = lower(k.category)
WHERE k.rn = 1 OR k.is_model = 0""")
def _(t: Tables) -> DataFrame:
    return merge.merge_batch_findings(t.stored_findings, t.model_findings, t.source_files).select(
        "path", "is_model", "ordinal", "message", "reasoning", "source")


@query("llm_findings_exact", """
SELECT path, ordinal, severity, message FROM {model_findings} m
WHERE NOT EXISTS (SELECT 1 FROM {rule_findings} r WHERE r.path = m.path AND r.message = m.message)""")
def _(t: Tables) -> DataFrame:
    return merge.llm_findings_exact(t.rule_findings, t.model_findings).select("path", "ordinal", "severity", "message")


@query("all_findings", """
SELECT path, ordinal, severity, message, 'validation' AS kind FROM {rule_findings}
UNION ALL SELECT path, ordinal, severity, message, 'llm' FROM {model_findings}""")
def _(t: Tables) -> DataFrame:
    return merge.all_findings(t.rule_findings, t.model_findings).select("path", "ordinal", "severity", "message", "kind")


@query("notes_union", """
SELECT path, ordinal AS response_id,
  CASE WHEN ordinal % 11 = 0 THEN 'tested' ELSE concat('tested|clear ', category) END AS distinct_notes,
  CASE WHEN ordinal % 11 = 0 THEN 'tested' ELSE concat('tested|clear ', category, '|tested') END AS all_notes
FROM {model_findings}""")
def _(t: Tables) -> DataFrame:
    own = F.array(F.lit("tested"))
    return responses.parse_review(t.model_responses).select(
        "path", "response_id", F.array_join(merge.notes_union(own, F.col("strengths")), "|").alias("distinct_notes"),
        F.array_join(merge.notes_union(own, F.col("strengths"), dedupe=False), "|").alias("all_notes"))


@query("finding_rule_id", f"""
SELECT path, ordinal, {oracles.rule_id_sql('category', 'message')} AS rule_id,
  {oracles.rule_id_sql('category', 'message', False)} AS rule_id_cli FROM {{model_findings}}""")
def _(t: Tables) -> DataFrame:
    ids = t.model_findings.withColumn("rule_id", finding_rule_id(F.col("category"), F.col("message")))
    return ids.select("path", "ordinal", "rule_id",
                      finding_rule_id(F.col("category"), F.col("message"), upper=False).alias("rule_id_cli"))
