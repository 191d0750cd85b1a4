"""Domain tables derived from the given tables.

Each view is one SELECT that Spark and DuckDB both accept, so a query and its oracle start from
the same rows.  Names in braces are the given tables or earlier views.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from reviewlake.session import spread

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    "run_metrics": """
SELECT event_id AS id,
  concat('org/repo-', CAST(user_id % 20 AS STRING)) AS repository,
  concat('proj-', CAST(user_id % 7 AS STRING)) AS project_id,
  concat('wf-', CAST(event_id AS STRING)) AS workflow_run_id,
  ts,
  CAST(1 AS BIGINT) AS request_count,
  CAST(floor(value * 10) AS BIGINT) AS input_tokens,
  CAST(floor(value) AS BIGINT) AS output_tokens,
  CAST(floor(value * 10) AS BIGINT) + CAST(floor(value) AS BIGINT) AS total_tokens,
  CAST(floor(value * 100) AS BIGINT) AS latency_ms,
  CASE event_type WHEN 'error' THEN 'failure' WHEN 'signup' THEN 'partial' ELSE 'success' END AS status,
  event_id % 10 AS files_reviewed, event_id % 13 AS issues_found,
  event_id % 3 AS critical_count, event_id % 5 AS high_count,
  CASE event_id % 8 WHEN 0 THEN 'claude-opus-4-x' WHEN 1 THEN 'gpt-4o-2024-08-06' WHEN 2 THEN 'gpt-4o'
    WHEN 3 THEN 'claude-sonnet-4-20250514' WHEN 4 THEN 'claude-haiku-4' WHEN 5 THEN 'unknown-model'
    WHEN 6 THEN NULL ELSE 'gpt-3.5-turbo' END AS model,
  CASE user_id % 3 WHEN 0 THEN 'pipeline' WHEN 1 THEN 'ide' ELSE 'application' END AS source
FROM {events}""",
    # Metric posts before validation: missing ids, unknown states, absent counters.
    "raw_metrics": """
SELECT id, CASE WHEN id % 17 = 0 THEN NULL WHEN id % 23 = 0 THEN '' ELSE repository END AS repository,
  CASE WHEN id % 19 = 0 THEN NULL ELSE project_id END AS project_id,
  workflow_run_id, ts,
  CASE WHEN id % 4 = 0 THEN NULL ELSE request_count END AS request_count,
  CASE WHEN id % 6 = 0 THEN NULL ELSE input_tokens END AS input_tokens,
  CASE WHEN id % 7 = 0 THEN NULL ELSE output_tokens END AS output_tokens,
  CASE WHEN id % 2 = 0 THEN NULL ELSE total_tokens END AS total_tokens,
  CASE WHEN id % 9 = 0 THEN NULL ELSE latency_ms END AS latency_ms,
  CASE WHEN id % 29 = 0 THEN 'done' WHEN id % 5 = 0 THEN NULL ELSE status END AS status,
  files_reviewed, issues_found, critical_count, high_count, model,
  CASE WHEN id % 10 = 0 THEN CAST(0.5 AS DOUBLE) ELSE NULL END AS cost_usd,
  CASE WHEN id % 3 = 0 THEN NULL ELSE source END AS source
FROM {run_metrics}""",
    # Run rows before validation, one per order.
    "raw_runs": """
SELECT CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE concat('run-', CAST(o_orderkey AS STRING)) END AS run_id,
  concat('org/repo-', CAST(o_custkey % 20 AS STRING)) AS repository,
  CASE WHEN o_orderkey % 37 = 0 THEN '' ELSE concat('wf-', CAST(o_orderkey AS STRING)) END AS workflow_run_id,
  concat('proj-', CAST(o_custkey % 7 AS STRING)) AS project_id,
  CASE WHEN o_orderkey % 41 = 0 THEN 'maybe' WHEN o_orderkey % 3 = 0 THEN NULL
       WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'pass' END AS gate_status,
  CASE WHEN o_orderkey % 43 = 0 THEN 'done' WHEN o_orderkey % 4 = 0 THEN NULL
       WHEN o_orderstatus = 'F' THEN 'failure' WHEN o_orderstatus = 'P' THEN 'partial' ELSE 'success' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_orderkey % 9 END AS total_issues,
  CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE o_custkey % 900 END AS latency_ms,
  CASE WHEN o_orderkey % 2 = 0 THEN NULL ELSE o_custkey % 700 END AS runtime_ms,
  CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'ide' ELSE 'application' END AS source,
  o_orderdate AS ts
FROM {orders}""",
    "training_records": """
SELECT o_orderkey AS id,
  concat('run-', CAST(o_orderkey AS STRING)) AS run_id,
  o_orderdate AS created_at,
  concat('org/repo-', CAST(o_custkey % 20 AS STRING)) AS repository,
  concat('v', substring(o_orderpriority, 1, 1)) AS model_version,
  CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'pass' END AS gate_status,
  CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'P' THEN 'partial' ELSE 'success' END AS status,
  o_orderkey % 9 AS total_issues,
  CASE o_custkey % 3 WHEN 0 THEN 'pipeline' WHEN 1 THEN 'ide' ELSE 'application' END AS source
FROM {orders}""",
    "training_feedback": """
SELECT l_orderkey AS record_id,
  concat('run-', CAST(l_orderkey AS STRING)) AS run_id,
  l_linenumber AS finding_index,
  CASE WHEN l_linenumber = 7 THEN 'gate' WHEN l_linestatus = 'O' THEN 'validation'
       WHEN l_linenumber % 2 = 0 THEN 'llm' ELSE NULL END AS finding_type,
  CASE l_returnflag WHEN 'A' THEN 'accept' WHEN 'R' THEN 'reject' ELSE 'modify' END AS action,
  CASE l_linenumber % 3 WHEN 0 THEN 'dashboard' WHEN 1 THEN 'gh' ELSE 'pr' END AS feedback_channel,
  concat('user-', CAST(l_suppkey AS STRING)) AS reviewer_id,
  l_shipdate AS created_at
FROM {lineitem}""",
    # Feedback posts before validation: missing run, unknown action, run without a record.
    "raw_feedback": """
SELECT CASE WHEN l_partkey % 31 = 0 THEN NULL
            WHEN l_partkey % 29 = 0 THEN concat('lost-', CAST(l_orderkey AS STRING))
            ELSE concat('run-', CAST(l_orderkey AS STRING)) END AS run_id,
  CASE WHEN l_partkey % 37 = 0 THEN 'like' WHEN l_returnflag = 'A' THEN 'accept'
       WHEN l_returnflag = 'R' THEN 'reject' ELSE 'modify' END AS action,
  l_linenumber AS finding_index,
  CASE WHEN l_linestatus = 'O' THEN 'validation' ELSE NULL END AS finding_type,
  CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 'gh' ELSE 'pr' END AS feedback_channel,
  concat('user-', CAST(l_suppkey AS STRING)) AS reviewer_id,
  l_shipdate AS created_at
FROM {lineitem}""",
    "source_files": """
SELECT concat('run-', CAST(CAST(floor(doc_id / 5) AS BIGINT) AS STRING)) AS run_id, doc_id AS file_no,
  concat(source, '/doc', CAST(doc_id AS STRING),
    CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.py' WHEN 2 THEN '.scala' WHEN 3 THEN '.sql' ELSE '.tf' END) AS path,
  text AS content,
  CASE doc_id % 5 WHEN 0 THEN 'pyspark' WHEN 1 THEN 'python' WHEN 2 THEN 'scala' WHEN 3 THEN 'sql'
       ELSE 'terraform' END AS language
FROM {documents}
UNION ALL
SELECT concat('run-p', CAST(CAST(floor(page_id / 5) AS BIGINT) AS STRING)) AS run_id, page_id AS file_no,
  concat('pages/p', CAST(page_id AS STRING), CASE page_id % 2 WHEN 0 THEN '.py' ELSE '.scala' END) AS path,
  html AS content,
  CASE page_id % 2 WHEN 0 THEN 'python' ELSE 'scala' END AS language
FROM {pages}""",
    # Parsed model findings, about ten per document; the event id orders them.
    "model_findings": """
SELECT concat('run-', CAST(CAST(floor(doc_id / 5) AS BIGINT) AS STRING)) AS run_id,
  concat(d.source, '/doc', CAST(doc_id AS STRING),
    CASE doc_id % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.py' WHEN 2 THEN '.scala' WHEN 3 THEN '.sql' ELSE '.tf' END) AS path,
  event_id AS ordinal,
  CASE WHEN event_id % 11 = 0 THEN 'critical' WHEN event_id % 7 = 0 THEN 'high' WHEN event_id % 3 = 0 THEN 'medium'
       WHEN event_id % 2 = 0 THEN 'low' ELSE 'info' END AS severity,
  CASE event_type WHEN 'click' THEN 'Performance' WHEN 'view' THEN 'performance' WHEN 'error' THEN 'security'
       WHEN 'signup' THEN 'maintainability' ELSE 'code-structure' END AS category,
  CASE event_id % 13 WHEN 0 THEN concat('Avoid collect on ', p_name) WHEN 1 THEN concat('Account name in ', p_name)
       WHEN 2 THEN 'Missing docstrings for documentation and troubleshooting'
       WHEN 3 THEN concat('The value of ', p_name, ' is never checked') ELSE p_name END AS message,
  CAST(CASE WHEN event_id % 4 = 0 THEN CAST(floor(value) AS BIGINT) % 30 ELSE NULL END AS INT) AS line_number,
  concat('fix part ', CAST(p_partkey AS STRING)) AS suggestion,
  CASE WHEN user_id % 2 = 0 THEN concat('reason ', CAST(user_id AS STRING)) WHEN user_id % 5 = 0 THEN ''
       ELSE NULL END AS reasoning
FROM (SELECT *, event_id % (SELECT count(*) FROM {documents}) AS target FROM {events}) e
JOIN (SELECT doc_id, source FROM {documents}) d ON doc_id = target
JOIN {part} ON p_partkey = user_id""",
    # Stored model answers, one per event, in the shapes models really return.
    "model_responses": """
SELECT run_id, path, ordinal AS response_id,
  CASE WHEN ordinal % 11 = 0 THEN substring(body, 1, 60)
       WHEN ordinal % 7 = 0 THEN replace(body, '}}]', '}},]')
       WHEN ordinal % 5 = 0 THEN concat('Here is the review: ', body, ' Hope it helps.')
       WHEN ordinal % 2 = 0 THEN concat(chr(96), chr(96), chr(96), 'json', chr(10), body, chr(10),
                                        chr(96), chr(96), chr(96))
       ELSE body END AS response_text
FROM (SELECT run_id, path, ordinal,
        concat('{{"issues": [{{"severity": "', severity, '", "category": "', category, '", "message": "', message,
               '", "suggestion": "', suggestion, '"',
               CASE WHEN line_number IS NULL THEN '' ELSE concat(', "lineNumber": ', CAST(line_number AS STRING)) END,
               CASE WHEN reasoning IS NULL THEN '' ELSE concat(', "reasoning": "', reasoning, '"') END,
               '}}, {{"severity": "info", "category": "Logic", "message": "also see ', suggestion,
               '", "suggestion": "none"}}], "strengths": ["clear ', category, '", "tested"], ',
               '"recommendations": ["', suggestion, '"], "refactoredCode": "x = ', CAST(ordinal AS STRING), '"}}') AS body
      FROM {model_findings}) r""",
    # Batch answers: one file per answer, sometimes without a score, sometimes cut.
    "batch_responses": """
SELECT run_id, ordinal AS response_id,
  CASE WHEN ordinal % 13 = 0 THEN substring(body, 1, 80) ELSE body END AS response_text
FROM (SELECT run_id, ordinal,
        concat('{{"files": [{{"path": "', path, '", "issues": [{{"severity": "', severity, '", "category": "', category,
               '", "message": "', message, '", "suggestion": "', suggestion, '"',
               CASE WHEN line_number IS NULL THEN '' ELSE concat(', "lineNumber": ', CAST(line_number AS STRING)) END,
               CASE WHEN reasoning IS NULL THEN '' ELSE concat(', "reasoning": "', reasoning, '"') END,
               '}}], "strengths": ["clear ', category, '"], "recommendations": []',
               CASE WHEN ordinal % 3 = 0 THEN '' ELSE concat(', "score": ', CAST(ordinal % 101 AS STRING)) END,
               '}}], "crossFileIssues": [{{"severity": "medium", "message": "cross ', suggestion, '"}}]}}') AS body
      FROM {model_findings}) r""",
    # Token usage per run.
    "run_usage": """
SELECT run_id, concat('claude-sonnet-4-2025', CAST(min(ordinal) % 7 AS STRING)) AS model,
  CAST(sum(1000 + ordinal % 500) AS BIGINT) AS input_tokens, CAST(sum(100 + ordinal % 50) AS BIGINT) AS output_tokens
FROM {model_findings} GROUP BY run_id""",
    # Webhook posts for every record: reactions, review states and unrelated events.
    "webhook_events": """
SELECT event_id,
  CASE WHEN event_id % 10 = 9 THEN 'push' WHEN event_id % 2 = 0 THEN 'issue_comment'
       ELSE 'pull_request_review' END AS event,
  CASE WHEN event_id % 2 = 0 THEN
    concat('{{"action": "', CASE WHEN event_id % 14 = 0 THEN 'edited' ELSE 'created' END,
           '", "sender": {{"login": "user-', CAST(user_id AS STRING), '"}}, "comment": {{"body": "',
           CASE WHEN event_id % 22 = 0 THEN 'thanks' ELSE '## AI Code Review' END,
           CASE WHEN event_id % 26 = 0 THEN '' ELSE concat(' Run: ', chr(96), 'run-', CAST(event_id * 2 AS STRING), chr(96)) END,
           '"}}, "reaction": {{"content": "', CASE event_id % 3 WHEN 0 THEN '+1' WHEN 1 THEN '-1' ELSE 'heart' END, '"}}}}')
  ELSE
    concat('{{"sender": {{"login": "user-', CAST(user_id AS STRING), '"}}, "review": {{"state": "',
           CASE event_id % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'changes_requested' ELSE 'commented' END,
           '", "body": "',
           CASE WHEN event_id % 35 = 0 THEN 'looks good' ELSE concat('see run_id: run-', CAST(event_id * 2 AS STRING)) END,
           '"}}}}')
  END AS body
FROM {events}""",
    # Stored runs with their nested columns as JSON text, some of it broken.
    "stored_runs": """
SELECT concat('run-', CAST(o_orderkey AS STRING)) AS run_id,
  concat('org/repo-', CAST(o_custkey % 20 AS STRING)) AS repository,
  concat('wf-', CAST(o_orderkey AS STRING)) AS workflow_run_id,
  CASE WHEN o_orderstatus = 'F' THEN 'fail' ELSE 'pass' END AS gate_status,
  CASE o_orderstatus WHEN 'F' THEN 'failure' WHEN 'P' THEN 'partial' ELSE 'success' END AS status,
  CASE WHEN o_orderkey % 7 = 0 THEN '[{{"severity": ' WHEN o_orderkey % 5 = 0 THEN NULL
       ELSE concat('[{{"severity": "high", "message": "m', CAST(o_custkey AS STRING), '", "line_number": 3}}]') END
    AS validation_failures,
  '[{{"severity": "low", "message": "a"}}, {{"severity": "info", "message": "b"}}]' AS llm_findings,
  CASE WHEN o_orderkey % 11 = 0 THEN 'n/a' ELSE concat('{{"critical": ', CAST(o_orderkey % 3 AS STRING),
       ', "high": 1, "medium": 0, "low": 1, "info": 1}}') END AS severity_distribution,
  o_orderkey % 9 AS total_issues, o_custkey % 900 AS latency_ms, o_orderdate AS ts,
  CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_custkey % 3 = 0 THEN 'ide' ELSE 'application' END AS source
FROM {orders}""",
    # Several writes per run: one per order, keyed by customer.
    "run_writes": """
SELECT concat('run-', CAST(o_custkey AS STRING)) AS run_id, o_orderkey AS ingest_seq,
  o_orderstatus AS status, o_orderkey % 9 AS total_issues
FROM {orders}""",
    # Editor and web runs, one per event.
    "ide_runs": """
SELECT concat('ide-', CAST(event_id AS STRING)) AS run_id,
  CASE event_id % 3 WHEN 0 THEN 'application' WHEN 1 THEN 'ide' ELSE NULL END AS source,
  CASE WHEN event_id % 4 = 0 THEN concat(' user-', CAST(user_id AS STRING), ' ') WHEN event_id % 4 = 1 THEN ' '
       ELSE NULL END AS user_id,
  CASE WHEN event_id % 5 = 0 THEN concat('org/repo-', CAST(user_id % 20 AS STRING)) ELSE NULL END AS repository,
  CASE WHEN event_id % 7 = 0 THEN 'proj-1' ELSE NULL END AS project_id,
  CASE event_id % 4 WHEN 0 THEN 'pyspark' WHEN 1 THEN 'sql' WHEN 2 THEN 'scala' ELSE 'terraform' END AS language
FROM {events}""",
    # Review requests: the runs of the files, a few without repository or files.
    "review_requests": """
SELECT DISTINCT run_id,
  CASE WHEN length(run_id) = 5 THEN NULL ELSE concat('org/', run_id) END AS repository,
  CASE WHEN run_id LIKE '%7' THEN '' ELSE concat('wf-', run_id) END AS workflow_run_id
FROM {source_files}
UNION ALL
SELECT DISTINCT concat('empty-', CAST(o_custkey AS STRING)) AS run_id, 'org/x' AS repository, 'wf' AS workflow_run_id
FROM {orders}""",
    # Review results as the command line tool stores them, one per order.
    "review_results": """
SELECT concat('wf-', CAST(o_orderkey AS STRING)) AS workflow_run_id,
  concat('org/repo-', CAST(o_custkey % 20 AS STRING)) AS repository,
  o_orderdate AS ts,
  o_orderkey % 6 AS total_files, o_orderkey % 9 AS total_issues, o_orderkey % 3 AS critical_count,
  o_orderkey % 4 AS high_count, o_orderstatus <> 'F' AS pass_threshold,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 1000 END AS input_tokens,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE o_custkey % 100 END AS output_tokens,
  CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 'gpt-4o' END AS model,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_custkey END AS duration
FROM {orders}""",
}

_NAME = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _references(sql: str) -> list[str]:
    return list(dict.fromkeys(_NAME.findall(sql)))


def table(spark: SparkSession, sf_dir: str, name: str, spread_over_cores: tuple[str, ...] = ()) -> DataFrame:
    """A given table or a derived view as a DataFrame.

    ``spread_over_cores`` names given tables whose scan is redistributed when it has fewer splits
    than there are cores (see :func:`reviewlake.session.spread`).
    """
    if name in TABLES:
        scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(scan) if name in spread_over_cores else scan
    sql = VIEWS[name]
    return spark.sql(sql, **{n: table(spark, sf_dir, n, spread_over_cores) for n in _references(sql)})


def oracle(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the views it names in braces, as common table expressions."""
    order: list[str] = []
    known = {**VIEWS, **(extra or {})}

    def visit(name: str) -> None:
        if name in known and name not in order:
            for n in _references(known[name]):
                visit(n)
            order.append(name)

    for name in _references(body):
        visit(name)

    def plain(sql: str) -> str:
        return _NAME.sub(r"\1", sql).replace("{{", "{").replace("}}", "}")

    views = [f"{name} AS ({plain(known[name])})" for name in order]
    text = plain(body).strip()
    if not views:
        return text
    if text.upper().startswith("WITH RECURSIVE"):
        return "WITH RECURSIVE " + ", ".join(views) + ", " + text[len("WITH RECURSIVE"):]
    if text.upper().startswith("WITH "):
        return "WITH " + ", ".join(views) + ", " + text[len("WITH "):]
    return "WITH " + ", ".join(views) + " " + text
