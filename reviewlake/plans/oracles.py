"""Shared pieces of the oracle SQL (DuckDB).

They restate the semantics in another engine and, where possible, by another method: lines are
tested one by one instead of splitting at the first match, prices are found by a plain join, the
greedy merge walks the findings with a recursive query.
"""

from __future__ import annotations

from reviewlake.functions.regex import render
from reviewlake.functions.similarity import KEYWORDS
from reviewlake.sources.corpus import oracle as with_views
from reviewlake.sources.pricing import price_rows
from reviewlake.sources.rule_catalog import Rule, builtin_rules

# RE2 has no lookahead.  Equivalent predicates over {t} for the rules that use one.
_LOOKAHEAD = {
    "scala-002": "regexp_matches({t}, '\\.get([^A-Za-z0-9_(]|\\z)')",
    "sql-007": (
        "regexp_matches({t}, '(?i)WHERE.*=\\s*[''\"]([^N''\"][^''\"]*|N([^U''\"][^''\"]*)?|NU([^L''\"][^''\"]*)?|"
        "NUL([^L''\"][^''\"]*)?)[''\"]|VALUES\\s*\\([^)]*[''\"][^''\"]+[''\"]')"
    ),
    "sql-010": (
        "(regexp_matches({t}, '(?i)FROM\\s+\\w+\\s*,\\s*\\w\\w') OR "
        "regexp_matches({t}, '(?i)FROM\\s+\\w+\\s*,\\s*\\w(\\z|[^\\w\\s]|\\s+(\\z|[^\\sO]|O(\\z|[^N])))'))"
    ),
    "security-004": (
        "(len(regexp_extract_all({t}, '(?i)http://')) > len(regexp_extract_all({t}, '(?i)http://(localhost|127\\.0\\.0\\.1)')))"
    ),
}
_STRUCTURAL = {
    "pyspark-001": "NOT contains({t}, '\"\"\"') AND NOT contains({t}, '''''''')",
    "python-001": (
        "regexp_matches({t}, 'def\\s+\\w+\\s*\\(') AND NOT regexp_matches({t}, 'def\\s+\\w+\\s*\\([^)]*:\\s*\\w+') "
        "AND NOT regexp_matches({t}, '\\)\\s*->\\s*\\w+')"
    ),
    "python-006": "(contains({t}, 'for ') OR contains({t}, 'while ')) AND regexp_matches({t}, '\\+\\s*[\"'']')",
    "scala-009": (
        "len(list_filter(range(1, len(string_split({t}, chr(10)))), lambda i: "
        "contains(string_split({t}, chr(10))[i], '.repartition(') AND "
        "contains(string_split({t}, chr(10))[i + 1], '.repartition('))) > 0"
    ),
    "scala-010": "len(regexp_extract_all({t}, '\\.filter\\(')) >= 3",
    "scala-013": (
        "len(regexp_extract_all({t}, '\\.join\\(')) >= 2 AND "
        "len(regexp_extract_all({t}, '\\.(count|agg|collect|show|write)\\(')) >= 2 "
        "AND NOT contains({t}, '.persist(') AND NOT contains({t}, '.cache()')"
    ),
    "scala-014": "contains({t}, '.write') AND contains({t}, '.parquet(') AND NOT contains({t}, '.partitionBy(')",
    "scala-017": "(contains({t}, '.read.json(') OR contains({t}, '.read.csv(')) AND NOT contains({t}, '.schema(')",
    "terraform-002": "contains({t}, 'provider \"') AND NOT contains({t}, 'required_providers')",
    "terraform-003": "contains({t}, 'terraform {{') AND NOT contains({t}, 'backend')",
    "terraform-005": "contains({t}, 'resource \"') AND NOT contains({t}, 'tags ')",
    "terraform-006": "contains({t}, 'aws_s3_bucket') AND NOT contains({t}, 'server_side_encryption')",
    "terraform-008": "contains({t}, 'variable \"') AND NOT contains({t}, 'description ')",
}


def text_literal(text: str) -> str:
    """A DuckDB string literal for use in a template with doubled braces."""
    return "'" + text.replace("'", "''").replace("{", "{{").replace("}", "}}") + "'"


def _pattern_test(rule: Rule, target: str) -> str:
    if rule.id in _LOOKAHEAD:
        return _LOOKAHEAD[rule.id].replace("{t}", target)
    return f"regexp_matches({target}, {text_literal(render(rule.pattern, rule.flags, java=False))})"


def rule_findings_sql() -> str:
    """One SELECT per rule over the source files."""
    parts = []
    for rule in builtin_rules():
        if rule.pattern:
            fires = _pattern_test(rule, "content")
            line = (f"nullif(list_position(list_transform(string_split(content, chr(10)), "
                    f"lambda l: {_pattern_test(rule, 'l')}), true), 0)")
        else:
            fires, line = _STRUCTURAL[rule.id].replace("{t}", "content"), "NULL"
        languages = ", ".join(f"'{name}'" for name in rule.languages)
        parts.append(
            f"SELECT run_id, file_no, path, language, {rule.ordinal} AS ordinal, '{rule.id}' AS rule_id, "
            f"'{rule.severity}' AS severity, '{rule.category}' AS category, {text_literal(rule.message)} AS message, "
            f"{text_literal(rule.suggestion)} AS suggestion, CAST({line} AS INT) AS line_number "
            f"FROM {{source_files}} WHERE language IN ({languages}) AND ({fires})"
        )
    return " UNION ALL ".join(parts)


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else text_literal(v) for v in row) + ")" for row in rows)


PRICES = f"SELECT * FROM (VALUES {_values(price_rows())}) p(ordinal, model_key, input_per_m, output_per_m)"


def priced(table: str, prices: str = "prices") -> str:
    """All columns of ``table`` and the cost of each row."""
    return f"""
SELECT m.*, coalesce(floor((input_tokens / 1e6 * p.inp + output_tokens / 1e6 * p.outp) * 1e6 + 0.5) / 1e6, 0.0) AS cost_usd
FROM {{{table}}} m LEFT JOIN (
  SELECT model, arg_min(input_per_m, pref) AS inp, arg_min(output_per_m, pref) AS outp
  FROM (SELECT d.model, input_per_m, output_per_m,
               ordinal + CASE WHEN d.model = model_key THEN 0 ELSE 1000 END AS pref
        FROM (SELECT DISTINCT model FROM {{{table}}}) d JOIN {{{prices}}} ON starts_with(d.model, model_key))
  GROUP BY model) p ON m.model = p.model"""


def summary_select(group: str = "") -> str:
    """The 18 measures, optionally per group."""
    lead = f"{group}, " if group else ""
    tail = f" GROUP BY {group}" if group else ""
    return f"""
SELECT {lead}count(*) AS total_runs,
  count(*) FILTER (status = 'success') AS success_count, count(*) FILTER (status = 'failure') AS failure_count,
  CAST(coalesce(floor(count(*) FILTER (status = 'success') / nullif(count(*), 0) * 100 + 0.5), 0) AS BIGINT) AS success_rate,
  CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens_consumed,
  CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS total_input_tokens,
  CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS total_output_tokens,
  CAST(coalesce(sum(request_count), 0) AS BIGINT) AS total_requests,
  CAST(coalesce(round(avg(latency_ms)), 0) AS DOUBLE) AS avg_latency_ms,
  CAST(coalesce(floor(sum(total_tokens) / nullif(count(*), 0) + 0.5), 0) AS BIGINT) AS avg_tokens_per_run,
  CAST(coalesce(sum(files_reviewed), 0) AS BIGINT) AS total_files_reviewed,
  CAST(coalesce(sum(issues_found), 0) AS BIGINT) AS total_issues_found,
  CAST(coalesce(sum(critical_count), 0) AS BIGINT) AS total_critical,
  CAST(coalesce(sum(high_count), 0) AS BIGINT) AS total_high,
  floor(coalesce(sum(CAST(cost_usd AS DECIMAL(18,6)))::DOUBLE, 0) * 1e6 + 0.5) / 1e6 AS total_cost_usd,
  coalesce(floor(sum(CAST(cost_usd AS DECIMAL(18,6)))::DOUBLE / nullif(count(*), 0) * 1e6 + 0.5) / 1e6, 0) AS avg_cost_per_run,
  count(DISTINCT repository) AS repositories, count(DISTINCT project_id) AS projects
FROM {{priced_metrics}}{tail}"""


COUNTS = """
SELECT record_id,
  count(*) FILTER (NOT gate AND action = 'accept') AS true_positives,
  count(*) FILTER (NOT gate AND action = 'reject') AS false_positives,
  count(*) FILTER (NOT gate AND action = 'modify') AS false_negatives,
  count(*) FILTER (gate AND action = 'accept') AS gate_accepts,
  count(*) FILTER (gate) AS gate_totals
FROM (SELECT *, coalesce(finding_type = 'gate', false) AS gate FROM {training_feedback}) f
GROUP BY record_id"""

LABELS = """
SELECT record_id, true_positives, false_positives, false_negatives,
  CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision_score,
  CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall_score,
  gate_correct,
  CASE WHEN tp + fp > 0 THEN (tp - fp) / (tp + fp) END AS rl_reward,
  CASE WHEN tp > 0 AND fp = 0 AND fn = 0 THEN 'correct' WHEN fp > 0 AND tp = 0 AND fn = 0 THEN 'false_positive'
       WHEN fn > 0 AND tp = 0 AND fp = 0 THEN 'false_negative' WHEN tp + fp + fn > 0 THEN 'partial'
       WHEN gate_correct = 1 THEN 'correct' WHEN gate_correct = 0 THEN 'false_positive' END AS supervised_label
FROM (SELECT *, true_positives AS tp, false_positives AS fp, false_negatives AS fn,
        CAST(CASE WHEN gate_totals > 0 THEN CASE WHEN gate_accepts = gate_totals THEN 1 ELSE 0 END END AS INT) AS gate_correct
      FROM {feedback_counts}) c"""

_MASK = " | ".join(f"(CASE WHEN contains(lower(message), '{k}') THEN {1 << i} ELSE 0 END)" for i, k in enumerate(KEYWORDS))

# Findings of both sides with one position per file (rule findings first) and their features.
CANDIDATES = f"""
SELECT run_id, path, is_model, ordinal, severity, category, message, suggestion, reasoning, line_number,
  coalesce(line_number, 0) AS line, {_MASK} AS keywords,
  list_distinct(regexp_split_to_array(lower(message), '\\s+')) AS words,
  row_number() OVER (PARTITION BY run_id, path ORDER BY is_model, ordinal) AS place
FROM (SELECT run_id, path, 0 AS is_model, ordinal, severity, category, message, suggestion, NULL AS reasoning, line_number
      FROM {{rule_findings}}
      UNION ALL
      SELECT run_id, path, 1, ordinal, severity, category, message, suggestion, reasoning, line_number
      FROM {{model_findings}}) u"""

# For each model finding: the earlier findings of its file that are similar.
SIMILAR = """
SELECT b.run_id, b.path, b.place, list(a.place) AS places
FROM {candidates} a JOIN {candidates} b ON a.run_id = b.run_id AND a.path = b.path AND a.place < b.place AND b.is_model = 1
WHERE (a.line <> 0 AND a.line = b.line) OR (a.keywords & b.keywords) <> 0
   OR (a.category = b.category AND
       len(list_intersect(a.words, b.words)) / greatest(len(a.words), len(b.words)) > 0.6)
GROUP BY b.run_id, b.path, b.place"""

# Greedy walk: at each place, attach to the first known similar finding or become known.
WALK = """
SELECT run_id, path, CAST(0 AS BIGINT) AS place, CAST([] AS BIGINT[]) AS known, CAST(NULL AS BIGINT) AS target
FROM (SELECT DISTINCT run_id, path FROM {candidates}) f
UNION ALL
SELECT w.run_id, w.path, c.place,
  CASE WHEN c.is_model = 0 OR len(list_intersect(w.known, coalesce(s.places, CAST([] AS BIGINT[])))) = 0
       THEN list_append(w.known, c.place) ELSE w.known END,
  CASE WHEN c.is_model = 0 THEN c.place
       ELSE coalesce(list_min(list_intersect(w.known, coalesce(s.places, CAST([] AS BIGINT[])))), c.place) END
FROM walk w JOIN {candidates} c ON c.run_id = w.run_id AND c.path = w.path AND c.place = w.place + 1
LEFT JOIN {similar_places} s ON s.run_id = c.run_id AND s.path = c.path AND s.place = c.place"""

MERGED = "WITH RECURSIVE walk AS (" + WALK + """),
placed AS (SELECT c.*, w.target FROM walk w JOIN {candidates} c ON c.run_id = w.run_id AND c.path = w.path AND c.place = w.place),
notes AS (SELECT run_id, path, target, count(*) AS attached,
    string_agg(CASE WHEN reasoning <> '' THEN concat(chr(10), chr(10), 'AI Analysis: ', reasoning) END, '' ORDER BY place) AS added,
    arg_max(reasoning, place) FILTER (reasoning <> '') AS last
  FROM placed WHERE place <> target GROUP BY run_id, path, target)
"""

REVIEW_MERGED = MERGED.replace("{candidates}", "{review_candidates}").replace("{similar_places}", "{review_similar}")

HASH = """list_reduce(
  list_prepend(CAST(0 AS BIGINT), list_transform(string_split({m}, ''), lambda c: CAST(unicode(c) AS BIGINT))),
  lambda a, x: xor((a * 32) & 4294967295, 2147483648) - 2147483648 - a + x)"""


def rule_id_sql(category: str, message: str, upper: bool = True) -> str:
    digits = f"substring(printf('%X', abs({HASH.replace('{m}', message)})), 1, 6)"
    return f"concat(upper(substring({category}, 1, 3)), '-', {digits if upper else f'lower({digits})'})"


EXTRA = {
    "rule_findings": rule_findings_sql(),
    "prices": PRICES,
    "priced_metrics": priced("run_metrics"),
    "feedback_counts": COUNTS,
    "labels_all": LABELS,
    "candidates": CANDIDATES,
    "similar_places": SIMILAR,
    # Issues of the readable answers, rebuilt from the columns the answers were made of.
    # The flagship's candidates: issues of the stored answers instead of the findings table.
    "review_candidates": CANDIDATES.replace("FROM {model_findings}", "FROM (SELECT *, (response_id << 20) + pos AS ordinal FROM {answer_issues}) a"),
    "review_similar": SIMILAR.replace("{candidates}", "{review_candidates}"),
    "answer_issues": """
SELECT run_id, path, ordinal AS response_id, 0 AS pos, severity, category, message, line_number, suggestion, reasoning
FROM {model_findings} WHERE ordinal % 11 <> 0
UNION ALL
SELECT run_id, path, ordinal, 1, 'info', 'Logic', concat('also see ', suggestion), NULL, 'none', NULL
FROM {model_findings} WHERE ordinal % 11 <> 0""",
    # The batch flow: a model finding joins the first finding of its line (or of none) and category; 50 issues a file are kept.
    "batch_issues": """
SELECT k.run_id, k.file_no, k.path, k.is_model, k.ordinal, k.severity, k.category, k.message, k.suggestion, k.line_number,
  CASE WHEN k.rn = 1 THEN coalesce(l.reasoning, k.reasoning) END AS reasoning, k.place
FROM (
  SELECT *, row_number() OVER (PARTITION BY run_id, path ORDER BY is_model, ordinal) AS place FROM (
    SELECT c.* EXCLUDE (place), f.file_no, row_number() OVER (PARTITION BY c.run_id, c.path, c.line_number, lower(c.category) ORDER BY c.is_model, c.ordinal) AS rn
    FROM {candidates} c JOIN (SELECT run_id, path, file_no FROM {source_files}) f ON f.run_id = c.run_id AND f.path = c.path) x
  WHERE rn = 1 OR is_model = 0) k
LEFT JOIN (
  SELECT run_id, path, line_number, lower(category) AS cat, arg_max(reasoning, ordinal) AS reasoning FROM (
    SELECT *, row_number() OVER (PARTITION BY run_id, path, line_number, lower(category) ORDER BY is_model, ordinal) AS rn FROM {candidates}) y
  WHERE is_model = 1 AND rn > 1 AND reasoning <> '' GROUP BY run_id, path, line_number, lower(category)) l
  ON l.run_id = k.run_id AND l.path = k.path AND l.line_number IS NOT DISTINCT FROM k.line_number AND l.cat = lower(k.category)
WHERE k.place <= 50""",
    # Scores over the kept issues.
    "scored_files": """
SELECT f.run_id, f.file_no, f.path, f.language, count(r.path) AS issues,
  count(*) FILTER (severity = 'critical') AS critical_count, count(*) FILTER (severity = 'high') AS high_count,
  count(*) FILTER (severity = 'medium') AS medium_count, count(*) FILTER (severity = 'low') AS low_count,
  count(*) FILTER (severity = 'info') AS info_count,
  CAST(greatest(0, 100 - coalesce(sum(CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 10
       WHEN 'low' THEN 5 WHEN 'info' THEN 2 ELSE 0 END), 0)) AS BIGINT) AS score
FROM {source_files} f LEFT JOIN {batch_issues} r ON f.run_id = r.run_id AND f.path = r.path
GROUP BY f.run_id, f.file_no, f.path, f.language""",
    "both_findings": """
SELECT run_id, path, 0 AS is_model, rule_id, ordinal, severity, category, message, suggestion, line_number FROM {rule_findings}
UNION ALL
SELECT run_id, path, 1, 'model', ordinal, severity, category, message, suggestion, line_number FROM {model_findings}""",
    "batch_totals": """
SELECT *, average_score >= 70 AND critical_count = 0 AS pass_threshold
FROM (SELECT run_id, count(*) AS total_files, count(*) FILTER (issues > 0) AS files_with_issues,
        CAST(sum(issues) AS BIGINT) AS total_issues, CAST(sum(critical_count) AS BIGINT) AS critical_count,
        CAST(sum(high_count) AS BIGINT) AS high_count, CAST(sum(medium_count) AS BIGINT) AS medium_count,
        CAST(sum(low_count) AS BIGINT) AS low_count, CAST(sum(info_count) AS BIGINT) AS info_count,
        CAST(floor(sum(score) / count(*) + 0.5) AS BIGINT) AS average_score
      FROM {scored_files} GROUP BY run_id) t""",
    # Category scores over the rule findings.
    "category_raw": """
SELECT f.path, f.language, coalesce(r.issues, 0) AS issues, coalesce(r.crit, 0) AS critical_count, coalesce(r.high, 0) AS high_count,
  contains(content, '.cache()') OR contains(content, '.persist()') AS s1,
  contains(content, 'broadcast(') OR contains(content, 'broadcast ') AS s2,
  contains(content, 'try') OR contains(content, 'Try {{') AS s3,
  contains(content, 'coalesce(') OR contains(content, 'repartition(') AS s4,
  contains(content, 'StructType') OR contains(content, 'schema =') AS s5,
  NOT contains(content, '.cache()') AND len(regexp_extract_all(content, 'df\\.')) > 5 AS a2,
  contains(content, 'join') AND NOT contains(content, 'broadcast') AS a3,
  NOT contains(content, 'partitionBy') AND contains(content, '.write') AS a4,
  100 - coalesce(r.lp, 0) + CASE WHEN s1 THEN 5 ELSE 0 END + CASE WHEN s2 THEN 5 ELSE 0 END
    + CASE WHEN s4 THEN 3 ELSE 0 END + CASE WHEN s5 THEN 5 ELSE 0 END AS p,
  100 - coalesce(r.ls, 0) AS s, 100 - coalesce(r.lq, 0) + CASE WHEN s3 THEN 5 ELSE 0 END AS q,
  100 - coalesce(r.lm, 0) AS m,
  CAST(floor(p * 0.35::DOUBLE + s * 0.25::DOUBLE + q * 0.2::DOUBLE + m * 0.2::DOUBLE + 0.5) AS BIGINT) AS overall
FROM {source_files} f LEFT JOIN (
  SELECT path, count(*) AS issues, count(*) FILTER (severity = 'critical') AS crit, count(*) FILTER (severity = 'high') AS high,
    sum(d) FILTER (category = 'performance') AS lp, sum(d) FILTER (category = 'security') AS ls,
    sum(d) FILTER (category IN ('code-structure', 'best-practice', 'logging')) AS lq,
    sum(d) FILTER (category IN ('maintainability', 'data-quality', 'exception-handling')) AS lm
  FROM (SELECT *, CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 10 WHEN 'low' THEN 5 ELSE 2 END AS d
        FROM {rule_findings}) x GROUP BY path) r ON f.path = r.path""",
}


def oracle(body: str) -> str:
    return with_views(body, EXTRA)
