"""Filters and list views over runs and files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.functions.severity import editor_level, severity_rank
from reviewlake.operators.skew import first_rows

# Default page sizes, skip patterns, reviewable extensions and visible severities.
METRIC_PAGE = 100
RUN_PAGE = 50
DEFAULT_SKIP_GLOBS = (
    "node_modules/**", "**/*.min.js", "**/dist/**", "**/build/**", "**/*.lock", "**/package-lock.json",
)
REVIEW_EXTENSIONS = ("py", "scala", "sql", "tf")
MAX_FILES = 20
VISIBLE_SEVERITIES = ("critical", "high", "medium", "low")


def matching(df: DataFrame, equal: dict[str, str | None], ts: str, ts_from=None, ts_to=None) -> DataFrame:
    """Equality filters that are set, and an inclusive time range; all reach the scan."""
    for column, value in equal.items():
        if value:
            df = df.where(F.col(column) == value)
    kind = df.schema[ts].dataType.simpleString()
    if ts_from:
        df = df.where(F.col(ts) >= F.lit(ts_from).cast(kind))
    if ts_to:
        df = df.where(F.col(ts) <= F.lit(ts_to).cast(kind))
    return df


def page(df: DataFrame, ts: str, tie: str, limit: int, offset: int) -> DataFrame:
    """Newest first; the tie-break makes the page deterministic."""
    return df.orderBy(F.desc(ts), F.desc(tie)).offset(offset).limit(limit)


def days_between(df: DataFrame, ts_from=None, ts_to=None, day: str = "day") -> DataFrame:
    """Partition filter for a time range over a table with a folder per day; other tables stay as they are."""
    if day not in df.columns:
        return df
    for bound, keep in ((ts_from, lambda d: F.col(day) >= d), (ts_to, lambda d: F.col(day) <= d)):
        if bound:
            df = df.where(keep(F.to_date(F.lit(bound).cast("timestamp_ntz"))))
    return df


def newest_days(found: DataFrame, table: DataFrame, rows: int, day: str = "day") -> DataFrame:
    """Those of the ``found`` rows on the newest days of ``table`` that hold at least ``rows`` of them.

    Days are tried in doubling numbers, so a page in front reads a day or two, and no try reads more than twice what it needs.
    """
    if day not in table.columns:
        return found
    # Folder names, without any data column.
    days = [r[0] for r in table.select(day).where(F.col(day).isNotNull()).distinct().orderBy(F.desc(day)).collect()]
    tried = 1
    while tried < len(days):
        newest = found.where(F.col(day) >= F.lit(days[tried - 1]))
        if newest.limit(rows).count() == rows:
            return newest
        tried *= 2
    return found


def filter_metrics(df: DataFrame, *, repository=None, project_id=None, status=None, source=None,
                   ts_from=None, ts_to=None, limit: int = METRIC_PAGE, offset: int = 0) -> DataFrame:
    """One page of metric rows; a limit of 0 means the default."""
    equal = {"repository": repository, "project_id": project_id, "status": status, "source": source}
    days = days_between(df, ts_from, ts_to)
    found = matching(days, equal, "ts", ts_from, ts_to)
    limit = limit or METRIC_PAGE
    return page(newest_days(found, days, offset + limit), "ts", "id", limit, offset)


def filter_runs(df: DataFrame, *, repository=None, project_id=None, status=None, source=None, workflow_run_id=None,
                gate_status=None, ts_from=None, ts_to=None, limit: int = RUN_PAGE, offset: int = 0) -> DataFrame:
    """One page of run rows; a limit of 0 means the default."""
    equal = {"repository": repository, "project_id": project_id, "status": status,
             "workflow_run_id": workflow_run_id, "gate_status": gate_status, "source": source}
    days = days_between(df, ts_from, ts_to)
    found = matching(days, equal, "ts", ts_from, ts_to)
    limit = limit or RUN_PAGE
    return page(newest_days(found, days, offset + limit), "ts", "run_id", limit, offset)


def run_lookup(df: DataFrame, run_id: str) -> DataFrame:
    return df.where(F.col("run_id") == run_id)


def run_list(df: DataFrame) -> DataFrame:
    """Light list: the nested columns are replaced by their sizes."""
    counts = {
        "validation_failure_count": F.size(F.coalesce("validation_failures", F.array())),
        "llm_finding_count": F.size(F.coalesce("llm_findings", F.array())),
    }
    nested = ("validation_failures", "llm_findings", "per_file_results")
    kept = [F.col(c) for c in df.columns if c not in nested]
    return df.select(*kept, *[e.alias(n) for n, e in counts.items()])


def _any_of(patterns: list[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


def skip_paths(files: DataFrame, patterns: list[str]) -> DataFrame:
    """Drop matching paths; ``*`` means anything, dots are not escaped, the match is unanchored."""
    if not patterns:
        return files
    return files.where(~F.col("path").rlike(_any_of([p.replace("*", ".*") for p in patterns])))


def glob_regex(pattern: str) -> str:
    """The command line rewriting, in its order: the star of ``.*`` is rewritten once more."""
    return re.sub(r"\*", "[^/]*", pattern.replace(".", r"\.").replace("**", ".*"))


def skip_globs(files: DataFrame, patterns: tuple[str, ...] | list[str] = DEFAULT_SKIP_GLOBS) -> DataFrame:
    if not patterns:
        return files
    return files.where(~F.col("path").rlike(_any_of([glob_regex(p) for p in patterns])))


def select_files(files: DataFrame, extensions=REVIEW_EXTENSIONS, max_files: int = MAX_FILES) -> DataFrame:
    """Files with a reviewable extension, at most ``max_files`` per run in file order."""
    wanted = files.where(F.col("path").rlike(r"\.(" + "|".join(extensions) + r")$"))
    return first_rows(wanted, ["run_id"], [F.col("file_no"), F.col("path")], max_files)


def severity_filter(findings: DataFrame, keep=VISIBLE_SEVERITIES, line_count: Column | None = None) -> DataFrame:
    """Editor view: visible severities, their level, and the zero-based line clamped to the text."""
    line = F.greatest(F.lit(0), F.coalesce("line_number", F.lit(1)) - 1)
    if line_count is not None:
        line = F.least(line, line_count - 1)
    return findings.where(F.col("severity").isin(*keep)).withColumns({
        "level": editor_level(F.col("severity")),
        "editor_line": line,
        "title": F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "message"),
    })


def issues_sorted(findings: DataFrame, severity: str | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Issues per file from critical to info, the original order kept within a severity.

    A global sort on (file, rank, ordinal): range partitioned, so a large file spans partitions.
    """
    shown = findings.where(F.col("severity") == severity) if severity else findings
    ranked = shown.withColumn("severity_rank", severity_rank(F.col("severity")))
    return ranked.orderBy(*keys, "severity_rank", "ordinal")


def top_issues(findings: DataFrame, keys: tuple[str, ...] = ("run_id",), k: int = 5) -> DataFrame:
    """The first ``k`` critical or high issues per run, in file order."""
    order = [F.col("file_no"), F.col("path"), F.col("ordinal")]
    urgent = first_rows(findings.where(F.col("severity").isin("critical", "high")), list(keys), order, k)
    # At most k rows per run are left.
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return urgent.withColumn("place", place)
