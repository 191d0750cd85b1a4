"""Parse stored model answers: free text that should hold one JSON object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.rule_ids import finding_rule_id

# Numbers arrive as text and are cast afterwards: one odd value must not lose the whole answer.
ISSUE = (
    "severity string, category string, message string, lineNumber string, suggestion string, reasoning string"
)
REVIEW_SCHEMA = (
    f"issues array<struct<{ISSUE.replace(' string', ':string')}>>, strengths array<string>, "
    "recommendations array<string>, refactoredCode string, _bad string"
)
BATCH_SCHEMA = (
    f"files array<struct<path:string, issues:array<struct<{ISSUE.replace(' string', ':string')}>>, "
    "strengths:array<string>, recommendations:array<string>, score:string>>, "
    "crossFileIssues array<struct<severity:string, category:string, message:string, suggestion:string, "
    "affectedFiles:array<string>>>, overallRecommendations array<string>, _bad string"
)
_STRICT = {
    "columnNameOfCorruptRecord": "_bad", "allowSingleQuotes": "false", "allowNonNumericNumbers": "false",
}
_RELAXED = {**_STRICT, "allowUnquotedControlChars": "true"}

# What is recommended when an answer cannot be read.
UNREADABLE_REVIEW = "AI analysis returned non-standard format. Please try again."
UNREADABLE_BATCH = "AI analysis returned non-standard format"
DEFAULT_SCORE = 70

_FENCE = "```"
_SPACE = " \t\n\x0b\f\r"
_TRAILING_COMMA = r",\s*([\]}])"
_REFACTORED = r'(?s),?\s*"refactoredCode"\s*:\s*".*?"(?=\s*[,}])'


def _named(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def json_text(text: Column) -> Column:
    """The first fenced block if there is one, cut to the outermost braces.  By positions: no pattern is searched."""
    start = F.instr(text, _FENCE)
    end = F.call_function("locate", F.lit(_FENCE), text, start + 3)

    def block(inner: Column) -> Column:
        return F.btrim(F.when(inner.startswith("json"), F.substring(inner, F.lit(5), F.length(inner))).otherwise(inner), F.lit(_SPACE))

    def cut(body: Column) -> Column:
        first = F.instr(body, "{")
        last = F.length(body) - F.length(F.substring_index(body, "}", -1))
        return F.when((first > 0) & (last > first), F.substring(body, first, last - first + 1)).otherwise(F.trim(body))

    fenced = _named(F.substring(text, start + 3, end - start - 3), block)
    return _named(F.when((start > 0) & (end > 0), fenced).otherwise(text), cut)


def _parse(df: DataFrame, schema: str, strip_code: bool) -> DataFrame:
    """Add ``doc``: the answer as a struct, after up to two repairs; NULL when unreadable.

    ``coalesce`` stops at the first readable attempt, so a repair only runs on rows that need it.
    Each attempt is named once (the test is a filter over a one-element array), which keeps the
    expression small when the optimizer moves it.
    """

    def attempt(text: Column, options: dict) -> Column:
        parsed = F.array(F.from_json(text, schema, options))
        return F.get(F.filter(parsed, lambda doc: doc.isNotNull() & doc["_bad"].isNull()), F.lit(0))

    text = F.col("_json")
    repaired = F.regexp_replace(text, _TRAILING_COMMA, "$1")
    attempts = [attempt(text, _STRICT), attempt(repaired, _RELAXED)]
    if strip_code:
        attempts.append(attempt(F.regexp_replace(repaired, _REFACTORED, ""), _RELAXED))
    return df.withColumn("_json", json_text(F.col("response_text"))).withColumn("doc", F.coalesce(*attempts)).drop("_json")


def _exploded(df: DataFrame, column: str, position: str, item: str, keep: list) -> DataFrame:
    """One row per array element.

    The outer form plus a test of the position: the inner form makes the optimizer infer a
    "not empty" filter that would parse every answer a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(column).alias(position, item))
    return rows.where(F.col(position).isNotNull())


def _issue_columns(issue: str) -> list[Column]:
    field = lambda name: F.col(f"{issue}.{name}")
    return [
        field("severity").alias("severity"),
        field("category").alias("category"),
        field("message").alias("message"),
        F.expr(f"try_cast({issue}.lineNumber AS int)").alias("line_number"),
        field("suggestion").alias("suggestion"),
        field("reasoning").alias("reasoning"),
    ]


def parse_findings(responses: DataFrame, keys: tuple[str, ...] = ("path", "response_id")) -> DataFrame:
    """Issues of each answer, in order (``pos`` from 0).  Unreadable answers give no rows."""
    parsed = _parse(responses, REVIEW_SCHEMA, strip_code=False)
    return _exploded(parsed, "doc.issues", "pos", "issue", list(keys)).select(
        *keys, "pos", *_issue_columns("issue")
    )


def parse_review(responses: DataFrame, keys: tuple[str, ...] = ("path", "response_id")) -> DataFrame:
    """One row per answer: issues, strengths, recommendations and refactored code, with fallbacks."""
    parsed = _parse(responses, REVIEW_SCHEMA, strip_code=True)
    none = F.array().cast("array<string>")
    return parsed.select(
        *keys,
        F.col("doc").isNotNull().alias("readable"),
        F.coalesce("doc.issues", F.array().cast(parsed.schema["doc"].dataType["issues"].dataType)).alias("issues"),
        F.coalesce("doc.strengths", none).alias("strengths"),
        F.when(F.col("doc").isNull(), F.array(F.lit(UNREADABLE_REVIEW)))
        .otherwise(F.coalesce("doc.recommendations", none)).alias("recommendations"),
        F.nullif("doc.refactoredCode", F.lit("")).alias("refactored_code"),
    )


def parse_batch_response(responses: DataFrame, keys: tuple[str, ...] = ("run_id", "response_id")) -> dict[str, DataFrame]:
    """Batch answers as three tables: ``files``, ``issues`` and ``cross_file`` (plus advice in ``notes``)."""
    parsed = _parse(responses, BATCH_SCHEMA, strip_code=False)
    files = _exploded(parsed, "doc.files", "file_pos", "file", list(keys))
    score = F.expr("try_cast(file.score AS double)")
    none = F.array().cast("array<string>")
    kept = [*keys, "file_pos", F.col("file.path").alias("path")]
    issues = _exploded(files, "file.issues", "pos", "issue", kept).select(*keys, "file_pos", "path", "pos", *_issue_columns("issue"))
    cross = _exploded(parsed, "doc.crossFileIssues", "pos", "issue", list(keys)).select(
        *keys, "pos", "issue.severity", "issue.category", "issue.message", "issue.suggestion", "issue.affectedFiles"
    )

    def tagged(df: DataFrame, default: str) -> DataFrame:
        category = F.when(F.coalesce("category", F.lit("")) != "", F.col("category")).otherwise(default)
        return df.withColumn("source", F.lit("ai")).withColumn("rule_id", finding_rule_id(category, F.col("message")))

    return {
        "files": files.select(
            *keys, "file_pos", F.col("file.path").alias("path"),
            F.coalesce("file.strengths", none).alias("strengths"),
            F.coalesce("file.recommendations", none).alias("recommendations"),
            F.when(score != 0, score).otherwise(float(DEFAULT_SCORE)).alias("score"),
        ),
        "issues": tagged(issues, "GEN"),
        "cross_file": tagged(cross, "ARCH"),
        "notes": parsed.select(
            *keys,
            F.when(F.col("doc").isNull(), F.array(F.lit(UNREADABLE_BATCH)))
            .otherwise(F.coalesce("doc.overallRecommendations", none)).alias("overall_recommendations"),
        ),
    }
