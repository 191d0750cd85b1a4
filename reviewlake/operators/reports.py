"""Reports per run: Markdown, SARIF and a pull request comment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.functions.rule_ids import finding_rule_id
from reviewlake.functions.severity import icon, sarif_level
from reviewlake.operators.skew import CHUNK, first_rows, nested

# SARIF format.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"
SARIF_VERSION = "2.1.0"
TOOL = "reviewlake"
TOOL_VERSION = "1.0.0"


def _present(value: Column) -> Column:
    return F.coalesce(value, F.lit("")) != ""


def _text(value: Column) -> Column:
    return value.cast("string")


def report_markdown(summary: DataFrame, files: DataFrame, findings: DataFrame, strengths: DataFrame | None = None) -> DataFrame:
    """Markdown report as ordered lines: (run_id, section, file_no, block, item, line_no, line).

    The report of a run is its lines in that order.  Lines are rows, so a run with any number of
    files is written in parallel and never assembled in one place.

    ``summary``: batch summary per run with ``ts`` and ``duration_ms``; ``files``: file scores with
    ``file_no``; ``findings`` with ``file_no`` and ``ordinal``; ``strengths``: run_id, file_no, pos, note.
    """

    def block(df: DataFrame, section: int, part: int, item: Column, lines: list[Column], keep: bool = True) -> DataFrame:
        rows = F.array_compact(F.array(*lines)) if keep else F.array(*lines)
        place = [
            "run_id", F.lit(section).alias("section"),
            (F.col("file_no") if section == 1 else F.lit(-1)).cast("long").alias("file_no"),
            F.lit(part).alias("block"), item.cast("long").alias("item"),
        ]
        return df.select(*place, F.posexplode(rows).alias("line_no", "line"))

    def lit(text: str) -> Column:
        return F.lit(text)

    def row(name: str, value: Column) -> Column:
        return F.concat(lit(f"| {name} | "), value, lit(" |"))

    zero = F.lit(0)
    head = block(summary, 0, 0, zero, [
        lit("# Code Review Report"), lit(""),
        F.concat(lit("**Generated:** "), _text(F.col("ts"))),
        F.concat(lit("**Duration:** "), _text(F.col("duration_ms")), lit("ms")), lit(""),
        lit("## Summary"), lit(""), lit("| Metric | Value |"), lit("|--------|-------|"),
        row("Files Analyzed", _text(F.col("total_files"))),
        row("Files with Issues", _text(F.col("files_with_issues"))),
        row("Total Issues", _text(F.col("total_issues"))),
        row("Critical", _text(F.col("critical_count"))), row("High", _text(F.col("high_count"))),
        row("Medium", _text(F.col("medium_count"))), row("Low", _text(F.col("low_count"))),
        row("Average Score", F.concat(_text(F.col("average_score")), lit("/100"))),
        row("Status", F.when(F.col("pass_threshold"), "✅ PASS").otherwise("❌ FAIL")), lit(""),
        lit("## File Results"), lit(""),
    ])
    title = block(files, 1, 0, zero, [
        F.concat(lit("### "), "path"), lit(""),
        F.concat(lit("**Language:** "), "language", lit(" | **Score:** "), _text(F.col("score")),
                 lit("/100 | **Issues:** "), _text(F.col("issues"))), lit(""),
    ])
    with_issues = files.where(F.col("issues") > 0)
    issue_head = block(with_issues, 1, 1, zero, [lit("#### Issues"), lit("")])
    issues = block(findings, 1, 2, F.col("ordinal"), [
        F.concat(lit("- "), icon(F.col("severity")), lit(" **"), F.upper("severity"), lit("** ("), "category", lit("): "), "message"),
        F.when(F.coalesce("line_number", zero) != 0, F.concat(lit("  - Line: "), _text(F.col("line_number")))),
        F.when(_present(F.col("suggestion")), F.concat(lit("  - Fix: "), "suggestion")),
    ])
    parts = [head, title, issue_head, issues, block(with_issues, 1, 3, zero, [lit("")])]
    if strengths is not None:
        named = strengths.select("run_id", "file_no").distinct()
        parts += [
            block(named, 1, 4, zero, [lit("#### Strengths"), lit("")]),
            block(strengths, 1, 5, F.col("pos"), [F.concat(lit("- ✅ "), "note")]),
            block(named, 1, 6, zero, [lit("")]),
        ]
    parts.append(block(summary, 2, 0, zero, [lit("---"), lit(f"*Generated by {TOOL}*")]))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def report_markdown_cli(summary: DataFrame, files: DataFrame, findings: DataFrame) -> DataFrame:
    """Command line variant: shorter table, files without issues left out."""

    def place(df: DataFrame, section: int, part: int, item: Column, lines: list[Column]) -> DataFrame:
        return df.select(
            "run_id", F.lit(section).alias("section"),
            (F.col("file_no") if section == 1 else F.lit(-1)).cast("long").alias("file_no"),
            F.lit(part).alias("block"), item.cast("long").alias("item"),
            F.posexplode(F.array_compact(F.array(*lines))).alias("line_no", "line"),
        )

    lit, zero = F.lit, F.lit(0)

    def row(name: str, column: str) -> Column:
        return F.concat(lit(f"| {name} | "), _text(F.col(column)), lit(" |"))

    with_issues = files.where(F.col("issues") > 0)
    short_icon = F.when(F.col("severity").isin("critical", "high", "medium"), icon(F.col("severity"))).otherwise("🔵")
    head = place(summary, 0, 0, zero, [
        lit("# Code Review Report"), lit(""),
        F.concat(lit("**Status:** "), F.when(F.col("pass_threshold"), "✅ PASSED").otherwise("❌ FAILED")), lit(""),
        F.concat(lit("**Average Score:** "), _text(F.col("average_score")), lit("/100")), lit(""),
        lit("## Summary"), lit(""), lit("| Metric | Value |"), lit("|--------|-------|"),
        row("Files Analyzed", "total_files"), row("Total Issues", "total_issues"), row("Critical", "critical_count"),
        row("High", "high_count"), lit(""), lit(""), lit("## File Results"), lit(""),
    ])
    title = place(with_issues, 1, 0, zero, [
        F.concat(lit("### "), "path"), lit(""),
        F.concat(lit("**Score:** "), _text(F.col("score")), lit("/100 | **Issues:** "), _text(F.col("issues"))), lit(""),
    ])
    issues = place(findings, 1, 2, F.col("ordinal"), [
        F.concat(lit("- "), short_icon, lit(" **"), F.upper("severity"), lit("**: "), "message"),
        F.when(F.coalesce("line_number", zero) != 0, F.concat(lit("  - Line: "), _text(F.col("line_number")))),
        F.when(_present(F.col("suggestion")), F.concat(lit("  - Fix: "), "suggestion")),
    ])
    end = place(with_issues, 1, 3, zero, [lit("")])
    return head.unionByName(title).unionByName(issues).unionByName(end)


def sarif_results(findings: DataFrame, cli: bool = False) -> DataFrame:
    """Findings as SARIF results; ``region`` is NULL when there is no line."""
    given = F.col("rule_id") if "rule_id" in findings.columns and not cli else F.lit(None).cast("string")
    rule = F.coalesce(given, finding_rule_id(F.col("category"), F.col("message"), upper=not cli))
    note = F.when(_present(F.col("suggestion")), F.concat(F.lit("\n\nSuggestion: "), "suggestion")).otherwise("")
    region = F.when(F.coalesce("line_number", F.lit(0)) != 0, F.struct(F.col("line_number").alias("startLine")))
    location = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region"))
                        .alias("physicalLocation"))
    # The id hashes every character, so it is computed once, below everything that uses it.
    findings = findings.withColumn("rule_id", rule)
    rule = F.col("rule_id")
    return findings.select(
        "run_id", "file_no", "path", "ordinal", rule.alias("rule_id"), "category", "message", "reasoning",
        sarif_level(F.col("severity"), cli).alias("level"),
        F.struct(
            rule.alias("ruleId"), sarif_level(F.col("severity"), cli).alias("level"),
            F.struct(F.concat("message", F.lit("") if cli else note).alias("text")).alias("message"),
            F.array(location).alias("locations"),
        ).alias("result"),
    )


def comment_results(findings: DataFrame) -> DataFrame:
    """What a comment needs of the SARIF results of ``findings``, as :func:`read_sarif_results` gives it, without writing JSON."""
    spot = F.get("result.locations", F.lit(0))["physicalLocation"]
    return sarif_results(findings).select(
        "run_id", F.struct("file_no", "path", "ordinal").alias("pos"), "level", F.lit(None).cast("string").alias("severity"),
        F.coalesce(spot["artifactLocation"]["uri"], F.lit("unknown")).alias("file"), spot["region"]["startLine"].alias("line"),
        F.col("result.message.text").alias("text"))


def sarif_rules(results: DataFrame, cli: bool = False) -> DataFrame:
    """Rule table per run: the first finding of each rule id describes it."""
    place = F.struct("file_no", "path", "ordinal")
    first = results.groupBy("run_id", "rule_id").agg(
        F.min(place).alias("place"), F.min_by(F.struct("category", "message", "reasoning", "level"), place).alias("f")
    )
    full = F.when(F.lit(not cli) & _present(F.col("f.reasoning")), F.struct(F.col("f.reasoning").alias("text")))
    return first.select("run_id", "rule_id", "place", F.struct(
        F.col("rule_id").alias("id"), F.col("f.category").alias("name"),
        F.struct(F.substring("f.message", 1, 100).alias("text")).alias("shortDescription"),
        full.alias("fullDescription"),
        F.struct(F.col("f.level").alias("level")).alias("defaultConfiguration"),
    ).alias("rule"))


def report_sarif(findings: DataFrame, cli: bool = False, chunk: int = CHUNK) -> DataFrame:
    """SARIF documents: (run_id, part, parts, report).

    A run with up to ``chunk`` results is one document.  A larger run is several documents, each
    with the rules its own results use, as code scanning tools accept them.
    """
    results = sarif_results(findings, cli)
    place = F.struct("file_no", "path", "ordinal", "rule_id", "result")
    docs = nested(results, ["run_id"], place, "items", ["file_no", "path", "ordinal"], chunk)
    rules = sarif_rules(results, cli)
    # Which document uses which rule: from the documents themselves, so both agree.
    used = docs.select("run_id", "part", F.explode(F.array_distinct(F.transform("items", lambda i: i["rule_id"]))).alias("rule_id"))
    tables = used.join(rules, ["run_id", "rule_id"]).groupBy("run_id", "part").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("place", "rule_id", "rule"))), lambda r: r["rule"]).alias("rules")
    )
    driver = F.struct(F.lit(TOOL).alias("name"), F.lit(TOOL_VERSION).alias("version"), "rules")
    run = F.struct(F.struct(driver.alias("driver")).alias("tool"),
                   F.transform("items", lambda i: i["result"]).alias("results"))
    document = F.struct(F.lit(SARIF_SCHEMA).alias("$schema"), F.lit(SARIF_VERSION).alias("version"), F.array(run).alias("runs"))
    return docs.join(tables, ["run_id", "part"]).select("run_id", "part", "parts", F.to_json(document).alias("report"))


_SARIF_READ = (
    "runs array<struct<results:array<struct<level:string, properties:struct<severity:string>, message:struct<text:string>, "
    "locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>, region:struct<startLine:int>>>>>>>>"
)


def read_sarif_results(reports: DataFrame) -> DataFrame:
    """Results of the first run of each SARIF document, in order."""
    keys = [c for c in reports.columns if c != "report"]
    parsed = reports.select(*keys, F.from_json("report", _SARIF_READ).alias("doc"))
    result = F.get("doc.runs", F.lit(0))["results"]
    spot = F.get("r.locations", F.lit(0))["physicalLocation"]
    return parsed.select(*keys, F.posexplode(result).alias("pos", "r")).select(
        *keys, "pos", F.col("r.level").alias("level"), F.col("r.properties.severity").alias("severity"),
        F.coalesce(spot["artifactLocation"]["uri"], F.lit("unknown")).alias("file"),
        spot["region"]["startLine"].alias("line"), F.col("r.message.text").alias("text"),
    )


def sarif_level_counts(results: DataFrame, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Critical, high, medium and low counts from SARIF levels and properties."""
    error = F.col("level") == "error"
    counted = results.groupBy(*by).agg(
        F.count("*").alias("total"),
        F.count_if(error & (F.col("severity") == "critical")).alias("critical"),
        F.count_if(error).alias("errors"),
        F.count_if(F.col("level") == "warning").alias("medium"),
        F.count_if(F.col("level") == "note").alias("low"),
    )
    return counted.withColumn("high", F.col("errors") - F.col("critical")).drop("errors")


def report_pr_comment(results: DataFrame, scores: DataFrame, top: int = 10) -> DataFrame:
    """Comment per run from SARIF results: score line, counts and the first ``top`` results.

    ``results`` is the output of :func:`comment_results` or :func:`read_sarif_results`; ``scores`` has run_id, overall_score,
    pass_threshold and optionally the four category scores.
    """
    order = [F.col(c) for c in ("part", "pos") if c in results.columns]
    shown = first_rows(results, ["run_id"], order, top)
    mark = F.when(F.col("level") == "error", "🔴").when(F.col("level") == "warning", "🟠").otherwise("🟡")
    line = F.when(F.coalesce("line", F.lit(0)) != 0, _text(F.col("line"))).otherwise("?")
    cell = F.concat(F.lit("| "), mark, F.lit(" | `"), "file", F.lit(":"), line, F.lit("` | "),
                    F.coalesce(F.substring("text", 1, 80), F.lit("")), F.lit(" |"))
    place = F.struct(*[c for c in ("part", "pos") if c in results.columns], cell.alias("cell"))
    rows = shown.groupBy("run_id").agg(F.transform(F.array_sort(F.collect_list(place)), lambda r: r["cell"]).alias("rows"))
    joined = scores.join(sarif_level_counts(results), "run_id", "left").join(rows, "run_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("total", "critical", "high", "medium", "low")}
    )
    passed = F.coalesce("pass_threshold", F.lit(True))
    names = (("security", "Security"), ("performance", "Performance"), ("code_quality", "Code Quality"),
             ("maintainability", "Maintainability"))
    have = [(c, n) for c, n in names if c in scores.columns]
    table: list[Column] = []
    if have:
        table = [F.lit("| Category | Score |"), F.lit("|----------|-------|"),
                 *[F.concat(F.lit(f"| {n} | "), _text(F.col(c)), F.lit(" |")) for c, n in have], F.lit("")]
    head = F.array(
        F.lit("## AI Code Review Results"), F.lit(""),
        F.concat(F.lit("**Overall Score: "), F.coalesce(_text(F.col("overall_score")), F.lit("N/A")), F.lit("/100** "),
                 F.when(passed, "✅ Passed").otherwise("❌ Failed")),
        F.lit(""), *table,
        F.concat(F.lit("**Issues Found:** "), _text(F.col("total")), F.lit(" total ("), _text(F.col("critical")),
                 F.lit(" critical, "), _text(F.col("high")), F.lit(" high, "), _text(F.col("medium")),
                 F.lit(" medium, "), _text(F.col("low")), F.lit(" low)")),
        F.lit(""),
    )
    none = F.array().cast("array<string>")
    issues = F.when(F.col("total") > 0, F.concat(
        F.array(F.lit("### Issues"), F.lit("| Severity | Location | Description |"), F.lit("|----------|----------|-------------|")),
        F.coalesce("rows", none),
    )).otherwise(none)
    more = F.when(F.col("total") > top, F.array(F.lit(""), F.concat(
        F.lit("_..."), _text(F.col("total") - top), F.lit(" more. See the Security tab for full details._")))).otherwise(none)
    blocked = F.when(~passed, F.array(F.lit(""), F.lit(
        "> **Build blocked:** Code quality below required threshold. Fix the issues above before merging."))).otherwise(none)
    return joined.select("run_id", F.array_join(F.concat(head, issues, more, blocked), "\n").alias("comment"))
