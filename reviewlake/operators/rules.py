"""Rule scan: which catalog rules fire in which file, and on which line."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.functions.regex import render, required_literals
from reviewlake.session import scratch_path
from reviewlake.sources.rule_catalog import Rule, builtin_rules, scan_rule_catalog

# A cheap necessary condition for a pattern without a literal part: every match holds three digits, a bare date, a quoted slash or a drive.
NECESSARY = {
    r"[^a-zA-Z_]\d{3,}[^a-zA-Z_]": r"rlike(content, '\\d\\d\\d')",
    r"\b\d{4}-\d{2}-\d{2}\b": r"rlike(content, '\\d{4}-\\d{2}-\\d{2}')",
    r"""["']\/[a-zA-Z0-9_\/-]+["']|["'][A-Z]:\\[^"']+["']""": r"""(contains(content, '"/') OR contains(content, '\'/') OR contains(content, ':\\'))""",
}

FINDING_COLUMNS = ["ordinal", "rule_id", "severity", "category", "message", "suggestion", "line_number"]


# The structural rules.  Predicates over ``content``, instead of one pattern.
_S = r"[\s\x{a0}\x{feff}]"


def structural_predicates() -> dict[str, str]:
    """SQL predicate over ``content`` per structural rule."""

    def has(*parts: str) -> str:
        return " AND ".join(f"contains(content, {quoted(p)})" for p in parts)

    def lacks(*parts: str) -> str:
        return " AND ".join(f"NOT contains(content, {quoted(p)})" for p in parts)

    def either(*conditions: str) -> str:
        return "(" + " OR ".join(conditions) + ")"

    def matches(pattern: str) -> str:
        return f"rlike(content, {quoted(pattern)})"

    def at_least(n: int, pattern: str) -> str:
        return f"regexp_count(content, {quoted(pattern)}) >= {n}"

    def every(*conditions: str) -> str:
        return " AND ".join(conditions)

    hints = either(matches(rf"def{_S}+\w+{_S}*\([^)]*:{_S}*\w+"), matches(rf"\){_S}*->{_S}*\w+"))
    return {
        "pyspark-001": lacks('"""', "'''"),
        "python-001": every(has("def"), matches(rf"def{_S}+\w+{_S}*\("), f"NOT {hints}"),
        "python-006": every(either(has("for "), has("while ")), matches(rf"""\+{_S}*["']""")),
        "scala-009": every(has(".repartition("), matches(r"\.repartition\([^\n]*\n[^\n]*\.repartition\(")),
        "scala-010": every(has(".filter("), at_least(3, r"\.filter\(")),
        "scala-013": every(
            has(".join("), at_least(2, r"\.join\("), at_least(2, r"\.(count|agg|collect|show|write)\("),
            lacks(".persist(", ".cache()"),
        ),
        "scala-014": every(has(".write", ".parquet("), lacks(".partitionBy(")),
        "scala-017": every(either(has(".read.json("), has(".read.csv(")), lacks(".schema(")),
        "terraform-002": every(has('provider "'), lacks("required_providers")),
        "terraform-003": every(has("terraform {"), lacks("backend")),
        "terraform-005": every(has('resource "'), lacks("tags ")),
        "terraform-006": every(has("aws_s3_bucket"), lacks("server_side_encryption")),
        "terraform-008": every(has('variable "'), lacks("description ")),
    }


def quoted(text: str) -> str:
    """A Spark SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def first_match_line(pattern: str, flags: str = "") -> str:
    """SQL for the 1-based number of the first single line of ``content`` that matches.

    NULL when only a multi-line match exists.  The line feeds before the first match that contains none give the
    line: the lambda only names that part, so that the text is searched once.  (``split`` would compile the
    pattern again for each row.)  An empty part means a match at the start, or none.
    """
    confined = render(pattern, flags, one_line=True)
    before = f"regexp_extract(content, {quoted(rf'(?s:\A.*?)(?={confined})')}, 0)"
    line = f"CASE WHEN s <> '' OR rlike(content, {quoted(confined)}) THEN length(s) - length(replace(s, '\\n', '')) + 1 END"
    return f"transform(array({before}), s -> {line})[0]"


def pattern_predicate(pattern: str, flags: str) -> str:
    """SQL for a whole-text match, behind a substring test when the pattern has a literal part."""
    match = f"rlike(content, {quoted(render(pattern, flags))})"
    if pattern in NECESSARY:
        return f"{NECESSARY[pattern]} AND {match}"
    literals = required_literals(pattern)
    if not literals:
        return match
    column, fold = ("lowered", str.lower) if "i" in flags else ("content", str)
    guard = " OR ".join(f"contains({column}, {quoted(fold(text))})" for text in dict.fromkeys(literals))
    return f"({guard}) AND {match}"


def rule_scan(files: DataFrame, rules: list[Rule] | None = None, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Scan ``files`` (``keys``, ``content``, ``language``): at most one finding per file and rule.

    One projection tests every rule with a literal pattern, so each pattern is compiled once per
    task and the text is read once.  Only (rule, line) pairs leave the projection; the catalog
    texts are joined back from a small local relation.
    """
    rules = builtin_rules() if rules is None else rules
    structural = structural_predicates()
    hits = []
    for rule in rules:
        if not rule.enabled:
            continue
        if rule.pattern:
            fires, line = pattern_predicate(rule.pattern, rule.flags), first_match_line(rule.pattern, rule.flags)
        elif rule.id in structural:
            fires, line = structural[rule.id], "NULL"
        else:
            continue
        languages = ", ".join(quoted(name) for name in rule.languages)
        hits.append(
            f"CASE WHEN language IN ({languages}) AND {fires} "
            f"THEN struct({rule.ordinal} AS ordinal, CAST({line} AS INT) AS line_number) END"
        )
    catalog = scan_rule_catalog(files.sparkSession, rules).select(
        "ordinal", F.col("id").alias("rule_id"), "severity", "category", "message", "suggestion"
    )
    texts = files.select(*keys, "content", "language", F.lower("content").alias("lowered"))
    scanned = texts.select(*keys, F.expr(f"array_compact(array({', '.join(hits)}))").alias("hits"))
    # The outer form keeps the optimizer from inferring a "not empty" filter that would evaluate the
    # whole scan a second time; the join drops the empty rows.
    return scanned.select(*keys, F.inline_outer("hits")).join(catalog, "ordinal").select(*keys, *FINDING_COLUMNS)


GRAM = 3
# Frequent characters of code: a gram without them is held by fewer files.
FREQUENT = frozenset("etaoinsrhld ._=")


def index_gram(literal: str) -> str:
    """The gram of a literal that stands for it in the index, or empty if it has none (short, or not ASCII)."""
    folded = literal.lower()
    grams = [folded[k:k + GRAM] for k in range(len(folded) - GRAM + 1) if folded[k:k + GRAM].isascii()]
    return min(grams, key=lambda g: sum(c in FREQUENT for c in g), default="")


def _prepared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Catalog rows with their rendered patterns and index entries; patterns that cannot be read have none."""
    entry = pa.struct([("gram", pa.string()), ("literal", pa.string()), ("earlier", pa.list_(pa.string()))])
    for batch in batches:
        matcher, confined, entries = [], [], []
        for pattern, flags in zip(batch.column("pattern").to_pylist(), batch.column("flags").to_pylist()):
            try:
                whole, line = render(pattern, flags), render(pattern, flags, one_line=True)
                literals = list(dict.fromkeys(x.lower() if "i" in flags else x for x in required_literals(pattern) or []))
            except (IndexError, ValueError):
                whole, line, literals = None, None, []
            grams = [index_gram(x) for x in literals]
            indexed = bool(literals) and all(grams)
            matcher.append(whole)
            confined.append(line)
            entries.append([{"gram": g, "literal": x, "earlier": literals[:k]} for k, (g, x) in enumerate(zip(grams, literals))]
                           if indexed else [{"gram": "", "literal": "", "earlier": []}])
        added = [pa.array(matcher, pa.string()), pa.array(confined, pa.string()), pa.array(entries, pa.list_(entry))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "matcher", "confined", "entries"])


def _catalog(rules: DataFrame) -> DataFrame:
    """Enabled pattern rules, renumbered in their order, with patterns rendered and ``valid`` if the engine can compile them."""
    enabled = rules.where(F.col("enabled") & F.col("pattern").isNotNull())
    numbered = enabled.select(
        F.row_number().over(Window.orderBy("ordinal", "id")).alias("ordinal"), *[c for c in rules.columns if c not in ("ordinal", "flags")],
        F.regexp_replace(F.coalesce("flags", F.lit("i")), "[^ims]", "").alias("flags"))
    schema = T.StructType([*numbered.schema.fields, *T._parse_datatype_string(
        "matcher string, confined string, entries array<struct<gram: string, literal: string, earlier: array<string>>>").fields])
    prepared = numbered.mapInArrow(_prepared, schema)
    compiles = [F.try_reflect(F.lit("java.util.regex.Pattern"), F.lit("compile"), F.col(c)).isNotNull() for c in ("matcher", "confined")]
    return prepared.withColumn("valid", F.coalesce(compiles[0] & compiles[1], F.lit(False)))


def rule_scan_custom(files: DataFrame, rules: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Scan with a catalog that is data.  ``flags`` NULL marks a plain text pattern: case-insensitive.

    The catalog stays a table, so it can hold thousands of rules: an inverted index leads from a gram of each required
    literal to its rules.  A file takes its own grams that the index knows and meets the rules behind them whose literal it
    holds; only those run their pattern.  Rules without such a literal meet every file of their languages.  Malformed
    patterns are left out (see :func:`rejected_rules`).
    """
    spark = files.sparkSession
    path = scratch_path(spark, "rule-index")
    entry = _catalog(rules).where("valid").select("*", F.explode("entries").alias("entry"), F.explode("languages").alias("language"))
    columns = ["ordinal", F.col("id").alias("rule_id"), "severity", "category", "message", "suggestion", "matcher", "confined", "flags"]
    entry.select("entry.gram", "entry.literal", "entry.earlier", "language", *columns).distinct().write.parquet(path)
    index = spark.read.parquet(path)
    # Three characters: however large the catalog is, there are at most 128 ** 3 grams.
    grams = index.agg(F.array_sort(F.collect_set("gram"))).scalar()
    texts = files.select(*keys, "content", "language", F.lower("content").alias("lowered"))
    own = F.regexp_extract_all("lowered", F.lit(f"(?s)(?=({'.' * GRAM}))"), F.lit(1))
    held = texts.withColumn("gram", F.explode(F.array_append(F.array_intersect(grams, own), F.lit(""))))
    met = held.join(index, ["gram", "language"])
    text = F.when(F.col("flags").contains("i"), F.col("lowered")).otherwise(F.col("content"))
    # A rule with several literals is met through the first of them that the file holds, so once.
    met = met.where(text.contains(F.col("literal")) & ~F.exists("earlier", lambda x: text.contains(x)) & F.expr("rlike(content, matcher)"))
    line = F.expr("CASE WHEN rlike(content, confined) THEN regexp_count(split(content, confined, 2)[0], '\\n') + 1 END").cast("int")
    return met.withColumn("line_number", line).select(*keys, *FINDING_COLUMNS)


def rejected_rules(rules: DataFrame) -> DataFrame:
    """The enabled rules of a catalog whose pattern is malformed."""
    return _catalog(rules).where(~F.col("valid")).select(*rules.columns)


def rules_active(rules: DataFrame, disabled: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """Enabled rules per language, without the ids of a disabled list."""
    kept = rules.where(F.col("enabled"))
    if disabled:
        kept = kept.where(~F.col("id").isin(*disabled))
    return kept.select("ordinal", "id", "severity", "category", F.explode("languages").alias("language"))


def apply_overrides(rules: DataFrame, overrides: DataFrame) -> DataFrame:
    """Add, update, toggle or delete rules.

    ``overrides`` has the rule columns plus ``deleted``; NULL keeps the stored value, an unknown id
    is added after the existing rules.
    """
    names = [c for c in rules.columns if c != "id"]
    new = overrides.select("id", "deleted", *[F.col(c).alias(f"new_{c}") for c in names if c in overrides.columns])
    joined = rules.join(new, "id", "full_outer")
    columns = [F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in new.columns else F.col(c) for c in names]
    merged = joined.where(~F.coalesce("deleted", F.lit(False))).select("id", *columns)
    return merged.select(*rules.columns)


def bulk_update(rules: DataFrame, ids: list[str], **updates) -> DataFrame:
    """Set the given columns for all listed rules."""
    listed = F.col("id").isin(*ids)
    return rules.withColumns({c: F.when(listed, F.lit(v)).otherwise(F.col(c)) for c, v in updates.items()})


def rule_hit_counts(findings: DataFrame, by: list[str], keys: tuple[str, ...] = ("run_id", "path")) -> DataFrame:
    """Findings and files (``keys``) per rule, severity or category.

    Two steps instead of one distinct count: counting per (group, file) first keeps a group with a
    third of all rows spread over many tasks.
    """
    per_file = findings.groupBy(*by, *keys).agg(F.count("*").alias("n"))
    return per_file.groupBy(*by).agg(F.sum("n").alias("findings"), F.count("*").alias("files"))


