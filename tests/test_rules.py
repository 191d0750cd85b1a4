"""One hit and one miss per rule, line numbers, and the catalog operations."""

import random
import re

import pytest

from reviewlake.functions.regex import render, required_literals
from reviewlake.operators import rules
from reviewlake.sources.rule_catalog import builtin_rules, scan_rule_catalog, scan_rule_files

# rule id -> (text that fires it, text that does not)
SNIPPETS = {
    "pyspark-001": ("x = 1", '"""doc"""'),
    "pyspark-002": ("read(inferSchema = true)", "inferSchema=False"),
    "pyspark-003": ("df.collect()", "df.collect(1)"),
    "pyspark-004": ("df.toPandas()", "df.to_pandas()"),
    "pyspark-005": ("x.rdd", "xrdd"),
    "pyspark-006": ("@udf", "ud f("),
    "pyspark-007": ("sys.exit", "exits"),
    "pyspark-008": ("print(1)", "sprint (1)"),
    "pyspark-009": ("df.show()", "df.show(5)"),
    "pyspark-010": ("a.join(b)", "join(b)"),
    "pyspark-011": ('select("*")', 'select("a")'),
    "pyspark-012": ("df.write.csv", "df.write"),
    "python-001": ("def f (x)", "def f(x: int)"),
    "python-002": ("except :", "except ValueError:"),
    "python-003": ("def f(a=[])", "def f(a=None)"),
    "python-004": ("print(1)", "éprint (1)"),
    "python-005": ("global x", "globalx"),
    "python-006": ("for x in y: s + 'a'", "s + 'a'"),
    "scala-001": ("var x", "val x"),
    "scala-002": ("x.get", "x.get(1)"),
    "scala-003": ("x != null", "x = null"),
    "scala-004": ("DriverManager.getConnection", "DriverManager"),
    "scala-005": ("catch { case e: Exception", "catch { case e: IOException"),
    "scala-006": ("System.exit", "Systemexit"),
    "scala-007": ("x.collect()", "x.collect"),
    "scala-008": ('spark.sql(s"', 'spark.sql("'),
    "scala-009": ("a.repartition(1)\n.repartition(2)", "a.repartition(1)\n\n.repartition(2)"),
    "scala-010": (".filter(a).filter(b).filter(c)", ".filter(a).filter(b)"),
    "scala-011": ("scala.io.Source.fromURL", "scala.io.Source.fromFile"),
    "scala-012": ("dataFrames = dataFrames :+ x", "dataFrames = x"),
    "scala-013": (".join(a).join(b).count().show()", ".join(a).join(b).count().show().cache()".replace(".count()", ".count(")),
    "scala-014": ("df.write.parquet(p)", "df.write.partitionBy(x).parquet(p)"),
    "scala-015": ('"s3://b/2024/x"', '"s3://b/x"'),
    "scala-016": ("println(x)", "print(x)"),
    "scala-017": ("spark.read.json(p)", "spark.read.schema(s).read.json(p)"),
    "sql-001": ("select  * from t", "select a"),
    "sql-002": ("DELETE FROM t ;", "DELETE FROM t WHERE a"),
    "sql-003": ("year(d)", "years"),
    "sql-004": ("not in (1)", "not exists (1)"),
    "sql-005": ("in (select a)", "in (1)"),
    "sql-006": ("from raw_x", "from xraw_x"),
    "sql-007": ("where a = 'x'", "where a = 'NULL'"),
    "sql-008": ("group by a", "grouped"),
    "sql-009": ("select a from t", "select a"),
    "sql-010": ("from a, b", "from a join b"),
    "terraform-001": ('token = "x"', "token = var.x"),
    "terraform-002": ('provider "aws"', 'provider "aws" required_providers'),
    "terraform-003": ("terraform {", "terraform { backend"),
    "terraform-004": ("acl = 'public-read'", "acl = 'private'"),
    "terraform-005": ('resource "a"', 'resource "a" tags = 1'),
    "terraform-006": ("aws_s3_bucket", "aws_s3_bucket server_side_encryption"),
    "terraform-007": ('cidr_blocks = ["0.0.0.0/0"]', 'cidr_blocks = ["10.0.0.0/8"]'),
    "terraform-008": ('variable "a"', 'variable "a" description = 1'),
    "terraform-009": ("default = true", "default = false"),
    "security-001": ("password = 'x'", "password = x"),
    "security-002": ("api_key='x'", "api_key=x"),
    "security-003": ("execute(a + b)", "execute(a)"),
    "security-004": ("http://example.org", "http://localhost"),
    "security-005": ("AKIA" + "A" * 16, "AKIA" + "A" * 15),
    "security-006": ("-----BEGIN RSA PRIVATE KEY-----", "-----BEGIN PUBLIC KEY-----"),
    "security-007": ("jdbc:x//u:p@h", "jdbc:x//h"),
    "common-001": ("'/a/b'", "'a/b'"),
    "common-002": ("2024-01-02", "2024-01-021"),
    "common-003": (" 1234 ", "a1234b"),
}


def test_catalog_is_complete():
    catalog = builtin_rules()
    assert [r.ordinal for r in catalog] == list(range(1, 65))
    assert {r.id for r in catalog} == set(SNIPPETS)
    count = lambda key: {k: sum(getattr(r, key) == k for r in catalog) for k in {getattr(r, key) for r in catalog}}
    assert count("severity") == {"critical": 12, "high": 16, "medium": 22, "low": 14}
    assert count("category")["performance"] == 20 and count("category")["security"] == 14


def test_every_rule_hits_and_misses(spark):
    rows = []
    for rule in builtin_rules():
        for kind, text in zip(("hit", "miss"), SNIPPETS[rule.id]):
            rows.append((f"{rule.id}/{kind}", "\n" + text, rule.languages[-1]))
    found = rules.rule_scan(spark.createDataFrame(rows, "path string, content string, language string")).collect()
    fired = {(r.path, r.rule_id) for r in found}
    for rule in builtin_rules():
        assert (f"{rule.id}/hit", rule.id) in fired, rule.id
        assert (f"{rule.id}/miss", rule.id) not in fired, rule.id
    lines = {r.path: r.line_number for r in found if r.path == f"{r.rule_id}/hit"}
    for rule in builtin_rules():
        assert lines[f"{rule.id}/hit"] == (2 if rule.pattern else None), rule.id


def test_match_over_lines_has_no_line(spark):
    df = spark.createDataFrame([("a", "x\nselect\n*", "sql")], "path string, content string, language string")
    row = rules.rule_scan(df).where("rule_id = 'sql-001'").first()
    assert row is not None and row.line_number is None


def _ascii(pattern, flags):
    return re.compile(pattern.replace(r"\/", "/"), re.ASCII | (re.I if "i" in flags else 0))


def test_scan_equals_line_by_line_reference(spark):
    """Whole-text test and first matching line, restated in plain Python over random texts."""
    rnd = random.Random(5)
    pieces = [s for pair in SNIPPETS.values() for s in pair] + ["\n", "\n", " ", "= ", "'", "var ", "FROM a ,", "bc", "select"]
    rows = [(f"f{i}", "".join(rnd.choice(pieces) for _ in range(rnd.randrange(1, 12))), rnd.choice(
        ["pyspark", "python", "scala", "sql", "terraform"])) for i in range(400)]
    df = spark.createDataFrame(rows, "path string, content string, language string").repartition(5)
    got = {(r.path, r.rule_id): r.line_number for r in rules.rule_scan(df).collect()}
    for path, text, language in rows:
        for rule in builtin_rules():
            if not rule.pattern or language not in rule.languages:
                continue
            regex = _ascii(rule.pattern, rule.flags)
            if not regex.search(text):
                assert (path, rule.id) not in got
                continue
            line = next((i for i, one in enumerate(text.split("\n"), 1) if regex.search(one)), None)
            assert got[(path, rule.id)] == line, (rule.id, text)


def test_required_literals_never_lose_a_match():
    for rule in builtin_rules():
        literals = required_literals(rule.pattern) if rule.pattern else None
        if literals:
            text = SNIPPETS[rule.id][0]
            fold = str.lower if "i" in rule.flags else str
            assert any(fold(x) in fold(text) for x in literals), rule.id


def test_render_boundaries():
    assert render(r"\bvar\s+").startswith(r"(?<!\w)var")
    assert render(r"null\b").endswith(r"(?!\w)")
    assert render("[^a]b", one_line=True) == r"[^a\n]b"


def test_overrides(spark):
    schema = "id string, name string, enabled boolean, severity string, message string, deleted boolean"
    changes = spark.createDataFrame([
        ("pyspark-001", None, False, None, None, False),
        ("sql-001", None, None, None, None, True),
        ("new-001", "New", True, "low", "new one", False),
    ], schema)
    out = {r.id: r for r in rules.apply_overrides(scan_rule_catalog(spark), changes).collect()}
    assert out["pyspark-001"].enabled is False and out["pyspark-001"].severity == "medium"
    assert "sql-001" not in out and out["new-001"].message == "new one"
    off = rules.bulk_update(scan_rule_catalog(spark), ["sql-002", "sql-003"], enabled=False)
    assert off.where("NOT enabled").count() == 3


@pytest.mark.parametrize("flags,hit", [(None, True), ("", False), ("i", True)])
def test_custom_rule_flags(spark, flags, hit):
    rows = [(1, "c-1", "n", True, "custom", "SELECT X", flags, "low", "logging", "m", "s", ["sql"])]
    from reviewlake.sources.rule_catalog import RULE_SCHEMA

    files = spark.createDataFrame([("a", "1\nselect x", "sql")], "path string, content string, language string")
    found = rules.rule_scan_custom(files, spark.createDataFrame(rows, RULE_SCHEMA)).collect()
    assert [r.line_number for r in found] == ([2] if hit else [])


def test_rule_files(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '[{"id": "x-1", "name": "n", "pattern": {"source": "a+", "flags": "i"}, "severity": "low", "category": "c",'
        ' "message": "m", "suggestion": "s", "languages": ["sql"]},'
        ' {"id": "x-2", "enabled": false, "patternSource": "b", "languages": ["scala"]}]')
    out = {r.id: r for r in scan_rule_files(spark, str(tmp_path)).collect()}
    assert (out["x-1"].pattern, out["x-1"].flags, out["x-1"].enabled, out["x-1"].group) == ("a+", "i", True, "x")
    assert (out["x-2"].pattern, out["x-2"].flags, out["x-2"].enabled) == ("b", "", False)


def test_plan_reads_text_once_and_joins_locally(spark):
    df = spark.createDataFrame([("a", "x", "sql")], "path string, content string, language string")
    plan = rules.rule_scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LocalTableScan" in plan and "SortMergeJoin" not in plan
    assert "Exchange hashpartitioning" not in plan


def test_large_custom_catalog(spark):
    """2,000 rules: literals of all kinds, rules without one, malformed patterns; equal to testing each rule on each file."""
    from reviewlake.sources.rule_catalog import RULE_SCHEMA

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdeé_") for _ in range(rng.randint(1, 5)))
    kinds = [lambda: word() + r"\(", lambda: f"{word()}|{word()}x", lambda: rf"\d{{2}}{word()}", lambda: r"^\w+\s*=$", lambda: word().upper(), lambda: "(" + word()]
    rows = [(n, f"c-{n}", "n", rng.random() > 0.1, "custom", rng.choice(kinds)(), rng.choice([None, "", "i", "im"]), "low", "c", "m", "s",
             rng.sample(["sql", "python", "scala"], rng.randint(1, 2))) for n in range(2000)]
    catalog = spark.createDataFrame(rows, RULE_SCHEMA)
    texts = [("f%d" % i, "\n".join(" ".join(word() + rng.choice(["(", " =", "", "42abc"]) for _ in range(6)) for _ in range(5)), rng.choice(["sql", "python", "tf"]))
             for i in range(40)]
    files = spark.createDataFrame(texts, "path string, content string, language string")
    got = {(r.path, r.rule_id): r.line_number for r in rules.rule_scan_custom(files, catalog).collect()}
    bad = {r.id for r in rules.rejected_rules(catalog).collect()}
    want = {}
    for n, rid, _, on, _, pattern, flags, *_, languages in rows:
        if not on:
            continue
        flags = "i" if flags is None else flags
        try:
            known = re.compile(pattern, sum({"i": re.I, "m": re.M}[f] for f in flags) | re.A)
        except re.error:
            assert rid in bad
            continue
        assert rid not in bad
        for path, content, language in texts:
            if language in languages and known.search(content):
                lines = [k for k, line in enumerate(content.split("\n"), 1) if known.search(line)]
                want[path, rid] = lines[0] if lines else None
    assert set(got) == set(want)
    assert sum(got[k] != want[k] for k in want) == 0


def test_line_of_an_empty_match(spark):
    """The first match counts, also an empty one at the start; a match over two lines has no line; no pattern is compiled for each row."""
    df = spark.createDataFrame([("a\n\U0001f600b\nb",)], "content string")
    line = {p: df.selectExpr(rules.first_match_line(p) + " AS n").first().n for p in ("^", "b", r"a\s+", r"a\s+\S")}
    assert line == {"^": 1, "b": 2, r"a\s+": None, r"a\s+\S": None}
    assert "split(" not in rules.first_match_line("b")


def test_guards_belong_to_rules():
    """Every guard of a pattern without a literal is that of a rule in the catalog: dates and quoted paths too."""
    assert {r.id for r in builtin_rules() if r.pattern in rules.NECESSARY} == {"common-001", "common-002", "common-003"}
