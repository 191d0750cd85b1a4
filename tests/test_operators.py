"""Truth tables, edge cases and quirks that the corpora do not reach."""

import gzip
import itertools
import json
import random
import re

import pyarrow as pa
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from reviewlake.functions import language as lang
from reviewlake.functions.jsnum import half_up
from reviewlake.functions.rule_ids import finding_rule_id
from reviewlake.functions.similarity import features, is_similar
from reviewlake.operators import delta, feedback, filters, fixes, merge, metrics, reports, responses, scoring, skew, validation, webhook
from reviewlake.sources import pricing, sinks, tables


def test_label_truth_table(spark):
    rows, want = [], {}
    for i, (tp, fp, fn, ga, gt) in enumerate(itertools.product(range(3), range(3), range(3), range(3), range(3))):
        if ga > gt:
            continue
        rows += [(i, None, "accept")] * tp + [(i, "llm", "reject")] * fp + [(i, "validation", "modify")] * fn
        rows += [(i, "gate", "accept")] * ga + [(i, "gate", "reject")] * (gt - ga)
        if tp + fp + fn + gt == 0:
            continue
        gate = None if gt == 0 else int(ga == gt)
        if tp + fp + fn:
            label = ("correct" if not fp and not fn else "false_positive" if not tp and not fn
                     else "false_negative" if not tp and not fp else "partial")
        else:
            label = "correct" if gate == 1 else "false_positive"
        want[i] = (tp / (tp + fp) if tp + fp else None, tp / (tp + fn) if tp + fn else None, gate,
                   (tp - fp) / (tp + fp) if tp + fp else None, label)
    df = spark.createDataFrame(rows, "record_id long, finding_type string, action string")
    got = {r.record_id: (r.precision_score, r.recall_score, r.gate_correct, r.rl_reward, r.supervised_label)
           for r in feedback.labels_of(df).collect()}
    assert got == want


def test_prices(spark):
    models = ["claude-opus-4-20250514", "claude-opus-4-x", "gpt-4o-2024-08-06", "gpt-4o", "nope", None, ""]
    df = spark.createDataFrame([(i, m, 4200, 380) for i, m in enumerate(models)], "id int, model string, input_tokens long, output_tokens long")
    want = [0.0915, 0.0915, 0.1488, 0.0143, 0.0, 0.0, 0.0]
    for prices in (pricing.price_rows(), pricing.scan_pricing(spark)):
        assert [r.cost_usd for r in metrics.token_cost(df, prices).orderBy("id").collect()] == want
    longest = metrics.token_cost(df, pricing.price_rows(), longest_prefix=True).orderBy("id").collect()
    assert longest[2].cost_usd == 0.0143
    over = pricing.scan_pricing(spark, pricing.read_price_overrides(
        spark, '{"gpt-4": {"inputPerMillion": 1, "outputPerMillion": 1}, "mine": {"inputPerMillion": 2, "outputPerMillion": 2}}'))
    assert [(r.ordinal, r.model_key, r.input_per_m) for r in over.where("model_key in ('gpt-4', 'mine')").orderBy("ordinal").collect()] == [
        (12, "gpt-4", 1.0), (18, "mine", 2.0)]
    assert pricing.scan_pricing(spark, pricing.read_price_overrides(spark, "{broken")).count() == 16


def test_similarity(spark):
    cases = [
        (("a b", 3, "x"), ("c d", 3, "y"), True),
        (("a b", 0, "x"), ("c d", 0, "y"), False),
        (("new account", None, "x"), ("row COUNT", None, "y"), True),
        (("a b c d e", None, "x"), ("a b c f g", None, "x"), False),
        (("a b c d e", None, "x"), ("a b c z e", None, "x"), True),
        (("a b c", None, "x"), ("a b c", None, "X"), False),
    ]
    rows = [(*a, *b) for a, b, _ in cases]
    df = spark.createDataFrame(rows, "m1 string, l1 int, c1 string, m2 string, l2 int, c2 string")
    test = is_similar(F.col("a"), F.col("b"))
    got = df.select(features(F.col("m1"), F.col("l1"), F.col("c1")).alias("a"), features(F.col("m2"), F.col("l2"), F.col("c2")).alias("b"))
    assert [r[0] for r in got.select(test).collect()] == [w for _, _, w in cases]


def js_rule_id(category, message):
    h = 0
    for ch in message:
        low = (int(h) << 5) & 0xFFFFFFFF
        h = (low - (1 << 32) if low >= 1 << 31 else low) - h + ord(ch)
    return f"{category[:3].upper()}-{format(abs(h), 'x')[:6].upper()}"


def test_rule_id(spark):
    messages = ["Using collect() brings all data to driver - can cause OOM on large datasets", "x", "é" * 300, "A" * 2000]
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    got = [r[0] for r in df.select(finding_rule_id(F.lit("performance"), F.col("m"))).collect()]
    assert got == [js_rule_id("performance", m) for m in messages]
    assert got[0] == "PER-1B9F7A"


def test_globs(spark):
    assert filters.glob_regex("dist/**") == "dist/.[^/]*"
    assert filters.glob_regex("**/*.min.js") == r".[^/]*/[^/]*\.min\.js"
    paths = [("dist/a.py",), ("a/node_modules/x.js",), ("a/b.min.js",), ("src/a.py",), ("aXb",)]
    df = spark.createDataFrame(paths, "path string")
    assert [r.path for r in filters.skip_globs(df).collect()] == ["dist/a.py", "src/a.py", "aXb"]
    assert [r.path for r in filters.skip_paths(df, ["a.b", "dist/*"]).collect()] == ["a/node_modules/x.js", "src/a.py"]


def test_answers(spark):
    issue = '{"severity": "low", "category": "c", "message": "m", "lineNumber": 4}'
    texts = {
        "raw": '{"issues": [%s]}' % issue,
        "fenced": 'Sure:\n```json\n{"issues": [%s]}\n```\nbye' % issue,
        "comma": '{"issues": [%s,],}' % issue,
        "pretty": '{\n  "issues": [\n    %s\n  ]\n}' % issue,
        "prose": 'I found {"issues": [%s]} there' % issue,
        "control": '{"issues": [{"severity": "low", "category": "c", "message": "m", "lineNumber": 4, "reasoning": "a\nb"}]}',
        "text line": '{"issues": [{"severity": "low", "category": "c", "message": "m", "lineNumber": "4"}]}',
        "code": '{"issues": [%s], "refactoredCode": "x = "y" + 1"}' % issue,
        "empty": "", "cut": '{"issues": [{"severity"', "list": '{"issues": {"a": 1}}', "single": "{'issues': []}",
    }
    df = spark.createDataFrame([(k, 1, v) for k, v in texts.items()], "path string, response_id int, response_text string")
    found = {(r.path, r.message, r.line_number) for r in responses.parse_findings(df).collect()}
    good = {"raw", "fenced", "comma", "pretty", "prose", "control", "text line"}
    assert found == {(k, "m", 4) for k in good}
    review = {r.path: r for r in responses.parse_review(df).collect()}
    assert {k for k, r in review.items() if len(r.issues) == 1} == good | {"code"}
    assert review["cut"].recommendations == [responses.UNREADABLE_REVIEW] and review["cut"].issues == []
    assert review["raw"].recommendations == []


def test_language_cascade(spark):
    cases = [
        ('resource "a" {}', "terraform"), ("object A { SELECT 1 }", "scala"), ("from pyspark import x", "pyspark"),
        ("spark.read\nimport os", "pyspark"), ("df.select(1)", "python"), ("df.x.select(", "pyspark"),
        ("def f():\n  q = 'x'\nselect a", "python"), ("select a\nfrom b", "sql"), ("WITH x AS (\nselect 1)", "sql"), ("hello", "python"),
    ]
    df = spark.createDataFrame([(c,) for c, _ in cases], "content string")
    got = [r[0] for r in df.select(lang.language_by_content(F.col("content"))).collect()]
    want = [w for _, w in cases]
    want[4] = "pyspark"
    assert got == want
    paths = spark.createDataFrame([("a/.py",), ("a/x.PY",), ("x.hcl",), ("noext",), ("a.b/c",)], "path string")
    assert [r[0] for r in paths.select(lang.language_by_extension(F.col("path"))).collect()] == ["python", "python", "terraform", "text", "text"]
    assert [r[0] for r in paths.select(lang.language_by_extension_cli(F.col("path"))).collect()] == ["python"] * 5
    ids = spark.createDataFrame([("python", "import  pyspark"), ("hcl", ""), ("go", "")], "i string, c string")
    assert [r[0] for r in ids.select(lang.editor_language(F.col("i"), F.col("c"))).collect()] == ["pyspark", "terraform", None]


def test_rounding(spark):
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.49,)], "x double")
    assert [r[0] for r in df.select(half_up(F.col("x"))).collect()] == [-2, 3, 0]


def test_fixes(spark):
    cases = [
        ("python", '"""d"""\ntry:\n    eval(a)\nexcept:\n    pass\n', 'import ast\n"""d"""\ntry:\n    ast.literal_eval(a)  # Fixed: security - replaced eval with ast.literal_eval\nexcept Exception:  # Fixed: catch specific exceptions\n    pass\n'),
        ("pyspark", "# '''\ndf.cache()", "# '''\ndf.cache()\n    df.unpersist()  # Added unpersist"),
        ("scala", "var x = a.get", 'val x =  // Fixed: prefer val over var for immutabilitya.getOrElse(throw new NoSuchElementException("Missing value"))  // Fixed: handle missing Option'),
        ("scala", ".filter(a)\n .filter(b)\n .filter(c)", ".filter(a && b && c)  // Fixed: combine multiple filters for better performance"),
        ("terraform", 'password = "x"', 'password = dbutils.secrets.get(scope="my-scope", key="password")  # Fixed: use secrets manager'),
        ("python", "'''\nrequests.get(u, timeout=1)\nrequests.get(u)", "'''\nrequests.get(u, timeout=1)\nrequests.get(u, timeout=30)  # Fixed: added timeout"),
        ("python", "import a\n\nfrom b import c", "import a\n\nfrom b import c"),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], "i int, language string, content string")
    got = [r.fixed for r in fixes.apply_fixes(df).orderBy("i").collect()]
    assert got == [w for _, _, w in cases]
    sql = spark.createDataFrame([("sql", "select * from t\nGROUP BY a")], "language string, content string")
    text = fixes.apply_fixes(sql).first().fixed
    assert text.startswith("-- ====") and "SELECT col1, col2, col3  /* TODO" in text and "-- Logging: End of process" in text


def test_line_delta(spark):
    old = spark.createDataFrame([("a", "x\ny\ny\nz")], "path string, content string")
    new = spark.createDataFrame([("a", "y\nx\nw\nx")], "path string, content string")
    row = delta.line_delta(old, new).first()
    assert (row.added, row.removed, row.common) == (2, 2, 2)


def test_summaries_on_no_rows(spark):
    runs = spark.createDataFrame([], "id long, repository string, project_id string, ts timestamp, request_count long, input_tokens long, "
                                 "output_tokens long, total_tokens long, latency_ms long, status string, files_reviewed long, issues_found long, "
                                 "critical_count long, high_count long, model string, source string, cost_usd double")
    assert set(metrics.metrics_summary(runs).first().asDict().values()) == {0}
    by_source = metrics.metrics_by_source(runs).collect()
    assert sorted(r.source for r in by_source) == ["application", "ide", "pipeline"] and {r.total_runs for r in by_source} == {0}
    none = spark.createDataFrame([], "record_id long, finding_type string, action string, feedback_channel string")
    assert [(r.key, r.cnt, r.share) for r in feedback.feedback_by_action(none).orderBy("key").collect()] == [
        ("accept", 0, 0), ("modify", 0, 0), ("reject", 0, 0)]
    records = spark.createDataFrame([], "id long, run_id string, created_at timestamp")
    stats = feedback.training_stats_totals(records, feedback.labels_of(none), none).first()
    assert (stats.total_records, stats.avg_precision) == (0, None)


def test_score_and_decision(spark):
    files = spark.createDataFrame([("r", "a", "sql"), ("r", "b", "sql")], "run_id string, path string, language string")
    rows = [("r", "a", i, "critical" if i > 50 else "low") for i in range(1, 60)]
    found = spark.createDataFrame(rows, "run_id string, path string, ordinal int, severity string")
    scores = {r.path: r for r in scoring.file_score(files, found).collect()}
    assert scores["a"].issues == 50 and scores["a"].critical_count == 0 and scores["a"].score == 0 and scores["b"].score == 100
    summary = scoring.batch_summary(scoring.file_score(files, found))
    row = scoring.ci_decision(summary).first()
    assert row.average_score == 50 and row.recommendation == "Average score (50) is below threshold (70)."
    assert (row.exit_code, row.reason) == (1, "Failing due to score (50) below threshold")


def test_gate_partial(spark):
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "run_id string")
    found = spark.createDataFrame([("b", "low")], "run_id string, severity string")
    model = spark.createDataFrame([("c", "critical")], "run_id string, severity string")
    errors = spark.createDataFrame([("a",)], "run_id string")
    got = {r.run_id: (r.gate_status, r.status) for r in scoring.pr_gate(files, found, model, errors).collect()}
    assert got == {"a": ("pass", "partial"), "b": ("fail", "failure"), "c": ("fail", "failure")}


def test_parts_of_a_large_group(spark):
    rows = [("hot" if i % 3 == 0 else f"k{i}", i) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, v int")
    for chunk in (1000, 10):
        out = skew.nested(df, ["k"], F.struct("v"), "vs", ["v"], chunk).collect()
        hot = [r for r in out if r.k == "hot"]
        assert [x.v for r in sorted(hot, key=lambda r: r.part) for x in r.vs] == list(range(0, 300, 3))
        assert len(hot) == -(-100 // chunk) and sum(len(r.vs) for r in out) == 300
        assert all(len(r.vs) == min(chunk, 100) and r.parts == len(hot) for r in hot)


def test_rank_by_ranges(spark):
    rows = [("hot", i * 7) for i in range(500)] + [("cold", 3), ("cold", 1)]
    df = spark.createDataFrame(rows, "k string, o long")
    got = {(r.k, r.o): r.n for r in skew.numbered(df, ["k"], "o", "n", width=50).collect()}
    assert got[("cold", 1)] == 1 and got[("cold", 3)] == 2
    assert [got[("hot", i * 7)] for i in range(500)] == list(range(1, 501))


def test_export_parts(spark):
    records = spark.createDataFrame([(1, "r1"), (2, "r2")], "id long, run_id string").withColumn("created_at", F.current_timestamp())
    rows = [(1, "r1", i, None, "accept", "gh", f"u{i}") for i in range(50)]
    given = spark.createDataFrame(rows, "record_id long, run_id string, finding_index int, finding_type string, action string, "
                                  "feedback_channel string, reviewer_id string").withColumn("created_at", F.current_timestamp())
    out = feedback.training_export(records, feedback.labels_of(given), given, chunk=10, limit=None).collect()
    assert sorted(f.finding_index for r in out if r.id == 1 for f in r.human_feedback) == list(range(50))
    two = [r for r in out if r.id == 2]
    assert len(two) == 1 and two[0].human_feedback == [] and two[0].outcome_labels is None
    assert [r for r in out if r.id == 1][0].outcome_labels.gate_correct is False


def test_export_formats(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, x string")
    sinks.export_dataset(df, str(tmp_path / "j"), "json")
    text = "".join(f.read_text() for f in sorted((tmp_path / "j").glob("part-*")))
    assert json.loads(text) == {"count": 2, "data": [{"id": 2}, {"id": 1, "x": "a"}]}
    many = spark.range(500).repartition(7).selectExpr("id", "concat('v', id) AS x")
    sinks.export_dataset(many, str(tmp_path / "m"), "json")
    text = "".join(f.read_text() for f in sorted((tmp_path / "m").glob("part-*")))
    assert json.loads(text) == {"count": 500, "data": [{"id": i, "x": f"v{i}"} for i in range(499, -1, -1)]}
    sinks.export_dataset(many.limit(0), str(tmp_path / "e"), "json")
    text = "".join(f.read_text() for f in sorted((tmp_path / "e").glob("part-*")))
    assert json.loads(text) == {"count": 0, "data": []}
    sinks.export_dataset(df, str(tmp_path / "p"), "parquet")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2


def test_export_compressed(spark, tmp_path, monkeypatch):
    """Compressed text forms hold what the plain ones hold, in files of a bounded number of lines, for a part of the bytes."""
    monkeypatch.setattr(sinks, "FILE_LINES", 100)
    df = spark.range(1000).selectExpr("id", "concat('v', id) AS x", "array(struct('accept' AS action)) AS human_feedback").repartition(2)
    size = {}
    for form, suffix in (("jsonl", "json"), ("json", "txt")):
        for compression, end in ((None, suffix), ("gzip", f"{suffix}.gz")):
            path = tmp_path / f"{form}-{compression}"
            sinks.export_dataset(df, str(path), form, compression)
            files = sorted(path.glob(f"part-*.{end}"))
            size[form, compression] = sum(f.stat().st_size for f in files)
            read = [gzip.decompress(f.read_bytes()).decode() if compression else f.read_text() for f in files]
            assert max(text.count("\n") for text in read) <= 100
            text = "".join(read)
            rows = json.loads(text)["data"] if form == "json" else [json.loads(line) for line in text.splitlines()]
            assert sorted(r["id"] for r in rows) == list(range(1000))
        assert size[form, "gzip"] * 3 < size[form, None]


def test_sarif(spark):
    rows = [("r", 1, "a.py", i, "high" if i % 2 else "info", "security", f"m{i % 3}", "fix" if i % 2 else "", 5 if i % 4 else None, None)
            for i in range(20)]
    found = spark.createDataFrame(rows, "run_id string, file_no long, path string, ordinal long, severity string, category string, "
                                  "message string, suggestion string, line_number int, reasoning string")
    doc = json.loads(reports.report_sarif(found).first().report)
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and len(run["results"]) == 20 and len(run["tool"]["driver"]["rules"]) == 3
    assert run["results"][1]["message"]["text"] == "m1\n\nSuggestion: fix" and run["results"][0]["message"]["text"] == "m0"
    assert "region" not in run["results"][0]["locations"][0]["physicalLocation"]
    assert run["tool"]["driver"]["rules"][0]["id"] == js_rule_id("security", "m0")
    parts = reports.report_sarif(found, chunk=4).collect()
    assert len(parts) == 5
    in_order = [r for p in sorted(parts, key=lambda p: p.part) for r in json.loads(p.report)["runs"][0]["results"]]
    assert in_order == run["results"]
    for p in parts:
        run = json.loads(p.report)["runs"][0]
        assert {r["ruleId"] for r in run["results"]} == {r["id"] for r in run["tool"]["driver"]["rules"]}
    cli = json.loads(reports.report_sarif(found, cli=True).first().report)["runs"][0]
    assert {r["level"] for r in cli["results"]} == {"error", "warning"}


def test_pr_comment(spark):
    rows = [("r", 0, i, "error", "critical" if i == 0 else None, "f.py", None if i else 3, "x" * 100) for i in range(12)]
    results = spark.createDataFrame(rows, "run_id string, part int, pos int, level string, severity string, file string, line int, text string")
    scores = spark.createDataFrame([("r", 55, False, 90)], "run_id string, overall_score int, pass_threshold boolean, security int")
    text = reports.report_pr_comment(results, scores).first().comment
    assert "12 total (1 critical, 11 high, 0 medium, 0 low)" in text and "_...2 more." in text
    assert "| 🔴 | `f.py:3` | " + "x" * 80 + " |" in text and "| Security | 90 |" in text and "Build blocked" in text


def test_upserts(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], "run_id string, ingest_seq int, v string")
    new = spark.createDataFrame([("b", 3, "z"), ("b", 2, "y"), ("c", 2, "n"), ("c", 4, "m")], "run_id string, ingest_seq int, v string")
    as_set = lambda df: {tuple(r) for r in df.select("run_id", "ingest_seq", "v").collect()}
    last = sinks.upsert_last(old, new)
    assert as_set(last) == {("a", 1, "x"), ("b", 3, "z"), ("c", 4, "m")}
    assert as_set(sinks.upsert_last(last, new)) == as_set(last)
    assert as_set(sinks.insert_first(old, new)) == {("c", 2, "n")}
    assert as_set(sinks.replace_keys(old, new.where("v = 'z'"), "run_id")) == {("a", 1, "x"), ("b", 3, "z")}


def test_batches_replay(spark, tmp_path):
    path = str(tmp_path / "t")
    first = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    second = spark.createDataFrame([("b", 2)], "k string, v int")
    sinks.write_batch(first, path, 0)
    sinks.write_batch(second, path, 1)
    sinks.write_batch(second, path, 1)
    assert {tuple(r) for r in sinks.read_latest(spark, path, "k").collect()} == {("a", 1), ("b", 2)}
    sinks.compact(spark, path, str(tmp_path / "c"), "k")
    assert {tuple(r) for r in sinks.read_latest(spark, str(tmp_path / "c"), "k").collect()} == {("a", 1), ("b", 2)}


def test_the_newest_write_stays(spark, tmp_path):
    path, rows = str(tmp_path / "t"), lambda *r: spark.createDataFrame(r, "k string, seq int, v string")
    sinks.write_batch(rows(("a", 10, "new"), ("b", 1, "old")), path, 0)
    sinks.write_batch(rows(("a", 5, "late"), ("b", 2, "new")), path, 1)
    assert {tuple(r) for r in sinks.read_latest(spark, path, "k", ["seq"]).collect()} == {("a", 10, "new"), ("b", 2, "new")}
    stored, new = rows(("a", 10, "new"), ("b", 1, "old")), rows(("a", 5, "late"), ("b", 2, "new"), ("b", 1, "x"), ("c", 1, "new"))
    out = sinks.upsert_last(stored, new, "k", "seq").collect()
    assert {tuple(r) for r in out} == {("a", 10, "new"), ("b", 2, "new"), ("c", 1, "new")} and len(out) == 3


def test_equal_posts_get_different_ids(spark, tmp_path):
    path = str(tmp_path / "m")
    posts = spark.createDataFrame([("r", "p", "w", "t", 1)] * 2, "repository string, project_id string, workflow_run_id string, ts string, n int")
    for batch in ("1", "1", "2"):
        sinks.append_metrics(posts, path, batch)
    ids = [r.id for r in spark.read.parquet(path).collect()]
    assert len(ids) == 6 and len(set(ids)) == 4


def test_source_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "a.py").write_text("one\ntwo")
    (tmp_path / "d" / "b.sql").write_text("x")
    out = tables.scan_source_files(spark, [str(tmp_path), str(tmp_path / "*.py")]).collect()
    assert sorted((r.path.rsplit("/", 1)[1], r.content) for r in out) == [("a.py", "one\ntwo"), ("b.sql", "x")]


def test_source_files_below_another_path(spark, tmp_path):
    """Paths below another one aren't listed again, texts aren't shuffled to find twins, hidden and missing paths keep their meaning."""
    for name in ("a.py", "d/b.sql", "d/e/c.sql", "_h/x.sql"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(name)
    top, plain, hidden = str(tmp_path), ["a.py", "b.sql", "c.sql"], ["a.py", "b.sql", "c.sql", "x.sql"]
    for paths, left, want in (
        ([top, f"{top}/d/b*", f"{top}/d", f"{top}/a.py", f"{top}/d/e/"], [top], plain), ([top, f"{top}/_h"], [top, f"{top}/_h"], hidden),
        ([top, f"{top}/*"], [top, f"{top}/*"], hidden), ([top, f"file://{top}"], [top, f"file://{top}"], plain),
        ([top, f"{top}/d/{{b,e/c}}.sql"], [top, f"{top}/d/{{b,e/c}}.sql"], plain), ([f"{top}/a.py"] * 2, [f"{top}/a.py"] * 2, ["a.py"]),
    ):
        found = tables.scan_source_files(spark, paths)
        assert sorted(r.path.rsplit("/", 1)[1] for r in found.collect()) == want, paths
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString(), paths
        assert tables._separate(spark, paths) == left
    for missing in (f"{top}/q*", f"{top}/d/zz", f"{top}/a.py/a*"):
        with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
            tables.scan_source_files(spark, [top, missing])


def test_small_source_files_share_tasks(spark, tmp_path):
    for n in range(200):
        (tmp_path / f"{n}.py").write_text("x")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16m")
    try:
        found = tables.scan_source_files(spark, [str(tmp_path)])
        assert found.count() == 200 and found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism + 1
        assert spark.conf.get("spark.sql.files.openCostInBytes") != tables.SMALL_FILES["spark.sql.files.openCostInBytes"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_text_files(spark, tmp_path, monkeypatch):
    """Files as Spark's writer makes them, one per key and partition, but in few folders and not one by one through Hadoop's local files."""
    monkeypatch.setattr(sinks, "FILES_PER_FOLDER", 2)
    rows = [(k, f"é{k}") for k in range(9) for _ in range(2)] + [(None, "n"), (3, None), (None, None), (-4, "a\nb"), (7, "")]
    df = spark.createDataFrame(rows, "k long, v string").coalesce(2).cache()
    spark.conf.set("fs.viewfs.mounttable.files.link./top", f"file://{tmp_path}")
    try:
        stores = {"local": str(tmp_path / "local"), "uri": f"file://{tmp_path}/uri", "other": "viewfs://files/top/other"}
        for path in stores.values():
            sinks.write_text_files(df, path, "k", "v")
        df.select("k", F.col("v").alias("value")).write.partitionBy("k").text(str(tmp_path / "spark/folder=0"))

        def read(path):
            found = tables.scan_source_files(spark, [path, f"{path}/folder=*/k=*"])
            return sorted((re.search("k=([^/.]*)", r.path)[1], sorted(r.content.split("\n"))) for r in found.collect())

        want = read(str(tmp_path / "spark"))
        assert len(want) >= 11 and all(read(path) == want for path in stores.values())
    finally:
        spark.conf.unset("fs.viewfs.mounttable.files.link./top")
        df.unpersist()
    folders = sorted(p.name for p in (tmp_path / "local").iterdir())
    assert all(re.fullmatch(r"folder=0000[01]-\d{5}", f) for f in folders) and not list((tmp_path / "local").rglob("*.crc"))
    assert max(len(list((tmp_path / "local" / f).iterdir())) for f in folders) == 2
    with pytest.raises(FileExistsError):
        sinks.write_text_files(df, stores["local"], "k", "v")


def test_text_files_of_a_task_tried_twice(spark, tmp_path, monkeypatch):
    """A second try of a task, after the first has renamed its folders, adds no file."""
    class Task:
        tries = 0

        def partitionId(self):
            return 0

        def taskAttemptId(self):
            Task.tries += 1
            return Task.tries

    monkeypatch.setattr(sinks.TaskContext, "get", staticmethod(Task))
    batch = pa.RecordBatch.from_pydict({"k": ["1", "1", "2", "3"], "v": ["a", "b", None, "c"]})
    for _ in range(2):
        assert next(sinks._file_writer(str(tmp_path), "k", 2)(iter([batch]))).to_pydict() == {"files": [3]}
    found = {r.path.rsplit("/", 1)[1]: r.content for r in tables.scan_source_files(spark, [str(tmp_path)]).collect()}
    assert found == {"k=1.txt": "a\nb\n", "k=2.txt": "\n", "k=3.txt": "c\n"}
    assert len(list(tmp_path.glob("folder=*/*"))) == 3


def test_validation_reasons(spark):
    df = spark.createDataFrame([("", "p", "w", None), ("r", None, "", "ok"), ("r", "p", "w", "partial")],
                               "repository string, project_id string, workflow_run_id string, status string")
    got = [r[0] for r in df.select(validation.metric_reject_reason()).collect()]
    assert got == ["Missing required fields: repository", "Invalid status: ok. Must be success|failure|partial.", None]


def test_webhook_edges(spark):
    body = {"action": "created", "comment": {"body": "## AI Code Review\nRun: `r1`"}, "reaction": {"content": "-1"}, "sender": {"login": "u"}}
    rows = [(1, "issue_comment", json.dumps(body)), (2, "issue_comment", "{broken"),
            (3, "pull_request_review", json.dumps({"review": {"state": "approved", "body": "Run r1 fine"}})), (4, "push", "{}")]
    events = spark.createDataFrame(rows, "event_id long, event string, body string")
    records = spark.createDataFrame([(7, "r1")], "id long, run_id string")
    given, ignored = webhook.webhook_feedback(events, records)
    assert {(r.event_id, r.record_id, r.action, r.feedback_channel) for r in given.collect()} == {(1, 7, "reject", "gh"), (3, 7, "accept", "pr")}
    assert {(r.event_id, r.ignored_reason) for r in ignored.collect()} == {(2, "not a new comment"), (4, "event push")}


def test_advice_and_effort(spark):
    files = spark.createDataFrame([("a", "python", "x.cache() try join")], "path string, language string, content string")
    found = spark.createDataFrame([("a", "critical", "performance"), ("a", "high", "security")], "path string, severity string, category string")
    scores = scoring.category_scores(files, found)
    row = scoring.effort_estimate(scoring.review_advice(scores)).first()
    assert (row.performance, row.security, row.code_quality, row.maintainability, row.overall_score) == (80, 85, 100, 100, 90)
    assert row.strengths == ["Proper DataFrame caching implemented", "Error handling implemented"]
    assert row.estimate == "4-8 hours" or row.effort == 8
    assert row.summary == "Analyzed Python code. Overall score: 90/100. Found 2 issue(s): 1 critical, 1 high"


def test_advice_and_effort_count_the_model(spark):
    """A similar model finding adds nothing to the counts, another one does; the scores stay those of the rules."""
    files = spark.createDataFrame([("r", "a", "sql", "x = 1"), ("r", "b", "sql", "x")], "run_id string, path string, language string, content string")
    columns = "run_id string, path string, ordinal long, severity string, category string, message string, suggestion string, line_number int"
    found = spark.createDataFrame([("r", "a", 1, "high", "security", "plain password", "hide it", 3)], columns)
    told = spark.createDataFrame([("r", "a", 1, "critical", "security", "same place", "s", 3, "why"),
                                  ("r", "a", 2, "critical", "Logic", "wrong total", "s", 9, None)], columns + ", reasoning string")
    answers = spark.createDataFrame([("r", "a", 2, ["tested", "short"], ["split it"]), ("r", "a", 1, ["short"], ["split it", "name it"])],
                                    "run_id string, path string, response_id long, strengths array<string>, recommendations array<string>")
    keys = ("run_id", "path")
    scores = scoring.with_merged_issues(scoring.category_scores(files, found, keys), merge.merge_findings_tagged(found, told))
    rows = {r.path: r for r in scoring.effort_estimate(scoring.review_advice(scores, scoring.model_notes(answers))).collect()}
    assert (rows["a"].issues, rows["a"].critical_count, rows["a"].high_count, rows["a"].effort, rows["a"].security) == (2, 1, 1, 8, 85)
    assert rows["a"].summary == "Analyzed SQL code. Overall score: 96/100. Found 2 issue(s): 1 critical, 1 high"
    assert rows["a"].strengths == ["short", "tested"]
    assert rows["a"].recommendations[:3] == ["split it", "name it", "Address high-severity issues first for maximum impact"]
    assert (rows["b"].issues, rows["b"].effort, rows["b"].strengths) == (0, 0, ["Code structure is clean"])


def test_json_text_without_patterns(spark):
    """The text between the first two fences, cut to the outermost braces, as a pattern would find it, without running one."""
    rng = random.Random(3)
    parts = ["```", "json", "`", " ", "\n", "{", "}", "a", "\u00a0", "\t", "\U0001f600"]
    texts = ["", "```json{}```", *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(500))]
    out = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", responses.json_text(F.col("text")).alias("x"))
    assert not re.search("(?i)rlike|regexp", out._jdf.queryExecution().optimizedPlan().toString())
    for i, found in out.collect():
        fenced = re.search(r"```(?:json)?\s*(.*?)\s*```", texts[i], re.S | re.A)
        body = fenced[1] if fenced else texts[i]
        braces = re.search(r"\{.*\}", body, re.S)
        assert found == (braces[0] if braces else body.strip(" ")), texts[i]
