"""The flagship job end to end on a small, skewed fixture; reports and prompts."""

import pytest
from pyspark.sql import functions as F

from reviewlake import session
from reviewlake.operators import prompts, reports, scoring
from reviewlake.plans import review
from reviewlake.sources import pricing, sinks


def fixture(spark):
    files = [("r1", 1, "a.py", "import x\nprint(1)", "python"), ("r1", 2, "b.sql", "select * from t", "sql"),
             ("r2", 1, "c.tf", "ok", "terraform"), ("r2", 2, "d.tf", "", "terraform"), ("r3", 1, "e.tf", "ok", "terraform")]
    answers = [("r1", "a.py", 1, '{"issues": [{"severity": "critical", "category": "Logic", "message": "off by one", "lineNumber": 2,'
                                 ' "suggestion": "fix", "reasoning": "because"}]}'),
               ("r2", "c.tf", 2, '{"issues": [{"severity": "critical", "category": "Logic", "message": "wrong"}]}'),
               ("r2", "gone.tf", 3, '{"issues": [{"severity": "low", "category": "Logic", "message": "not reviewed"}]}')]
    usage = [("r1", "claude-sonnet-4-x", 1000, 100)]
    return (
        spark.createDataFrame(files, "run_id string, file_no long, path string, content string, language string"),
        spark.createDataFrame(answers, "run_id string, path string, response_id long, response_text string"),
        spark.createDataFrame(usage, "run_id string, model string, input_tokens long, output_tokens long"),
        pricing.price_rows(),
    )


def test_review_run(spark):
    out = review.review_run(*fixture(spark))
    runs = {r.run_id: r for r in out["runs"].collect()}
    assert (runs["r1"].gate_status, runs["r1"].status, runs["r1"].files_reviewed) == ("fail", "failure", 2)
    assert runs["r1"].cost_usd == 0.0045 and runs["r1"].total_tokens == 1100
    # The skipped empty file counts as reviewed; the critical model finding fails the gate.
    assert (runs["r2"].gate_status, runs["r2"].files_reviewed, runs["r2"].total_issues) == ("fail", 2, 1)
    assert (runs["r3"].gate_status, runs["r3"].status, runs["r3"].total_issues, runs["r3"].cost_usd) == ("pass", "success", 0, 0.0)
    merged = [r for r in out["merged"].collect() if r.path == "a.py"]
    line_two = [r for r in merged if r.line_number == 2]
    assert any(r.suggestion.endswith("\n\nAI Analysis: because") for r in line_two)
    counts = {(r.path): (r.validation_count, r.llm_count) for r in out["files"].collect()}
    assert counts["c.tf"] == (0, 1) and counts["e.tf"] == (0, 0) and "d.tf" not in counts
    records = review.training_records(out["runs"]).withColumn("ingest_seq", F.lit(1))
    assert sinks.insert_first(records.where("run_id = 'r1'"), records).count() == 2


def test_review_does_not_depend_on_partitioning(spark):
    files, answers, usage, prices = fixture(spark)
    one = review.review_runs(files.repartition(1), answers.repartition(1), usage, prices).orderBy("run_id").collect()
    many = review.review_runs(files.repartition(8), answers.repartition(7), usage, prices).orderBy("run_id").collect()
    assert one == many


def test_markdown(spark):
    files = spark.createDataFrame([("r", 1, "a.py", "python"), ("r", 2, "b.py", "python")], "run_id string, file_no long, path string, language string")
    found = spark.createDataFrame([("r", 1, "a.py", 1, "high", "security", "bad", "do", 3), ("r", 1, "a.py", 2, "info", "x", "hm", "", None)],
                                  "run_id string, file_no long, path string, ordinal long, severity string, category string, message string, suggestion string, line_number int")
    scored = scoring.file_score(files, found).join(files.select("path", "file_no"), "path")
    summary = scoring.batch_summary(scored).withColumns({"ts": F.lit("T"), "duration_ms": F.lit(5)})
    strengths = spark.createDataFrame([("r", 2, 0, "clear")], "run_id string, file_no long, pos int, note string")
    order = ["section", "file_no", "block", "item", "line_no"]
    lines = [r.line for r in reports.report_markdown(summary, scored, found, strengths).orderBy(*order).collect()]
    body = lines[lines.index("### a.py"):]
    assert body == [
        "### a.py", "", "**Language:** python | **Score:** 83/100 | **Issues:** 2", "", "#### Issues", "",
        "- 🟠 **HIGH** (security): bad", "  - Line: 3", "  - Fix: do", "- ℹ️ **INFO** (x): hm", "",
        "### b.py", "", "**Language:** python | **Score:** 100/100 | **Issues:** 0", "", "#### Strengths", "", "- ✅ clear", "",
        "---", "*Generated by reviewlake*"]
    cli = [r.line for r in reports.report_markdown_cli(summary, scored, found).orderBy(*order).collect()]
    assert "### b.py" not in cli and "- 🔵 **INFO**: hm" in cli and "**Status:** ✅ PASSED" in cli


def test_prompts(spark):
    files = spark.createDataFrame([("r", 30, "a.py", "x = {persona}", "python", None), ("r", 10, "b.zz", "y", None, "+1")],
                                  "run_id string, file_no long, path string, content string, language string, diff string")
    text = prompts.render_prompts(files.where("file_no = 30"), "quality").first().prompt
    assert text.startswith("You are an expert Python engineer") and "**QUALITY ANALYSIS** of `a.py`" in text
    assert "```python\nx = {persona}\n```" in text
    editor = prompts.render_editor_prompts(files.where("file_no = 30")).first().prompt
    assert "Analyze the following Python code" in editor and "```python\nx" in editor
    batch = "".join(r.segment for r in prompts.render_batch_prompts(files).orderBy("seq").collect())
    assert batch.index("=== FILE 1: b.zz (text) ===") < batch.index("=== FILE 2: a.py (python) ===")
    assert "CHANGED LINES (from git diff):\n+1" in batch and batch.endswith("no markdown blocks")


class _Session:
    """Just enough of a session to see which folder is chosen."""

    def __init__(self, named, master):
        self.conf, self.sparkContext = {"spark.checkpoint.dir": named} if named else {}, self
        self.master, self.chosen = master, None

    def getCheckpointDir(self):
        return self.chosen

    def setCheckpointDir(self, path):
        self.chosen = path


def test_checkpoint_dir_comes_from_the_session():
    named = _Session("hdfs://shared/x", "yarn")
    assert session.shared_dir(named) == "hdfs://shared/x" == named.chosen
    assert "reviewlake-" in session.shared_dir(_Session(None, "local[2]"))
    with pytest.raises(RuntimeError):
        session.shared_dir(_Session(None, "yarn"))
