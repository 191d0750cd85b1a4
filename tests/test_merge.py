"""The greedy merge and the similarity join against plain-Python restatements."""

import random
import re
import time
import zlib

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from reviewlake.functions.similarity import BUCKETS, KEYWORDS, bucket
from reviewlake.operators import holders
from reviewlake.operators.holders import FirstHolders, rarest_first
from reviewlake.operators.merge import assignments, merge_batch_findings, merge_findings, merge_findings_tagged, similar_links

FIELDS = "run_id string, path string, ordinal long, severity string, category string, message string, " \
         "line_number int, suggestion string"
WORDS = ["account", "small", "ring", "Schema", "is", "wrong", "near", "value", "of", "table"]


def similar(a, b):
    if a["line_number"] and a["line_number"] == b["line_number"]:
        return True
    x, y = a["message"].lower(), b["message"].lower()
    if any(k in x and k in y for k in KEYWORDS):
        return True
    u, v = set(x.split(" ")), set(y.split(" "))
    return a["category"] == b["category"] and len(u & v) / max(len(u), len(v)) > 0.6


def greedy(rules, models):
    merged = [dict(r, reasoning=None, tag="internal", ui=r["suggestion"]) for r in rules]
    for m in models:
        hit = next((x for x in merged if similar(x, m)), None)
        if hit is None:
            ui = m["suggestion"] + (f"\n\nReasoning: {m['reasoning']}" if m["reasoning"] else "")
            merged.append(dict(m, tag="external", ui=ui))
            continue
        hit["tag"] = "both"
        if m["reasoning"]:
            hit["reasoning"] = m["reasoning"]
            hit["suggestion"] += f"\n\nAI Analysis: {m['reasoning']}"
            hit["ui"] += f"\n\nAI Analysis: {m['reasoning']}"
    return merged


def make(seed, files, most):
    rnd = random.Random(seed)
    rules, models = [], []
    for f in range(files):
        for n, rows in ((rnd.randrange(4), rules), (rnd.randrange(most), models)):
            for i in range(n):
                row = dict(
                    run_id="r", path=f"f{f}", ordinal=i * 3 + 1, severity="low", category=rnd.choice(["a", "b", "A"]),
                    message=" ".join(rnd.choice(WORDS) for _ in range(rnd.randrange(1, 5))),
                    line_number=rnd.choice([None, 0, *range(1, 12)]), suggestion=f"s{i}",
                )
                if rows is models:
                    row["reasoning"] = rnd.choice([None, "", f"why{i}"])
                rows.append(row)
    return rules, models


def frames(spark, rules, models):
    names = [c.split()[0] for c in FIELDS.split(", ")]
    r = spark.createDataFrame([[x[n] for n in names] for x in rules], FIELDS)
    m = spark.createDataFrame([[x[n] for n in [*names, "reasoning"]] for x in models], FIELDS + ", reasoning string")
    return r, m


def expected(rules, models):
    out = {}
    for path in {x["path"] for x in rules + models}:
        out[path] = greedy([x for x in rules if x["path"] == path], [x for x in models if x["path"] == path])
    return out


@pytest.fixture(params=[10_000, 5])
def batch_rows(spark, request):
    """Rows per Arrow batch: files end inside batches, or span many."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(request.param))
    yield
    spark.conf.set(name, before)


def test_merge_equals_greedy(spark, batch_rows):
    rules, models = make(1, 40, 25)
    r, m = frames(spark, rules, models)
    want = expected(rules, models)
    parts = {}
    for row in merge_findings(r, m).orderBy("path", "target_model", "ordinal").collect():
        place = parts.setdefault(row.path, {}).setdefault((row.target_model, row.ordinal), [])
        place.append(row)
    for path, rows in want.items():
        got = [
            (p[0].message, "".join(x.suggestion for x in p), [x.reasoning for x in p if x.reasoning][-1:] or [p[0].reasoning])
            for _, p in sorted(parts[path].items())
        ] if rows else []
        assert got == [(w["message"], w["suggestion"], [w["reasoning"]]) for w in rows], path


def test_tagged_variant(spark):
    rules, models = make(2, 30, 10)
    r, m = frames(spark, rules, models)
    got = {}
    for row in merge_findings_tagged(r, m).orderBy("path", "target_model", "ordinal").collect():
        got.setdefault(row.path, []).append((row.message, row.suggestion, row.validation_source))
    for path, rows in expected(rules, models).items():
        assert got.get(path, []) == [(w["message"], w["ui"], w["tag"]) for w in rows]


def test_batch_variant(spark):
    rules, models = make(3, 30, 12)
    r, m = frames(spark, rules, models)
    files = r.select("run_id", "path").union(m.select("run_id", "path")).where("path <> 'f3'")
    got = {}
    for row in merge_batch_findings(r, m, files).orderBy("path", "is_model", "ordinal").collect():
        got.setdefault(row.path, []).append((row.message, row.reasoning, row.source))
    for path in {x["path"] for x in rules + models}:
        merged = [dict(x, reasoning=None, source="pattern") for x in rules if x["path"] == path]
        for x in models:
            if x["path"] != path or path == "f3":
                continue
            hit = next((y for y in merged if y["line_number"] == x["line_number"]
                        and y["category"].lower() == x["category"].lower()), None)
            if hit is None:
                merged.append(dict(x, source="ai"))
            else:
                hit["source"] = "both"
                hit["reasoning"] = x["reasoning"] or hit["reasoning"]
        assert got.get(path, []) == [(w["message"], w["reasoning"], w["source"]) for w in merged], path


def test_unlike_findings_of_one_file(spark):
    """10,000 findings without a common word, then their copies: linear, and the copies attach to the first ones."""
    rows = [dict(run_id="r", path="big", ordinal=i, severity="low", category="a", message=f"alpha{i % 10_000} beta{i % 10_000}", line_number=None,
                 suggestion="s", reasoning="why") for i in range(20_000)]
    r, m = frames(spark, [], rows)
    start = time.perf_counter()
    found = merge_findings(r, m).groupBy("merged_count").count().collect()
    assert [tuple(x) for x in found] == [(1, 10_000)]
    assert time.perf_counter() - start < 30


def test_first_holders_against_a_scan():
    rng = random.Random(7)
    for _ in range(300):
        known, index, order = [], FirstHolders(), {w: rng.random() for w in WORDS}
        for i in range(rng.randrange(1, 40)):
            words = sorted({rng.choice(WORDS) for _ in range(rng.randrange(1, 7))}, key=order.get)
            x = (rng.choice([0, 0, 1, 2, 3]), rng.choice([0, 0, 1, 2, 5]), rng.choice(["a", "b", None]), words)
            want = next((k for k, y in enumerate(known) if (x[0] and x[0] == y[0]) or x[1] & y[1] or (
                x[2] == y[2] and len({*x[3]} & {*y[3]}) / max(len(x[3]), len(y[3])) > 0.6)), None)
            assert index.first(*x) == (None if want is None else (1, want))
            if want is None or rng.random() < 0.3:
                index.add((1, len(known)), *x)
                known.append(x)


def test_similar_links(spark):
    """Link counts and classes equal those of all pairs, also in a file where one line and one keyword link most findings."""
    rules, models = make(4, 25, 30)
    models += [dict(models[0], path="hot", ordinal=i, message=f"count of {i % 7}", line_number=i % 3, category="a") for i in range(200)]
    r, m = frames(spark, rules, models)
    rows = [(0, x) for x in rules] + [(1, x) for x in models]
    found = {(x.path, x.kind, x.ordinal): x for x in similar_links(r, m).collect()}
    assert len(found) == len(rows)
    for kind, x in rows:
        others = [y for k, y in rows if y["path"] == x["path"] and (k, y["ordinal"]) != (kind, x["ordinal"]) and similar(x, y)]
        got = found[x["path"], kind, x["ordinal"]]
        assert got.links == len(others), x
        head = next(y for k, y in rows if (y["path"], k, y["ordinal"]) == (x["path"], got.class_kind, got.class_ordinal))
        assert (head["line_number"] or 0, set(head["message"].lower().split(" "))) == (x["line_number"] or 0, set(x["message"].lower().split(" ")))


def test_features_are_computed_once(spark):
    """Once for the rule findings and once for the model findings in each plan, also below a join's test for NULL."""
    r, m = frames(spark, *make(5, 5, 8))

    def plan(df):
        return df._jdf.queryExecution().optimizedPlan().toString()

    assert plan(assignments(r, m)).count("array_distinct(") == 2
    assert plan(similar_links(r, m)).count("sha2(") == 2


def test_merge_of_blanks_and_nulls(spark):
    """Messages of blanks, with words between odd spaces, and without text or category."""
    said = ["", " ", "a\u00a0b", "a b", " a  b ", "A B", None, "a b c"]
    rows = [dict(run_id="r", path="p", ordinal=i, severity="low", category=c, message=x, line_number=None, suggestion="s", reasoning=f"w{i}")
            for i, (x, c) in enumerate((x, c) for x in said for c in ("k", None, "-"))]
    r, m = frames(spark, [], rows)
    got = {x.ordinal: x.target for x in assignments(r, m).collect()}
    words = [set(re.split("[\\s\u00a0]+", (x["message"] or "").lower())) for x in rows]
    heads = []
    for i, x in enumerate(rows):
        hit = next((h for h in heads if rows[h]["category"] == x["category"]
                    and len(words[h] & words[i]) / max(len(words[h]), len(words[i])) > 0.6), None)
        if hit is None:
            heads.append(i)
        assert got[i] == (i if hit is None else hit), x


def test_merge_scans_the_findings_once(spark):
    """The plan holds each side's findings once for the pass; findings do not meet their targets in a join."""
    r, m = frames(spark, *make(5, 5, 8))
    plan = merge_findings(r, m)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    assert plan.count("array_distinct(") == 2


def test_repeated_ordinals(spark, batch_rows):
    """Where an ordinal repeats, each of its rows goes wherever one of them goes; findings without a file are left out."""
    base = dict(run_id="r", path="p", severity="low", category="a", line_number=None, suggestion="s")
    models = [dict(base, ordinal=1, message="red ring", reasoning="x"), dict(base, ordinal=2, message="red ring", reasoning="y"),
              dict(base, ordinal=2, message="red ring", reasoning="y"), dict(base, ordinal=2, message="red ring", reasoning="z"),
              dict(base, ordinal=3, message="blue bolt", reasoning="w"), dict(base, ordinal=5, message="red ring", reasoning="v"),
              dict(base, ordinal=5, message="blue bolt", reasoning="u"), dict(base, ordinal=1, path=None, message="red ring", reasoning="t")]
    r, m = frames(spark, [], models)
    got = {x.ordinal: (x.merged_count, x.suggestion.split("\n\nAI Analysis: ")) for x in merge_findings(r, m).collect()}
    assert got == {1: (11, ["s", *"yyyyyyzzz", *"uv"]), 3: (2, ["s", "u", "v"])}


def test_word_buckets_agree(spark):
    """Tasks and Spark find the same bucket for a word."""
    words = ["", "ring", "größe", " ", "数", "a'b"]
    found = spark.createDataFrame([(w,) for w in words], "w string").select(bucket(F.col("w"))).collect()
    assert [x[0] for x in found] == [zlib.crc32(w.encode()) % BUCKETS for w in words]
    rarity = bytes(BUCKETS - 1) + b"\x01"
    assert rarest_first("b a", rarity) == ["a", "b"]


def test_small_batches_are_put_together(monkeypatch):
    """Batches of a few rows, as a session may set them, make few larger ones; rows of one finding stay together."""
    rows = pa.RecordBatch.from_pydict({"k": [i // 3 for i in range(1000)], "x": [str(i) for i in range(1000)]})
    small = [rows.slice(i, 7) for i in range(0, 1000, 7)]
    assert [b.num_rows for b in holders.whole_findings(iter(small), ["k"])] == [1000]
    monkeypatch.setattr(holders, "ROWS_AT_ONCE", 100)
    cut = list(holders.whole_findings(iter([rows.slice(0, 0), *small]), ["k"]))
    assert 8 <= len(cut) <= 12 and pa.Table.from_batches(cut).to_pylist() == rows.to_pylist()
    assert all(a["k"][-1].as_py() < b["k"][0].as_py() for a, b in zip(cut, cut[1:]))
    monkeypatch.setattr(holders, "BYTES_AT_ONCE", 1)
    cut = list(holders.whole_findings(iter(small), ["k"]))
    assert len(cut) > 100 and pa.Table.from_batches(cut).to_pylist() == rows.to_pylist()
    assert all(a["k"][-1].as_py() < b["k"][0].as_py() for a, b in zip(cut, cut[1:]))


def test_places_of_words_are_bounded(monkeypatch):
    monkeypatch.setattr(holders, "REMEMBERED", 5)
    rng, rarity = random.Random(9), bytes(range(256))
    places = holders.Places(rarity)
    for _ in range(200):
        words = [f"w{rng.randint(0, 30)}" for _ in range(4)]
        assert places.rarest_first(" ".join(words)) == sorted(words, key=lambda w: (rarity[zlib.crc32(w.encode()) % 256], w))
        assert len(places) <= 5
