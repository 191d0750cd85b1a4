import re

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import entropy_mix, queries


def shares(sizes, most=3.0):
    """Targets by the letter: share by weight, cut, share the excess again."""
    names = sorted((n for n in sizes if n is not None)) + [n for n in sizes if n is None]
    weight = {n: (5, 2, 1)[i % 3] for i, n in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [n for n in names if n not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[n] for n in free)
        over = [n for n in free if weight[n] * level > most * sizes[n]]
        if not over:
            return fixed | {n: weight[n] * level for n in free}
        fixed |= {n: most * sizes[n] for n in over}


def check(rows, docs):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, text, _, source in docs:
        sizes[source] = sizes.get(source, 0) + count(text)
    want, taken = shares(sizes), dict.fromkeys(sizes, 0)
    for r in rows:
        assert 0 <= r.taken <= 3 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(want[r.source])
        taken[r.source] += r.taken
    return want, taken


def test_targets_are_met(spark, sf_dir, documents):
    source = {d[0]: d[3] for d in documents}
    rows = queries.QUERIES["op1_mix_sources"](spark, sf_dir)
    assert rows.columns == ["doc_id", "size", "source_size", "target", "taken"]
    rows = [r for r in rows.withColumn("source", F.element_at(F.create_map(
        *[F.lit(x) for kv in source.items() for x in kv]), F.col("doc_id"))).collect()]
    want, taken = check(rows, documents)
    assert len(rows) == len(documents)
    for s, t in want.items():
        assert taken[s] == pytest.approx(t, rel=0.15)
    again = queries.QUERIES["op1_mix_sources"](spark, sf_dir)
    assert {(r.doc_id, r.taken) for r in rows} == {(r.doc_id, r.taken) for r in again.collect()}


def test_edge_rows(edge, nothing):
    add = lambda d: entropy_mix.mixed(d, F.col("source"), entropy_mix.words_in(F.col("text")), F.col("doc_id"))
    rows = add(edge).withColumn("size", entropy_mix.words_in(F.col("text"))).withColumn("taken", F.col("size") * F.col("copies"))
    rows = rows.collect()
    assert len(rows) == 12 and rows[0].private == "x"
    check(rows, [(r.doc_id, r.text, r.lang, r.source) for r in edge.collect()])
    assert len({r.copies for r in rows if r.doc_id == 6}) == 1
    assert add(nothing).count() == 0


def test_two_margins(spark, monkeypatch):
    """Rates over two constraints at once equal iterative fitting (to fewer digits here, as each sweep is a job)."""
    monkeypatch.setattr(entropy_mix, "TOLERANCE", 1e-3)
    cells = spark.createDataFrame([("a", "x", 10.0), ("a", "y", 30.0), ("b", "x", 40.0), ("b", "y", 20.0)], "s string, l string, n double")
    goal = lambda d: spark.createDataFrame(list(d.items()), "value string, target double")
    rows = entropy_mix.tilted_rates(cells, "n", {"s": goal({"a": 70.0, "b": 30.0}), "l": goal({"x": 60.0, "y": 40.0})}).collect()
    total = lambda c, v: sum(r.n * r.rate for r in rows if r[c] == v)
    assert [total("s", "a"), total("s", "b"), total("l", "x"), total("l", "y")] == pytest.approx([70, 30, 60, 40], rel=1e-2)
    rate = {(r.s, r.l): r.rate for r in rows}
    assert rate["a", "x"] * rate["b", "y"] == pytest.approx(rate["a", "y"] * rate["b", "x"], rel=1e-6)
