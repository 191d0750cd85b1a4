import re
import sys

from edge_rows import SCHEMA, TEXTS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from reviewlake.llm import queries
from test_llm_dedup import brute

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def stages(spark, docs, sf_dir):
    """Result of each stage, the last included."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir).cache()
        out.append((name, docs))
    return dict(out)


def test_stages_against_plain_python(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = stages(spark, docs, sf_dir)
    assert list(out) == ["language", "near_duplicates", "personal_data", "mix", "tokens"]
    assert all(out[name].columns == COLUMNS for name in list(out)[:-1])
    texts = {r.doc_id: r.text for r in docs.collect()}
    letters = {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert {r.doc_id for r in out["language"].collect()} == letters
    groups = brute([(i, texts[i]) for i in letters], 80)
    kept = {i for i, (_, component) in groups.items() if component == i}
    assert sorted(r.doc_id for r in out["near_duplicates"].collect()) == sorted(kept)
    private = {r.doc_id: r.text for r in out["personal_data"].collect()}
    assert set(private) == kept
    mail = re.compile(r"[\w.]+@[\w.]+\w")
    for i, t in private.items():
        assert not set(mail.findall(texts[i])) & set(mail.findall(t))
        assert re.search(r"[\d@]", texts[i]) or t == texts[i]
    times = {}
    for r in out["mix"].collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
        assert r.text == private[r.doc_id]
    assert max(times.values()) <= 3 and set(times) <= kept
    library = Tokenizer.from_file(queries.TOKENIZER)
    library.no_truncation()
    library.no_padding()
    rows = out["tokens"].collect()
    assert len(rows) == sum(times.values())
    for r in rows:
        assert list(r.ids) == library.encode(private[r.doc_id], add_special_tokens=False).ids and r.n_tokens == len(r.ids)


def test_run_is_the_stages_in_order(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    want = stages(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)["tokens"]
    key = lambda r: (r.doc_id, r.n_tokens)
    assert sorted(map(key, got.collect())) == sorted(map(key, want.collect()))


def test_edge_rows(spark, sf_dir):
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in TEXTS], SCHEMA + ", n_chars long")
    out = stages(spark, docs, sf_dir)
    assert sorted(r.doc_id or 0 for r in out["near_duplicates"].collect()) == [0, 1, 6, 7, 8]
    empty = stages(spark, docs.where(F.lit(False)), sf_dir)
    assert all(df.count() == 0 for df in empty.values())


def test_entry_works_without_the_subpackage(monkeypatch):
    import __spark_entry__ as entry
    assert {"pipeline", *queries.QUERIES} <= set(entry.queries())
    with monkeypatch.context() as m:
        m.setitem(sys.modules, "reviewlake.llm", None)  # as if it could not be imported
        assert not {"pipeline", *queries.QUERIES} & set(entry.queries()) and "op8_warc" not in entry.oracle_sql()
        assert "review_run" in entry.queries()
    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert set(queries.QUERIES) <= set(entry.queries()) and "pipeline" not in entry.queries()
