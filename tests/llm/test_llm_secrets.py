import hashlib
import re

from edge_rows import TEXTS

from reviewlake.llm import queries, secret_ledger
from reviewlake.session import scratch_path

BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def base_spans(text):
    found = [(m.start(), n, m.end(), kind) for n, (kind, (p, group, least)) in enumerate(BASE.items())
             for m in p.finditer(text) if len(m.group(group)) >= least]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def report(spark, docs, ledger):
    rows = secret_ledger.report(docs, ledger).select("doc_id", secret_ledger.joined("spans").alias("s")).collect()
    return sorted((r.doc_id, r.s) for r in rows)


def test_query(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    documents = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text").collect()
    rows = {r.doc_id: r for r in queries.QUERIES["op7_secrets"](spark, big).collect()}
    assert len(rows) == len(documents)
    for i, text in documents:
        want = base_spans(text or "")
        r = rows[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w.startswith(k) for w in want) for k in BASE)
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(r.spans.split(","))
    assert any(r.spans for r in rows.values())


def test_hard_texts(spark):
    texts = ["secret: token: abcdefgh", "PassWord = 'abc' password='abcdef'", "😀 é token=ABCDEF AKIA" + "Q" * 20, "api_key=abcde apikey:abcdefg",
             "0" * 23 + "g" + "a" * 24 + "F" + "b" * 30, "tokentoken=abcdefgh", "secret==abcdef", "AKIAAKIA" + "1" * 11 + " AKIA" + "2" * 15,
             "token=" + "a" * 5 + " passwd:" + "9" * 30, "x" * 1000 + " token=zzzzzz" * 3000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    ledger = scratch_path(spark, "ledger")
    secret_ledger.create_ledger(spark, ledger)
    assert secret_ledger.scan(docs, ledger) == len(texts)
    base = lambda s: ",".join(x for x in s.split(",") if x.split(":")[0] in BASE)
    assert [base(s) for _, s in report(spark, docs, ledger)] == [",".join(base_spans(t)) for t in texts]


def test_only_unseen_pairs_are_scanned(spark):
    docs = lambda *t: spark.createDataFrame(list(enumerate(t)), "doc_id long, text string")
    ledger = scratch_path(spark, "ledger")
    secret_ledger.create_ledger(spark, ledger)
    first = docs("token=abcdef", "clean", "clean", "ghp_" + "Z" * 36)
    assert secret_ledger.scan(first, ledger) == 3
    before = report(spark, first, ledger)
    assert before == [(0, "assign:0:12"), (1, ""), (2, ""), (3, "github:0:40")]
    assert secret_ledger.scan(first, ledger) == 0
    assert secret_ledger.scan(docs("clean", "token=abcdef", "new text"), ledger) == 1
    assert report(spark, first, ledger) == before
    newer = tuple(secret_ledger.Rule("assign", 2, "token=[a-z]+", 0, 0, "token") if r.kind == "assign" else r for r in secret_ledger.RULES)
    todo = secret_ledger.unseen(first, ledger, "text", newer).collect()
    assert {tuple(r.kinds) for r in todo} == {("assign",)} and len(todo) == 3


def test_edge_rows(spark, edge, nothing):
    ledger = scratch_path(spark, "ledger")
    secret_ledger.create_ledger(spark, ledger)
    assert secret_ledger.scan(edge, ledger) == 8
    rows = secret_ledger.report(edge, ledger).collect()
    assert len(rows) == len(TEXTS) and all(list(r.spans) == [] for r in rows)
    assert len({r.blob for r in rows if r.doc_id in (3, 4)}) == 1
    assert secret_ledger.scan(nothing, ledger) == 0 and secret_ledger.report(nothing, ledger).count() == 0
