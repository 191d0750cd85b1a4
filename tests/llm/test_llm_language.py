import zlib

import numpy as np
from edge_rows import LONG, TEXTS
from pyspark.sql import functions as F

from reviewlake.llm import language_kernel as lk
from reviewlake.llm import queries


def test_held_out_accuracy(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.01")
    rows = queries.QUERIES["op6_language_id"](spark, big).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{big}/documents.parquet").collect()}
    assert len(rows) == len(lang)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.98 * len(held)


def test_folded_weights_equal_the_kernel_machine():
    """One weight per n-gram and language gives the same values as kernel values times dual coefficients."""
    texts = ["the cat sat on the mat", "le chat est sur le tapis", "the dog is in the house", "la maison est dans la rue"]
    labels, maps = ["en", "fr", "en", "fr"], []
    for t in texts:
        seen = np.zeros(lk._SPACE, bool)
        lk.present(t, seen)
        maps.append(seen)
    model = lk.fit([np.packbits(m).tobytes() for m in maps], labels, [True, True, True, False])
    kernel = lambda a, b: (a & b).sum() / np.sqrt(a.sum() * b.sum())
    vocabulary = np.any(maps[:3], axis=0)
    x = [m & vocabulary for m in maps]
    across = np.array([[kernel(a, b) for b in x[:3]] for a in x])
    within = across[:3]
    y = np.array([[1, -1], [-1, 1], [1, -1], [-1, 1]], float)
    normal = across.T @ across + lk.RIDGE * within + 1e-8 * np.trace(within) / 3 * np.eye(3)
    want = across @ np.linalg.solve(normal, across.T @ y)
    got = []
    for t in texts:
        seen = np.zeros(len(model.weights) + 1, bool)
        lk.present(t, seen, model.table)
        got.append(seen[:-1].astype(float) @ model.weights / np.sqrt(seen[:-1].sum()))
    assert np.allclose(got, want, atol=1e-5)


def test_pieces_see_the_same_grams(monkeypatch):
    text = LONG[:5000] + " straße über"
    whole, cut = np.zeros(lk._SPACE, bool), np.zeros(lk._SPACE, bool)
    lk.present(text, whole)
    monkeypatch.setattr(lk, "PIECE_CHARS", 701)
    lk.present(text, cut)
    assert (whole & ~cut).sum() == 0


def test_edge_rows(edge, nothing):
    model = lk.learn(edge, ~lk.held_out())
    assert set(model.languages) <= {"en", "de", "fr"}
    rows = lk.predict(edge, model).collect()
    assert len(rows) == len(TEXTS)
    for r in rows:
        if not any(c.isalpha() for c in r.text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in model.languages
    kept = lk.accepted(edge, model)
    assert kept.count() == 7 and kept.columns == edge.columns
    empty = lk.learn(nothing, F.lit(True))
    assert empty.languages == [] and lk.predict(nothing, empty).count() == 0
    assert {r.lang_pred for r in lk.predict(edge, empty).collect()} == {"und"}


def test_clean_documents_stay(spark, sf_dir):
    """Every document with a letter stays, whatever its score; texts without one go."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = lk.learn(docs, ~lk.held_out())
    junk = spark.createDataFrame([(-3, "12 34 !?", None), (-4, None, None)], docs.schema)
    kept = {r.doc_id for r in lk.accepted(docs.union(junk), model).collect()}
    assert kept == {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}


def test_many_languages_share_the_sample(spark, monkeypatch):
    """More languages than the sample was made for: each is learned, from fewer texts."""
    monkeypatch.setattr(lk, "TRAIN_TEXTS", 20)
    rows = [(i * 100 + k, f"{chr(97 + i)}{chr(98 + i)} " * (k + 2), f"l{i:02}") for i in range(18) for k in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = lk.learn(docs, F.lit(True))
    assert len(model.languages) == 18
    found = lk.predict(docs, model).collect()
    assert sum(r.lang_pred == r.lang for r in found) >= 0.9 * len(found)


def test_driver_gets_the_vocabulary_only(spark, monkeypatch):
    """What goes to the driver is one bit per chosen n-gram and text; the model is that of the whole sets."""
    monkeypatch.setattr(lk, "VOCABULARY", 300)
    words = ["alpha", "beta", "straße", "naïve", "delta", "gamma", "o'neil", "tapis", "dans", "the"]
    rows = [(i, " ".join(words[(i * k + k) % 10] + str(k) * (i % 3) for k in range(1, 9)), f"l{i % 3}") for i in range(60)]
    rows += [(7, "the same id, another text", "l1"), (7, "the same id, a third text", "l1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got, fit = [], lk.fit
    monkeypatch.setattr(lk, "fit", lambda *a: got.append(a) or fit(*a))
    model = lk.learn(docs, F.lit(True))
    assert len(got[0][0]) == len(rows) and max(map(len, got[0][0])) <= 38
    hashed = docs.select(F.xxhash64(F.col("doc_id").cast("string")).alias("at"), "lang", "text").collect()
    whole = []
    for at, label, text in hashed:
        seen = np.zeros(lk._SPACE, bool)
        lk.present(text, seen)
        whole.append((at, label, np.packbits(seen).tobytes()))
    whole.sort()
    met = {}
    marks = [met.setdefault(label, []).append(0) or len(met[label]) <= lk.LANDMARKS_PER_LANGUAGE for _, label, _ in whole]
    want = fit([b for _, _, b in whole], [label for _, label, _ in whole], marks)
    assert model.languages == want.languages and (model.table == want.table).all()
    assert np.allclose(model.weights, want.weights, atol=1e-6)
