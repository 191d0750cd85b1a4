import hashlib
import random

import numpy as np
import pytest
from edge_rows import TEXTS

from reviewlake.llm import cover_dedup, queries


def brute(docs, length=50):
    """Spans by keeping the set of all strings of smaller documents."""
    smaller, out = set(), []
    groups = {}
    for i, text in docs:
        groups.setdefault(i, []).append((text or "").encode())
    for i in sorted(groups, key=lambda i: (i is None, i)):
        new = set()
        for raw in groups[i]:
            gone = [False] * len(raw)
            for p in range(len(raw) - length + 1):
                piece = raw[p:p + length]
                new.add(piece)
                if piece in smaller:
                    gone[p:p + length] = [True] * length
            edges = [p for p in range(len(raw) + 1) if (p > 0 and gone[p - 1]) != (p < len(raw) and gone[p])]
            kept = bytes(b for b, g in zip(raw, gone) if not g)
            out.append((i, len(raw), list(zip(edges[::2], edges[1::2])), kept))
        smaller |= new
    return out


def collected(df):
    return [(r.doc_id, r.n_bytes, [(s.start, s.end) for s in r.spans], bytes(r.kept)) for r in df.collect()]


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)


def test_cover():
    assert {(a - b) % cover_dedup.PERIOD for a in cover_dedup.COVER for b in cover_dedup.COVER} == set(range(cover_dedup.PERIOD))


def test_packing():
    rng = np.random.default_rng(0)
    for values in ([], [0], [2 ** 63, 2 ** 64 - 1], rng.integers(0, 2 ** 60, 1000)):
        values = np.sort(np.asarray(values, np.uint64))
        assert (cover_dedup.unpack(cover_dedup.pack(values)) == values).all()


def test_query(spark, sf_dir, documents):
    rows = {r.doc_id: r for r in queries.QUERIES["op9_repeats"](spark, sf_dir).collect()}
    want = brute([d[:2] for d in documents])
    assert len(rows) == len(want) and any(spans for _, _, spans, _ in want)
    for i, n, spans, kept in want:
        r = rows[i]
        assert (r.n_bytes, r.n_spans, r.n_removed) == (n, len(spans), n - len(kept))
        assert r.kept_sha256 == hashlib.sha256(kept).hexdigest()


@pytest.mark.parametrize("block, bucket", [(2 << 20, 8 << 20), (700, 500)])
def test_random_passages(spark, monkeypatch, block, bucket):
    """Overlaps, chance matches over a tiny alphabet, repeated and null ids; also with many small blocks and buckets."""
    monkeypatch.setattr(cover_dedup, "BLOCK_BYTES", block)
    monkeypatch.setattr(cover_dedup, "SAMPLE_BUCKET_BYTES", bucket)
    monkeypatch.setattr(cover_dedup, "SUFFIX_BUCKET_BYTES", bucket)
    rng = random.Random(9)
    letters = lambda n, s: "".join(rng.choice(s) for _ in range(n))
    passages = [letters(rng.choice((49, 50, 51, 80, 200)), "abcé \n") for _ in range(6)] + ["ab" * 60, "z" * 130]
    docs = []
    for _ in range(90):
        parts = [p[rng.randint(0, 3):] if rng.random() < 0.6 else letters(rng.randint(0, 60), "abc") for p in rng.choices(passages, k=4)]
        docs.append((rng.choice((None, *range(60))), "".join(parts)))
    docs += [(70, passages[7]), (71, None), (72, ""), (73, passages[0][:49]), (74, passages[5])] * 2
    table = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, block int, first string").repartition(5)
    same(collected(cover_dedup.repeated_spans(table)), brute(docs))


def test_other_lengths(spark):
    docs = [(k, "abcdefghij" * 8 + str(k)) for k in range(4)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for length in (31, 77):
        same(collected(cover_dedup.repeated_spans(table, length=length)), brute(docs, length))
    with pytest.raises(ValueError):
        cover_dedup.repeated_spans(table, length=20)


def test_edge_rows(edge, nothing):
    rows = collected(cover_dedup.repeated_spans(edge))
    assert len(rows) == len(TEXTS)
    at = {r[0]: r for r in rows}
    assert at[2][2] == [(0, at[2][1])] and at[1][2] == [] and at[7][2] == [] and at[3][1] == at[4][1] == 0
    assert cover_dedup.repeated_spans(nothing).count() == 0
