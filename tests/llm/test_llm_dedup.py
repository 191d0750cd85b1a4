import random
import re

from edge_rows import TEXTS

from reviewlake.llm import minmax_dedup, queries

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def brute(docs, percent):
    """{id: (set size, smallest id reachable)} by comparing all pairs."""
    sets = {}
    for i, text in docs:
        words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().translate(LOWER))
        sets[i] = {tuple(words[k:k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1:]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    x, y = find(i), find(j)
                    root[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def family(rng, n, words):
    """An original and copies with up to six changed words."""
    vocabulary = [f"w{k}" for k in range(3000)]
    base = [rng.choice(vocabulary) for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for at in rng.sample(range(words), min(rng.randint(0, 6), words)):
            copy[at] = rng.choice(vocabulary)
        yield " ".join(copy)


def test_groups_against_all_pairs(spark):
    rng = random.Random(7)
    texts = [t for n, words in ((60, 150), (25, 80), (12, 40), (6, 9), (4, 4)) for t in family(rng, n, words)]
    texts += [" ".join(f"x{rng.randint(0, 10 ** 6)}" for _ in range(30)) for _ in range(40)] + texts[:15] + ["A b C d E f", "a B c D e F"]
    rng.shuffle(texts)
    docs = list(enumerate(texts))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    for percent in (80, 85):
        want = brute(docs, percent)
        got = minmax_dedup.near_duplicates(table, percent=percent).collect()
        assert len(got) == len(docs)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert len(set(want.values())) < len(docs)


def test_query(spark, sf_dir, documents):
    rows = queries.QUERIES["op3_near_duplicates"](spark, sf_dir)
    assert rows.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows.collect()} == brute([d[:2] for d in documents], 85)


def test_signature_estimates_similarity():
    import numpy as np
    rng = np.random.default_rng(1)
    shared, a, b = (minmax_dedup.mix64(rng.integers(0, 2 ** 63, n).astype(np.uint64)) for n in (800, 100, 100))
    x, y = (minmax_dedup.signature(np.unique(np.concatenate([shared, own]))) for own in (a, b))
    assert abs((x == y).mean() - 0.8) < 0.1


def test_bands_keep_the_promised_share():
    for percent in (70, 80, 85, 95):
        rows = minmax_dedup.rows_per_band(percent)
        bands, p = 2 * minmax_dedup.PERMUTATIONS // rows, (percent / 100) ** rows
        assert (1 - p) ** bands + bands * p * (1 - p) ** (bands - 1) < minmax_dedup.MISS


def test_components(spark):
    import pyspark.sql.functions as F
    rng = random.Random(4)
    edges = [(k, k + 1) for k in range(40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(45)]
    table = spark.createDataFrame(edges, "a long, b long")
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert {r.node: r.root for r in minmax_dedup.components(table).collect()} == root
    assert minmax_dedup.components(table.where(F.lit(False))).count() == 0


def test_edge_rows(edge, nothing):
    rows = minmax_dedup.near_duplicates(edge).collect()
    assert len(rows) == len(TEXTS)
    at = {r.doc_id: r for r in rows}
    assert at[2].component_id == 1 and not at[2].kept and at[1].kept
    assert all(at[i].n_shingles == 0 and at[i].kept and at[i].component_id == i for i in (3, 4, 5))
    assert at[6].n_shingles == 1 and sum(r.doc_id == 6 for r in rows) == 2
    assert at[7].n_shingles == 6
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert minmax_dedup.near_duplicates(nothing).count() == 0
    kept = minmax_dedup.one_of_each(edge)
    assert kept.columns == edge.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 3, 4, 5, 6, 7, 8, 9]
    assert minmax_dedup.one_of_each(nothing).count() == 0


def test_components_again_only_for_more_links(spark, monkeypatch):
    """Links to the heads of the buckets connect a pair; the components are not looked for a second time without others."""
    calls, found = [], minmax_dedup.components
    monkeypatch.setattr(minmax_dedup, "components", lambda edges: calls.append(1) or found(edges))
    words = [f"w{k}" for k in range(60)]
    docs = list(enumerate([" ".join(words), " ".join([*words, "end"]), "something else that nobody copies here"]))
    got = minmax_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), percent=85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(docs, 85)
    assert sorted(r.component_id for r in got) == [0, 0, 2] and len(calls) == 1


def test_more_links_extend_components(spark):
    rng = random.Random(5)
    edges = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)]
    table = lambda rows: spark.createDataFrame(rows, "a long, b long")
    rooted = lambda df: {r.node: r.root for r in df.collect()}
    want = rooted(minmax_dedup.components(table(edges)))
    first = minmax_dedup.components(table(edges[:180]))
    assert rooted(first) != want == rooted(minmax_dedup.extended(first, table(edges[180:])))
    assert rooted(minmax_dedup.extended(first, table([]))) == rooted(first)
