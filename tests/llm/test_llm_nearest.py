import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from reviewlake.llm import prefix_forest, queries


def brute(rows, k, is_query):
    out = {}
    for q, v in rows:
        if is_query(q):
            scores = [(-sum(float(a) * float(b) for a, b in zip(v, w)), i) for i, w in rows if i != q]
            out[q] = [(i, -s) for s, i in sorted(scores)[:k]]
    return out


def collected(df):
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    return got


def test_query(spark, sf_dir):
    big = sf_dir.replace("sf0.001", "sf0.1")
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{big}/embeddings.parquet").collect()]
    got = collected(queries.QUERIES["op5_nearest"](spark, big))
    ids, matrix = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    assert sorted(got) == sorted(i for i, _ in rows if i % 20 == 0)
    hits = 0
    for q, found in got.items():
        scores = matrix @ matrix[ids == q][0]
        scores[ids == q] = -np.inf
        order = np.lexsort((ids, -scores))[:20]
        hits += len({i for i, _ in found} & set(ids[order].tolist()))
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert np.allclose([s for _, s in found], [scores[ids == i][0] for i, _ in found], atol=1e-12)
    assert hits >= 0.9 * 20 * len(got)


def test_few_candidates_still_find_most(spark):
    """With fewer candidates than rows and several segments, clustered neighbours are found."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(150, 24))
    points = (np.repeat(centres, 20, 0) + 0.15 * rng.normal(size=(3000, 24))).astype(np.float32) * rng.uniform(0.8, 1.2, (3000, 1)).astype(np.float32)
    table = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(points)], "vec_id long, embedding array<float>")
    got = collected(prefix_forest.search(table, F.col("vec_id") % 20 == 0, k=10, candidates=1500))
    exact = points.astype(np.float64) @ points.astype(np.float64).T
    np.fill_diagonal(exact, -np.inf)
    hits = sum(len({i for i, _ in got[q]} & set(np.argsort(-exact[q])[:10].tolist())) for q in range(0, 3000, 20))
    assert hits >= 0.9 * 150 * 10


def test_edge_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (20, [1.0, 2.0]), (40, None), (60, [0.0, 0.0]), (80, [1.0, None]), (100, [nan, 1.0]), (120, [inf, 1.0]),
            (140, []), (160, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (3, [-1.0, 0.5]), (4, [2.0, -0.0]), (5, [2.0, 0.0]), (5, [2.0, 0.0]), (180, [0.1, 0.1])]
    rows += [(200 + k, [3.0, 3.0]) for k in range(40)]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, key string, class int")
    good = sorted({(i, tuple(np.float32(x) for x in v)) for i, v in rows if i is not None and v and len(v) == 2
                   and None not in v and all(np.isfinite(v)) and any(v)})
    want = brute(good, 20, lambda i: i % 20 == 0)
    assert collected(prefix_forest.search(table, F.col("vec_id") % 20 == 0)) == want
    assert set(want) == {0, 20, 180, 200, 220}
    few = table.where("vec_id < 10")
    got = collected(prefix_forest.search(few, F.col("vec_id") == 0))
    assert [i for i, _ in got[0]] == [4, 5, 3]
    assert prefix_forest.search(table.where("false"), F.lit(True)).count() == 0


def spread(tmp_path, n, width):
    """Vectors evenly spread over the sphere, in a file."""
    points = np.random.default_rng(7).normal(size=(n, width)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    vectors = pa.FixedSizeListArray.from_arrays(pa.array(points.ravel()), width).cast(pa.list_(pa.float32()))
    pq.write_table(pa.table({"vec_id": pa.array(np.arange(n)), "embedding": vectors}), str(tmp_path / "spread.parquet"))
    return points.astype(np.float64), str(tmp_path / "spread.parquet")


def recall(points, got, k):
    hits = 0
    for q, found in got.items():
        scores = points @ points[q]
        scores[q] = -np.inf
        hits += len({i for i, _ in found} & set(np.argpartition(-scores, k)[:k].tolist()))
    return hits / (k * len(got))


def test_recall_holds_in_a_large_table(spark, tmp_path, monkeypatch):
    """Evenly spread vectors need more candidates the more rows there are; the forest finds them without meeting most rows."""
    held = {}
    keep = lambda df, name: held.setdefault(name, stored(df, name))
    stored = prefix_forest.stored
    monkeypatch.setattr(prefix_forest, "stored", keep)
    points, path = spread(tmp_path, 60_000, 64)
    got = collected(prefix_forest.search(spark.read.parquet(path), F.col("vec_id") % 600 == 0))
    assert len(got) == 100 and recall(points, got, 20) >= 0.9
    counts = {(r["class"], r.level): r.n for r in held["level-counts"].collect()}
    met = held["levels"].collect()
    assert len(met) == 100 and sum(r.level == 0 for r in met) < 5
    part = [r.ascended / prefix_forest.TREES for r in met]
    compared = [f * counts[r["class"], r.level] + (1 - f) * counts.get((r["class"], r.level + 1), 0) for r, f in zip(met, part)]
    assert sum(compared) < 0.5 * 60_000 * len(met)  # with repetitions


def test_doubles_keep_their_scores(spark):
    rows = [(i, [1.0 + i * (0.01 + 1e-12), 0.0]) for i in range(50)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert collected(prefix_forest.search(table, F.col("vec_id") % 20 == 0)) == brute(rows, 20, lambda i: i % 20 == 0)


def test_ascent_above_the_segments(spark, tmp_path, monkeypatch):
    """Queries leave their segment if it holds too few candidates, and segments with many queries are cut into parts."""
    monkeypatch.setattr(prefix_forest, "SEGMENT_ROWS", 128)
    points, path = spread(tmp_path, 4000, 12)
    for candidates, least in ((None, 0.9), (10_000, 1.0), (3000, 0.9)):
        got = collected(prefix_forest.search(spark.read.parquet(path), F.col("vec_id") % 10 == 0, candidates=candidates))
        assert len(got) == 400 and recall(points, got, 20) >= least
