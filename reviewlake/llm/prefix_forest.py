"""Approximate nearest neighbours by a forest of hash prefixes.

Each of TREES trees gives every vector a string of HASH_BITS bits (signs of orthogonal projections) and keeps the strings
as a sorted array.  A query descends to its longest prefix matches by binary search, which gives the number of candidates
at each prefix length; then all trees ascend together, one bit at a time and one after another, until they hold enough candidates
between them.
So a query looks at many vectors where they are sparse and at short distances where they are dense.

How many are enough is measured, not assumed: SAMPLE_QUERIES queries are compared with every row, and the budget is the
smallest number of candidates with which the ascent finds the share RECALL of their true neighbours.  It grows with the table as
far as the vectors need it.  Many trees with long prefixes need fewer candidates than few trees with short ones; a tree
holds a vector in one byte a component, and the best candidates are compared again on the original vectors.  A query
that would meet as many candidates as there are rows (a small table) is compared with every row instead, once.

The trees are cut into segments by their leading bits, about SEGMENT_ROWS rows each; a query visits all segments of its
prefix, where its candidates are compared in place, and only its best ones leave.  Queries with the same prefix share one
matrix product; a segment with more than SEGMENT_ROWS queries is compared in parts.

Inner products are searched as angles: vectors get one more component that makes all norms equal, queries get 0 there,
and the mean of a bounded sample (SAMPLE_ROWS) is taken off before hashing.  Equal vectors form one class, so a vector that is
very common is indexed and compared once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.llm.common import small_batches, stored
from reviewlake.operators.skew import first_rows

TREES = 64
HASH_BITS = 40
KEY_BITS = 64
LEVELS = 40
RECALL = 0.92
SAMPLE_QUERIES = 256
SEGMENT_ROWS = 1 << 17
SAMPLE_ROWS = 4096
QUERY_BLOCK = 32


def planes(tree: int, width: int) -> np.ndarray:
    """Projections of one tree, orthogonal in blocks of ``width``; the same in every task."""
    rng = np.random.default_rng([5, tree])
    blocks = [np.linalg.qr(rng.normal(size=(width, width)))[0] for _ in range(-(-HASH_BITS // width))]
    return np.concatenate(blocks, 1)[:, :HASH_BITS].astype(np.float32)


def hash_strings(points: np.ndarray, tree: int) -> np.ndarray:
    """Bit strings of centred points as unsigned numbers (the string in the upper bits), whose order is that of the sorted array."""
    bits = points.astype(np.float32) @ planes(tree, points.shape[1]) > 0
    packed = np.zeros((len(points), 8), np.uint8)
    packed[:, :HASH_BITS // 8] = np.packbits(bits, axis=1)
    return packed.view(">u8").reshape(-1).astype(np.uint64)


def bytes_of(v: np.ndarray) -> np.ndarray:
    """Vectors as one byte a component and a scale in four more."""
    scale = np.maximum(np.abs(v).max(1), np.finfo(np.float32).tiny).astype(np.float32)
    return np.concatenate([np.rint(v / scale[:, None] * 127).astype(np.int8).view(np.uint8), scale[:, None].view(np.uint8)], 1)


def vectors_of(raw: np.ndarray) -> np.ndarray:
    """The vectors that :func:`bytes_of` stored, nearly."""
    return raw[:, :-4].copy().view(np.int8) * (np.ascontiguousarray(raw[:, -4:]).view(np.float32) / np.float32(127))


def usable(vector: str) -> Column:
    """Neither null nor zero, and without null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda x: x != 0)


def inner(a: str, b: str) -> Column:
    """Inner product in double precision, summed from the first component to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float32).reshape(len(column), -1)


def search(rows: DataFrame, is_query: Column, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding",
           trees: int = TREES, candidates: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows found, its own id left out.

    Nearness is the inner product; ties go to the smaller id.  With fewer other rows than ``k`` all come back.  Rows
    whose vector is null, zero or holds null or non-finite components take no part, nor do rows with a null id, or with
    another number of components than most rows have (the fewest, if that is a tie).  Repeated rows count once.
    ``candidates`` is the number of candidates per query, over all trees; unless given, it is measured for RECALL.
    """
    spark = rows.sparkSession
    small_batches(spark, 4096)
    kind = rows.schema[vector].dataType.simpleString()
    own = F.col(vector) if kind in ("array<float>", "array<double>") else F.col(vector).cast("array<double>")
    valid = rows.where(usable(vector) & F.col(vec_id).isNotNull()).select(
        F.col(vec_id).cast("long").alias("vec_id"), own.alias("vec"), is_query.alias("query"))
    sizes = valid.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").first()
    width = sizes.n if sizes else 1
    valid = stored(valid.where(F.size("vec") == width), "vectors")
    few = first_rows(valid.select("vec", "vec_id").distinct(), ["vec"], [F.col("vec_id")], k + 1)
    classes = few.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    classes = stored(classes.withColumn("class", F.monotonically_increasing_id()), "vector-classes")
    named = valid.where("query").select(F.col("vec_id").alias("query_id"), "vec").distinct().join(
        classes.select("vec", "class"), "vec").select("query_id", "class")
    named = stored(named, "queries")
    asked = classes.join(named.select("class").distinct(), "class", "left_semi").select("class", "vec")

    total, longest = classes.agg(F.count("*"), F.max(inner("vec", "vec"))).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sample = classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE_ROWS).select("vec").collect()
    centre = np.append(np.mean([r.vec for r in sample], axis=0), 0.0)
    centre[-1] = np.mean([np.sqrt(max(longest - float(np.dot(r.vec, r.vec)), 0.0)) for r in sample])
    lead = max(0, int(np.ceil(np.log2(total / SEGMENT_ROWS))))

    def hashed(own: bool, with_vector: bool):
        """Rows of the table (own component) or of the queries (0 there), one per tree."""
        def of(batches):
            for batch in batches:
                v = _matrix(batch.column(1)).astype(np.float64)
                extra = np.sqrt(np.maximum(longest - (v * v).sum(1), 0)) if own else np.zeros(len(v))
                points = np.column_stack([v, extra]) - centre
                codes = pa.array([x.tobytes() for x in bytes_of(v)], pa.binary()) if with_vector else None
                for tree in range(trees):
                    keys = hash_strings(points, tree)
                    segment = (keys >> np.uint64(KEY_BITS - lead)) if lead else np.zeros(len(keys), np.uint64)
                    columns = {"tree": pa.array(np.full(len(v), tree, np.int32)), "segment": pa.array(segment.astype(np.int64)),
                               "own": pa.array(np.full(len(v), own)), "class": batch.column(0),
                               "key": pa.array(keys.view(np.int64))}
                    if with_vector:
                        columns["code"] = codes
                    yield pa.RecordBatch.from_pydict(columns)
        return of

    form = "tree int, segment long, own boolean, class long, key long"

    def split(t: pa.Table):
        """The segment's keys in order, their rows, and the queries' keys."""
        keys, own = t["key"].to_numpy().view(np.uint64), t["own"].to_numpy()
        mine, theirs = np.flatnonzero(own), np.flatnonzero(~own)
        mine = mine[np.argsort(keys[mine], kind="stable")]
        return keys[mine], mine, keys[theirs], theirs

    def bounds(keys: np.ndarray, queries: np.ndarray, level):
        """Range of the sorted array that shares ``level`` bits with each query."""
        level = np.asarray(level, np.uint64)
        rest = np.where(level >= HASH_BITS, np.uint64(0),
                        np.uint64(0xFFFFFFFFFFFFFFFF) >> np.minimum(level, np.uint64(HASH_BITS - 1)))
        return np.searchsorted(keys, queries & ~rest, "left"), np.searchsorted(keys, queries | rest, "right")

    def descended(t: pa.Table) -> pa.Table:
        keys, _, queries, at = split(t)
        found = []
        for level in range(lead, LEVELS + 1):
            lo, hi = bounds(keys, queries, level)
            found.append(hi - lo)
        counts = np.stack(found, 1) if len(queries) else np.empty((0, LEVELS + 1 - lead), np.int64)
        some = counts.ravel() > 0
        return pa.table({"class": pa.array(np.repeat(t["class"].to_numpy()[at], counts.shape[1])[some]),
                         "level": pa.array(np.tile(np.arange(lead, LEVELS + 1, dtype=np.int32), len(queries))[some]),
                         "n": pa.array(counts.ravel()[some].astype(np.int64))})

    index_keys = classes.select("class", "vec").mapInArrow(hashed(True, False), form)
    query_keys = asked.mapInArrow(hashed(False, False), form)
    counts = index_keys.union(query_keys).groupBy("tree", "segment").applyInArrow(descended, "class long, level int, n long")
    if lead:
        sizes = index_keys.groupBy("tree", "segment").agg(F.count("*").alias("n"))
        above = F.explode(F.sequence(F.lit(0), F.lit(lead - 1))).alias("level")
        prefix = F.expr(f"shiftright(segment, {lead} - level)").alias("prefix")
        sizes = sizes.select("*", above).groupBy("tree", "level", prefix).agg(F.sum("n").alias("n"))
        counts = counts.union(query_keys.select("*", above).select("tree", "level", prefix, "class").join(
            sizes, ["tree", "level", "prefix"]).select("class", "level", "n"))
    per_level = stored(counts.groupBy("class", "level").agg(F.sum("n").alias("n")), "level-counts")

    def nearest(names: np.ndarray, vectors: np.ndarray):
        """The best ``k`` other classes of a partition for each sampled query, with the prefix length that each tree shares."""
        points = np.column_stack([vectors, np.zeros(len(vectors))]) - centre
        own_keys = np.stack([hash_strings(points, tree) for tree in range(trees)], 1)

        def of(batches):
            best = np.full((len(names), k), -np.inf), np.zeros((len(names), k), np.int64), np.zeros((len(names), k, trees), np.uint8)
            for batch in batches:
                ids, v = batch.column(0).to_numpy(), _matrix(batch.column(1)).astype(np.float64)
                scores = np.where(names[:, None] == ids, -np.inf, vectors @ v.T)
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k] if len(ids) > k else np.tile(np.arange(len(ids)), (len(names), 1))
                kept, at = np.unique(top, return_inverse=True)
                extra = np.sqrt(np.maximum(longest - (v[kept] * v[kept]).sum(1), 0))
                points = np.column_stack([v[kept], extra]) - centre
                keys = np.stack([hash_strings(points, tree) for tree in range(trees)], 1)
                apart = keys[at.reshape(top.shape)] ^ own_keys[:, None]
                depth = np.zeros(apart.shape, np.uint8)
                for level in range(1, LEVELS + 1):
                    depth += apart >> np.uint64(KEY_BITS - level) == 0
                merged = [np.concatenate(x, 1) for x in zip(best, (np.take_along_axis(scores, top, 1), ids[top], depth))]
                chosen = np.argpartition(-merged[0], k - 1, axis=1)[:, :k]
                best = tuple(np.take_along_axis(x, chosen if x.ndim == 2 else chosen[..., None], 1) for x in merged)
            found = np.isfinite(best[0])
            yield pa.RecordBatch.from_pydict({
                "class": pa.array(np.repeat(names, found.sum(1))), "other": pa.array(best[1][found]),
                "score": pa.array(best[0][found]), "depths": pa.array([d.tobytes() for d in best[2][found]], pa.binary())})
        return of

    def measured() -> int:
        """The least number of candidates with which the sampled queries find the share RECALL of their neighbours.

        A neighbour is found if a tree's ascent stops at a level not below the prefix that the two share in it.
        """
        few = asked.orderBy(F.xxhash64("class"), "class").limit(SAMPLE_QUERIES).collect()
        if not few:
            return 1
        names, vectors = np.array([r["class"] for r in few]), np.array([r.vec for r in few], np.float64)
        true = classes.select("class", "vec").mapInArrow(nearest(names, vectors), "class long, other long, score double, depths binary")
        true = first_rows(true, ["class"], [F.desc("score"), F.col("other")], k).select("class", "depths").collect()
        held = np.zeros((len(names), LEVELS + 1), np.int64)
        held[:, 0] = trees * total
        row = {name: i for i, name in enumerate(names.tolist())}
        for r in per_level.where(F.col("class").isin(names.tolist())).collect():
            held[row[r["class"]], r.level] = r.n
        query = np.array([row[r["class"]] for r in true], np.int64)
        depth = np.frombuffer(b"".join(r.depths for r in true), np.uint8).reshape(len(true), trees)
        shared = np.maximum.accumulate(depth, axis=1) if len(true) else depth  # longest prefix in the first trees

        def enough(budget: int) -> bool:
            level = np.where(held >= budget, np.arange(LEVELS + 1), 0).max(1)
            at = np.arange(len(names))
            upper, lower = held[at, level], np.where(level < LEVELS, held[at, np.minimum(level + 1, LEVELS)], 0)
            ascended = np.clip(np.ceil((budget - lower) / np.maximum(upper - lower, 1) * trees), 1, trees).astype(np.int64)
            found = (shared[:, -1] > level[query]) | (shared[np.arange(len(true)), ascended[query] - 1] >= level[query])
            return found.sum() >= RECALL * len(true)

        low, high = trees * (k + 1), max(total, trees * (k + 1))
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if enough(middle) else (middle + 1, high)
        return low

    budget = measured() if candidates is None else candidates
    wanted = F.lit(budget)
    # The trees ascend in turn: the first ones are at ``level``, the others one bit below, when the budget is reached.
    reached = F.max_by("n", F.when(F.col("n") >= wanted, F.col("level")))
    below = F.coalesce(F.max(F.when(F.col("n") < wanted, F.col("n"))), F.lit(0))
    deepest = F.coalesce(F.max(F.when(F.col("n") >= wanted, F.col("level"))), F.lit(0))
    ascended = F.coalesce(F.ceil((wanted - below) / F.greatest(reached - below, F.lit(1)) * trees), F.lit(trees))
    levels = per_level.groupBy("class").agg(deepest.alias("level"), F.least(F.greatest(ascended, F.lit(1)), F.lit(trees)).cast("int").alias("ascended"))
    if budget >= total:
        levels = levels.withColumns({"level": F.lit(0), "ascended": F.lit(trees)})
    levels = stored(levels, "levels")

    spare = k + 10  # bytes instead of components may change places nearby

    def compared(t: pa.Table) -> pa.Table:
        keys, mine, queries, at = split(t)
        out = {"class": [], "other": [], "score": []}
        if len(mine) and len(queries):
            raw = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
            vectors, asked_vectors = vectors_of(raw[mine]), vectors_of(raw[at])
            classes_, names = t["class"].to_numpy()[mine], t["class"].to_numpy()[at]
            lo, hi = bounds(keys, queries, t["level"].to_numpy(zero_copy_only=False)[at])
            order = np.lexsort((hi, lo))
            cuts = np.flatnonzero((np.diff(lo[order]) != 0) | (np.diff(hi[order]) != 0)) + 1
            for group in np.split(order, cuts):
                a, b = lo[group[0]], hi[group[0]]
                for start in range(0, len(group) if b > a else 0, QUERY_BLOCK):
                    block = group[start:start + QUERY_BLOCK]
                    scores = asked_vectors[block] @ vectors[a:b].T
                    best = np.argpartition(-scores, spare - 1, axis=1)[:, :spare] if b - a > spare else np.tile(np.arange(b - a), (len(block), 1))
                    out["class"].append(np.repeat(names[block], best.shape[1]))
                    out["other"].append(classes_[a:b][best].ravel())
                    out["score"].append(np.take_along_axis(scores, best, 1).ravel())
        kinds = {"class": np.int64, "other": np.int64, "score": np.float64}
        return pa.table({n: pa.array(np.concatenate([*out[n], np.empty(0, kind)]).astype(kind)) for n, kind in kinds.items()})

    first = F.expr(f"shiftright(segment, greatest({lead} - level, 0))")
    width_ = F.expr(f"shiftleft(1L, greatest({lead} - level, 0))")
    at_level = F.when((F.col("level") == 0) | (F.col("tree") < F.col("ascended")), F.col("level")).otherwise(F.least(F.col("level") + 1, F.lit(LEVELS)))
    visits = query_keys.join(levels, "class").where("level > 0 OR tree = 0").withColumn("level", at_level).select(
        "tree", F.explode(F.sequence(first * width_, first * width_ + width_ - 1)).alias("segment"), "own", "class", "key", "level")
    visits = stored(visits, "visits")
    parts = visits.groupBy("tree", "segment").agg(F.ceil(F.count("*") / SEGMENT_ROWS).cast("int").alias("parts"))
    parts = stored(parts, "segment-parts")
    columns = ["tree", "segment", "part", "own", "class", "key", "code", "level"]
    index_rows = classes.select("class", "vec").mapInArrow(hashed(True, True), form + ", code binary").join(
        parts, ["tree", "segment"]).select("*", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("level"))
    def coded(batches):
        for batch in batches:
            raw = bytes_of(_matrix(batch.column(1)).astype(np.float64))
            yield pa.RecordBatch.from_pydict({"class": batch.column(0), "code": pa.array([x.tobytes() for x in raw], pa.binary())})

    query_rows = visits.join(parts, ["tree", "segment"]).join(asked.mapInArrow(coded, "class long, code binary"), "class").withColumn(
        "part", F.pmod(F.xxhash64("class"), "parts").cast("int"))
    near = index_rows.select(columns).union(query_rows.select(columns)).groupBy("tree", "segment", "part").applyInArrow(
        compared, "class long, other long, score double")
    near = near.groupBy("class", "other").agg(F.max("score").alias("score"))
    near = first_rows(near, ["class"], [F.desc("score"), F.col("other")], 2 * k + 10)
    exact = (
        near.select("class", "other").join(classes.select("class", F.col("vec").alias("a")), "class")
        .join(classes.select(F.col("class").alias("other"), F.col("vec").alias("b"), "ids"), "other")
        .select("class", inner("a", "b").alias("score"), F.explode("ids").alias("vec_id")))
    order = [F.desc("score"), F.col("vec_id")]
    exact = first_rows(exact, ["class"], order, k + 1)
    listed = named.join(exact, "class").where("query_id <> vec_id")
    place = Window.partitionBy("query_id").orderBy(*order)
    return listed.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
