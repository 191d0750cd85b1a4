"""Near duplicates by min-max hashing.

A document is the set of its distinct five-word shingles.  Each of PERMUTATIONS hash functions gives two signature
values, the minimum and the maximum over the set, so the hashes are evaluated half as often as for minima alone; both
agree between two sets with probability equal to their Jaccard similarity, and a minimum and a maximum are slightly
negatively correlated, which lowers the variance.  The values are cut into bands, and sets that agree on a whole band meet
in a bucket.  The rows per band are the most with which two sets at the threshold share fewer than two buckets with
probability below MISS; a set that meets others in one bucket only is taken for chance.

Candidates are confirmed on the full sets.  No bucket is expanded into all its pairs:

1. Documents with equal sets form one class; only classes go on.
2. A shingle that no other candidate has bounds a set's similarity to all of them.  Pairs that cannot reach the threshold
   for their numbers of own shingles are dropped.
3. In each bucket every class is tested against the class with the fewest own shingles, which is the likely original.
   Confirmed links give components.
4. Pairs that are still in different components are tested as well; all others are already connected.  A link shares a
   shingle that at most RARE candidates have, which gives few pairs per shingle, or it shares none, and then all rare
   shingles bound its similarity, which leaves few pairs per bucket.

The components of the links are found by rounds of large-star and small-star steps, each written to the checkpoint folder.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import distinct, drawn, mix64, power_table, small_batches, stored, text_bytes
from reviewlake.session import cut_lineage

WORDS = 5
PERMUTATIONS = 108
MISS = 1e-6
RARE = 8
PIECE_BYTES = 1 << 20
SETS_AT_ONCE = 2048
#: A pair goes to the exact test if its estimated similarity is at most this far below the threshold: the estimate's
#: standard deviation is at most 0.037, so a true link fails with probability below 1e-8.
SLACK = 0.2

_MULTIPLIERS = drawn(3, PERMUTATIONS)
_SHINGLE = drawn(5, WORDS)
_BAND = drawn(7, 2 * PERMUTATIONS)
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts that stand one after another, and the number of words of each text.

    Words are hashed by differences of a running polynomial sum.  Texts are cut between words into pieces of about
    PIECE_BYTES, which bounds the memory.
    """
    hashes, at, n = [], 0, len(data)
    white = _WHITE[data]
    boundary = np.zeros(n + 1, bool)
    boundary[ends] = True
    starts_word = ~white
    starts_word[1:] &= white[:-1] | boundary[1:n]
    starts = np.flatnonzero(starts_word)
    ends_word = ~white
    ends_word[:-1] &= white[1:] | boundary[1:n]
    stops = np.flatnonzero(ends_word) + 1
    counts = np.diff(np.searchsorted(starts, ends))
    del white, boundary, starts_word, ends_word
    k = 0
    while k < len(starts):
        at = int(starts[k])
        stop = max(int(np.searchsorted(stops, at + PIECE_BYTES, "right")), k + 1)
        piece = _LOWER[data[at:int(stops[stop - 1])]].astype(np.uint64) + np.uint64(1)
        sums = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum(piece * power_table(_BASE, len(piece)), out=sums[1:])
        a, b = starts[k:stop] - at, stops[k:stop] - at
        h = (sums[b] - sums[a]) * power_table(_INVERSE, len(piece) + 1)[a]
        hashes.append(mix64(h + (b - a).astype(np.uint64) * _MULTIPLIERS[0]))
        k = stop
    return (np.concatenate(hashes) if hashes else np.empty(0, np.uint64)), counts


def shingle_sets(column: pa.Array) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; fewer words than WORDS make one shingle, no words none."""
    hashes, counts = word_hashes(*text_bytes(column))
    n = len(hashes) - WORDS + 1
    rolled = np.zeros(max(n, 0), np.uint64)
    for j in range(WORDS):
        rolled += hashes[j:j + len(rolled)] * _SHINGLE[j]
    rolled = mix64(rolled)
    at = 0
    for count in counts.tolist():
        if count >= WORDS:
            yield distinct(rolled[at:at + count - WORDS + 1])
        elif count:
            whole = (hashes[at:at + count] * _SHINGLE[:count]).sum(dtype=np.uint64) + np.uint64(count)
            yield mix64(np.array([whole], np.uint64))
        else:
            yield np.empty(0, np.uint64)
        at += count


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation, side by side."""
    low = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    high = np.zeros(PERMUTATIONS, np.uint64)
    for at in range(0, len(shingles), SETS_AT_ONCE):
        values = shingles[None, at:at + SETS_AT_ONCE] * _MULTIPLIERS[:, None]
        np.minimum(low, values.min(1), out=low)
        np.maximum(high, values.max(1), out=high)
    return np.stack([low, high], 1).reshape(-1)


def rows_per_band(percent: int) -> int:
    """Most rows per band with which a pair at the threshold shares fewer than two bands with probability below MISS."""
    for rows in range(2 * PERMUTATIONS, 0, -1):
        bands, p = 2 * PERMUTATIONS // rows, (percent / 100) ** rows
        if bands > 1 and (1 - p) ** bands + bands * p * (1 - p) ** (bands - 1) < MISS:
            return rows
    raise ValueError("the threshold is too low for this number of permutations")


def sketches(docs: DataFrame, doc_id: Column, text: Column, percent: int) -> DataFrame:
    """Per row: id, hash of the text, set size, digest of the set, band keys and one byte of each signature value."""
    small_batches(docs.sparkSession)
    height = rows_per_band(percent)
    n_bands = 2 * PERMUTATIONS // height

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bands, brief = [], [], [], []
            for s in shingle_sets(batch.column(2)):
                sizes.append(len(s))
                if not len(s):
                    digests.append(None)
                    bands.append([])
                    brief.append(None)
                    continue
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                values = signature(s)
                keys = values[:n_bands * height].reshape(n_bands, height) * _BAND[:height]
                keys = keys.sum(1, dtype=np.uint64) + np.arange(n_bands, dtype=np.uint64)
                bands.append(mix64(keys).view(np.int64))
                brief.append((mix64(values) >> np.uint64(56)).astype(np.uint8).tobytes())
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, bands)]), pa.int32()),
                pa.array(np.concatenate([*bands, np.empty(0, np.int64)]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), lists,
                 pa.array(brief, pa.binary())], names=["id", "text_hash", "size", "node", "bands", "brief"])

    return docs.select(doc_id.alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(
        sketched, "id long, text_hash long, size long, node binary, bands array<long>, brief binary")


def _sets(classes: DataFrame, docs: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """(node, shingles) of the classes, each from one of its texts."""
    rows = docs.select(doc_id.alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    texts = (
        classes.select("node", "id", "text_hash").alias("w")
        .join(rows.alias("r"), F.col("w.id").eqNullSafe(F.col("r.id")) & (F.col("w.text_hash") == F.col("r.text_hash")))
        .select("w.node", "r.text"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(batch.column(1)))
            same = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() == n
                    for s, n in zip(found, batch.column(0).to_pylist())]
            lists = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
                pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["node", "shingles"]).filter(
                pa.array(same, pa.bool_()))

    return texts.mapInArrow(sets, "node binary, shingles array<long>").dropDuplicates(["node"])


def _possible(a: str, b: str, percent: int, most: str = "common") -> Column:
    """Whether two classes can reach the threshold: they share at most ``most`` of either."""
    most = F.least(f"{a}.{most}", f"{b}.{most}")
    return most * 100 >= (F.col(f"{a}.size") + F.col(f"{b}.size") - most) * percent


def _similar(pairs: DataFrame, about: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class digests whose sets have 100 * intersection >= percent * union.

    A look at the signature bytes drops clear misses before the sets are compared.
    """
    brief = about.select("node", "brief")
    looked = (
        pairs.join(brief.select(F.col("node").alias("a"), F.col("brief").alias("brief_a")), "a")
        .join(brief.select(F.col("node").alias("b"), F.col("brief").alias("brief_b")), "b")
        .select("a", "b", "brief_a", "brief_b"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(len(batch), -1) for c in (2, 3))
                keep = (x == y).mean(1) >= percent / 100 - SLACK
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep))

    near = looked.mapInArrow(close, "a binary, b binary")
    both = (
        near.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b")
        .select("a", "b", "set_a", "set_b"))

    def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                merged = np.concatenate([x.values.to_numpy(), y.values.to_numpy()])
                merged.sort(kind="stable")
                shared = int(np.count_nonzero(merged[1:] == merged[:-1]))
                keep.append(100 * shared >= percent * (len(merged) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(
                pa.array(keep, pa.bool_()))

    return both.mapInArrow(confirmed, "a binary, b binary")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): the smallest node that can be reached.

    Large-star links every larger neighbour of a node to its smallest neighbour, small-star does so with the smaller
    ones; both only group by node, with sums before the shuffle, and the rounds end when the edges no longer change.
    """
    edges = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("least"))
        large = both.join(least, "a").where("b > a and b <> least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(low, "a").select(F.when(F.col("b") == F.col("least"), F.col("a")).otherwise(F.col("b")).alias("a"),
                                            F.col("least").alias("b"))
        edges = cut_lineage(small.distinct())
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_003)).first())
        if state == before:
            break
        before = state
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())


def extended(roots: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) of known components with the links (a, b) added; what is connected already goes on as links to its root."""
    if links.isEmpty():
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """(doc_id, text_hash, n_shingles, component_id, kept), one row per document.

    * Null or empty texts, and texts of white space, have no shingles, link with nothing and are kept.
    * Rows with a null id link like others but never name a component; without any id the component is null.
    * Rows with the same id and text are the same document twice: both come back, equal.
    * Other columns are not read, so their names cannot clash.
    """
    ids, texts = F.col(doc_id).cast("long"), F.col(text)
    rows = stored(sketches(docs, ids, texts, percent), "sketches")
    classes = stored(
        rows.where("size > 0").groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("first"),
                                                   F.first("size").alias("size"), F.first("bands").alias("bands"),
                                                   F.first("brief").alias("brief"))
        .select("node", "first.id", "first.text_hash", "size", "bands", "brief"), "classes")
    keyed = classes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    members = stored(keyed.join(shared, "key", "left_semi"), "buckets")
    busy = stored(members.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node"), "busy")
    sets = stored(_sets(classes.join(busy, "node", "left_semi"), docs, ids, texts), "shingle-sets")
    postings = sets.select(F.xxhash64("node").alias("owner"), F.explode("shingles").alias("shingle"))
    rare = stored(postings.groupBy("shingle").agg(F.count("*").cast("int").alias("n")).where(F.col("n") <= RARE), "rare-shingles")
    held = postings.join(rare, "shingle").groupBy("owner").agg(F.count_if(F.col("n") == 1).alias("own"), F.count("*").alias("rare"))
    about = classes.join(busy, "node", "left_semi").select("node", "size", "brief", F.xxhash64("node").alias("owner"))
    about = stored(about.join(held, "owner", "left").select(
        "node", "owner", "brief", "size", (F.col("size") - F.coalesce("own", F.lit(0))).alias("common"),
        (F.col("size") - F.coalesce("rare", F.lit(0))).alias("usual")), "class-sizes")
    members = stored(members.join(about.drop("brief", "owner"), "node"), "members")
    heads = members.groupBy("key").agg(F.min(F.struct((F.col("size") - F.col("common")).alias("own"), "node", "size", "common"))
                                       .alias("h"), F.count("*").alias("n")).where("n > 1")
    heads = heads.select("key", "h.node", "h.size", "h.common")
    stars = members.alias("m").join(heads.alias("h"), "key").where(
        (F.col("m.node") != F.col("h.node")) & _possible("m", "h", percent)).select(
        F.least("m.node", "h.node").alias("a"), F.greatest("m.node", "h.node").alias("b")).distinct()
    stars = stored(stars, "stars")
    links = stored(_similar(stars, about, sets, percent), "links")
    roots = components(links)
    placed = members.join(roots, "node", "left").select(
        "key", "node", "size", "common", "usual", F.coalesce("root", "node").alias("root"))
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    placed = stored(placed.join(mixed.select("key"), "key", "left_semi"), "mixed-buckets")
    apart = (F.col("x.node") < F.col("y.node")) & (F.col("x.root") != F.col("y.root"))
    nodes = (F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    by_bucket = placed.alias("x").join(
        placed.alias("y"), (F.col("x.key") == F.col("y.key")) & apart & _possible("x", "y", percent, "usual")).select(*nodes)
    shown = placed.select("node", "size", "common", "root").distinct().withColumn("owner", F.xxhash64("node"))
    shown = stored(postings.join(rare.where("n > 1").select("shingle"), "shingle").join(shown, "owner").drop("owner"), "rare-postings")
    by_shingle = shown.alias("x").join(
        shown.alias("y"), (F.col("x.shingle") == F.col("y.shingle")) & apart & _possible("x", "y", percent)).select(*nodes)
    open_pairs = by_bucket.union(by_shingle).distinct()
    more = stored(_similar(open_pairs.join(stars, ["a", "b"], "left_anti"), about, sets, percent), "links")
    roots = extended(roots, more)
    placed = classes.select("node", "id").join(roots, "node", "left").select(
        "node", "id", F.coalesce("root", "node").alias("root"))
    names = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    named = placed.join(names, "root").select("node", "component_id")
    return (
        rows.select(F.col("id").alias("doc_id"), "text_hash", F.col("size").alias("n_shingles"), "node")
        .join(named, "node", "left")
        .select("doc_id", "text_hash", "n_shingles",
                F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 85) -> DataFrame:
    """The documents without those that link to one with a smaller id; a document that is there twice stays once."""
    found = stored(near_duplicates(docs, doc_id, text, percent), "near")
    row = (F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"))
    same = lambda other: F.col("_id").eqNullSafe(other["doc_id"]) & (F.col("_hash") == other["text_hash"])
    gone = found.where(~F.col("kept")).select("doc_id", "text_hash").distinct()
    twice = stored(found.where("kept").groupBy("doc_id", "text_hash").count().where("count > 1").drop("count"), "twice")
    stay = docs.select("*", *row).join(gone, same(gone), "left_anti")
    if twice.isEmpty():
        return stay.drop("_id", "_hash")
    once = stay.join(twice, same(twice), "left_anti").drop("_id", "_hash")
    return once.union(stay.join(twice, same(twice), "left_semi").drop("_id", "_hash").dropDuplicates([doc_id, text]))
