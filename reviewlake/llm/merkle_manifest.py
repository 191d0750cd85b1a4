"""Merkle manifest of a table by time-forward processing.

Nodes are numbered in time order: a parent's label is larger than those of its children.  A priority queue ordered by
label delivers digests to parents (forward sweep), then a sweep in reversed order delivers proofs to children.

The queue is external: its messages are rows, which Spark's shuffle sorts by (tree, block, label) and spills to disk.
A block is a complete subtree of BLOCK consecutive nodes, so a task holds one block at a time; the roots of all blocks
are the messages to the next sweep, whose input is BLOCK times smaller.  On the way back, each block gets the proof of
its root as one message before its nodes.  Two sweeps up and two down do for 16 million leaves a tree.

Defined results: rows without a value are digested as ``-``; rows without an order value come first; rows with equal order
values follow their digests, so repeated rows are leaves of their own; rows without a tree value form the first tree.
Only the named columns are read, so further columns of any name change nothing.  An empty table has no rows and no root.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.common import ranked, runs_of, stored

RUN = 8
BLOCK_LEVELS = 4
BLOCK = RUN ** BLOCK_LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
SIBLINGS = "array<struct<before: string, after: string>>"


def leaf_digest(values: list[Column]) -> Column:
    """Digest of a row: each value as its UTF-8 length, a colon and its text; a null as a hyphen."""
    text = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in text]
    return F.sha2(F.concat(*parts), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda d, s: F.sha2(F.concat(s["before"], d, s["after"]), 256))


def height(size: int, levels: int = BLOCK_LEVELS) -> int:
    """Levels that a block of a tree with ``size`` nodes climbs: to the tree's root, at most ``levels``."""
    h = 0
    while h < levels and RUN ** h < size:
        h += 1
    return h


def labels(n: int, levels: int) -> list[int]:
    """First label of each level above ``n`` nodes; the last entry is the number of all nodes."""
    starts = [0, n]
    for _ in range(levels):
        n = -(-n // RUN)
        starts.append(starts[-1] + n)
    return starts


def sent_up(digests: list[str], levels: int) -> list[str]:
    """Digests of all nodes by label, from those of the lowest level."""
    starts, found = labels(len(digests), levels), list(digests)
    queue = [(starts[1] + i // RUN, i, d) for i, d in enumerate(digests)]  # sorted, so it is a heap
    for level in range(1, levels + 1):
        for label in range(starts[level], starts[level + 1]):
            parts = []
            while queue and queue[0][0] == label:
                parts.append(heapq.heappop(queue)[2])
            found.append(hashlib.sha256("".join(parts).encode()).hexdigest())
            if level < levels:
                heapq.heappush(queue, (starts[level + 1] + (label - starts[level]) // RUN, label, found[-1]))
    return found


def sent_down(found: list[str], n: int, levels: int, proof: tuple) -> list[tuple]:
    """Proofs of the ``n`` lowest nodes: (siblings before, siblings after) per level, then the root's ``proof``."""
    starts, out = labels(n, levels), [proof] * n
    queue = [(1 - len(found), proof)]
    while queue:
        label, proof = heapq.heappop(queue)
        label = -label
        if label < n:
            out[label] = proof
            continue
        level = next(k for k in range(levels, 0, -1) if label >= starts[k])
        first = starts[level - 1] + (label - starts[level]) * RUN
        last = min(first + RUN, starts[level])
        run = found[first:last]
        for k in range(len(run)):
            mates = ("".join(run[:k]), "".join(run[k + 1:]))
            heapq.heappush(queue, (-(first + k), (mates, *proof)))
    return out


def laid_out(nodes: DataFrame) -> DataFrame:
    """Queue order: blocks dealt to tasks, each sorted by position."""
    return nodes.repartition("tree", "block").sortWithinPartitions("tree", "block", "position")


def forward(nodes: DataFrame) -> DataFrame:
    """The blocks' roots as nodes of the next sweep: (tree, position, size, digest)."""
    schema = "tree long, position long, size long, digest string"
    block, levels_at_most = BLOCK, BLOCK_LEVELS

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ("tree", "block")):
            size = t["size"][0].as_py()
            root = sent_up(t["digest"].to_pylist(), height(size, levels_at_most))[-1]
            yield pa.RecordBatch.from_pydict({
                "tree": pa.array([t["tree"][0].as_py()], pa.int64()), "position": pa.array([t["block"][0].as_py()], pa.int64()),
                "size": pa.array([-(-size // block)], pa.int64()), "digest": pa.array([root], pa.string())})

    cut = nodes.select("tree", F.floor(F.col("position") / block).alias("block"), "position", "size", "digest")
    return laid_out(cut).mapInArrow(swept, schema)


def backward(nodes: DataFrame, messages: DataFrame) -> DataFrame:
    """``nodes`` with their proofs.  ``messages`` holds the proof and the tree's root per (tree, position of the block)."""
    levels_at_most = BLOCK_LEVELS
    fields = [f for f in nodes.schema.fields if f.name not in ("proof", "subroot")]
    schema = T.StructType([*fields, *T._parse_datatype_string(f"proof {SIBLINGS}, subroot string").fields])
    names = [f.name for f in fields]

    def swept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of(batches, ("tree", "block")):
            top = t.slice(0, 1)
            t = t.slice(1).combine_chunks()
            proof = tuple((s["before"], s["after"]) for s in top["proof"][0].as_py())
            levels = height(t["size"][0].as_py(), levels_at_most)
            proofs = sent_down(sent_up(t["digest"].to_pylist(), levels), t.num_rows, levels, proof)
            flat = [s for p in proofs for s in p]
            ends = [0]
            for p in proofs:
                ends.append(ends[-1] + len(p))
            pairs = pa.StructArray.from_arrays([pa.array([s[k] for s in flat], pa.string()) for k in (0, 1)], ["before", "after"])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)
            roots = pa.array([top["subroot"][0].as_py()] * t.num_rows, pa.string())
            for piece in pa.Table.from_arrays([*(t[c] for c in names), lists, roots], names=[*names, "proof", "subroot"]).to_batches(512):
                yield piece

    cut = nodes.withColumn("block", F.floor(F.col("position") / BLOCK))
    first = messages.select("tree", F.col("position").alias("block"), F.lit(-1).cast("long").alias("position"), "proof", "subroot")
    both = cut.unionByName(first, allowMissingColumns=True)
    return laid_out(both).mapInArrow(swept, schema)


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """Nodes of all forward sweeps, the given ones first, one root per tree last."""
    tables = [nodes]
    while (tables[-1].agg(F.max("size").alias("n")).first().n or 0) > 1:
        tables.append(stored(forward(tables[-1]), "merkle"))
    return tables


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, tree: str = "lang", order: str = "doc_id",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """Digests and proofs of all rows: ``order`` column, leaf, subroot, root, proof and the expressions in ``carry``.

    One tree per value of ``tree``, its leaves by ``order``; the trees' roots, by value, are the leaves of one more tree.
    ``proof`` lists the siblings before and after the row's node, level by level from the leaf to the root.
    """
    extra = {f"carried_{k}": c for k, c in (carry or {}).items()}
    rows = docs.select(F.col(order).alias("key"), F.col(tree).cast("string").alias("value"),
                       leaf_digest([F.col(c) for c in fields]).alias("digest"), *[c.alias(k) for k, c in extra.items()])
    rows = stored(rows.withColumn("at", F.monotonically_increasing_id()), "merkle-leaves")
    by = [F.asc_nulls_first("value"), F.asc_nulls_first("key"), F.asc("digest"), F.asc("at")]
    rows = ranked(rows, by, "rank").drop("at")
    trees = rows.groupBy("value").agg(F.min("rank").alias("tree"), F.count("*").alias("size")).withColumnRenamed("value", "of")
    nodes = rows.join(trees, F.col("value").eqNullSafe(F.col("of"))).withColumn("position", F.col("rank") - F.col("tree"))
    nodes = stored(nodes.select("tree", "position", "size", "digest", "key", *extra), "merkle-nodes")

    sweeps = climbed(nodes)
    tops = ranked(sweeps[-1].select(F.col("tree").alias("below"), F.col("digest")), [F.asc("below")], "rank")
    n_trees = tops.count()
    tops = stored(tops.select(F.lit(0).cast("long").alias("tree"), (F.col("rank") - 1).alias("position"),
                              F.lit(n_trees).cast("long").alias("size"), "digest", "below"), "merkle-tops")
    top_sweeps = climbed(tops)
    last = top_sweeps[-1].first()
    root = last.digest if last else None

    nothing = F.array().cast(SIBLINGS)
    found = top_sweeps[-1].withColumns({"proof": nothing, "subroot": F.lit(root).cast("string")})
    for below in reversed(top_sweeps[:-1]):
        found = stored(backward(below, found), "merkle-proofs")
    if len(top_sweeps) == 1:
        found = tops.withColumn("proof", nothing)
    found = found.select(F.col("below").alias("tree"), F.lit(0).cast("long").alias("position"), "proof",
                         F.col("digest").alias("subroot"))
    for k, below in enumerate(reversed(sweeps[:-1])):
        found = backward(below, found)
        if k < len(sweeps) - 2:
            found = stored(found, "merkle-proofs")
    if len(sweeps) == 1:
        found = nodes.join(found.select("tree", "proof", "subroot"), "tree")
    return found.select(F.col("key").alias(order), F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"),
                        "proof", *[F.col(k).alias(k.removeprefix("carried_")) for k in extra])
