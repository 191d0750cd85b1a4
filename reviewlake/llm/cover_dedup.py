"""Repeated passages by blockwise suffix sorting with a difference cover.

A byte goes if a string of LENGTH bytes around it also starts in a document with a smaller id.  That needs the suffixes of
all documents in order, up to LENGTH bytes.  Memory stays bounded by three steps:

1. Cover sample.  COVER is a difference cover modulo PERIOD: any two offsets have a shift below PERIOD that takes both onto
   sampled ones.  So two equal strings of LENGTH bytes hold the same LENGTH - PERIOD + 1 bytes at a sampled offset.  Only
   the samples (5 of 21 suffixes) are named, dealt into buckets and sorted, which tells for each sample whether its
   name also occurs in another document.
2. Suffix buckets.  A suffix whose string holds no such sample is unique; most are, and go no further.  The others are
   dealt into buckets by their name (64 bits of LENGTH bytes); one task sorts one bucket at a time.  A tie means equal
   strings, and the smallest document of a tie keeps its copy.
3. Each block of documents learns in one bit per sorted suffix whether an earlier block holds it, and cuts its texts.

Exact copies of a smaller document are left out of all this: they go as a whole.

Names are hashes: a bucket's order is that of the names, not of the alphabet, as only ties matter here.  Documents
travel in blocks of about BLOCK_BYTES in the order of their ids; names travel sorted, as differences.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import distinct, mix64, power_table, small_batches, stored, text_bytes

LENGTH = 50
PERIOD = 21
COVER = (3, 6, 7, 12, 14)
BLOCK_BYTES = 2 << 20
SAMPLE_BUCKET_BYTES = 16 << 20
SUFFIX_BUCKET_BYTES = 8 << 20
SAMPLE_BITS = 40
NULL_ID = np.iinfo(np.int64).max

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
BLOCK = "block long, first long, ids array<long>, ends array<long>, data binary"


def with_copies(docs: DataFrame, doc_id: str, text: str, length: int) -> DataFrame:
    """(id, text, copy): ``copy`` marks texts of at least ``length`` bytes that a document with a smaller id has too."""
    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.coalesce(text, F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2("text", 256))
    order = F.coalesce("id", F.lit(NULL_ID))
    firsts = rows.groupBy("digest").agg(F.min(order).alias("first"))
    return rows.join(firsts, "digest").select(
        "id", "text", ((order > F.col("first")) & (F.octet_length("text") >= length)).alias("copy"))


def blocks_of(rows: DataFrame) -> DataFrame:
    """(id, text) rows in id order (null last), cut into blocks.

    A block holds whole runs of equal ids, or part of one run: so of two blocks with different first ids, all ids of one
    are smaller than those of the other.
    """
    small_batches(rows.sparkSession)
    order = F.col("id").asc_nulls_last()
    rows = rows.repartitionByRange(order).sortWithinPartitions(order)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=3)

        def block(runs: list[tuple[int, list[bytes]]]) -> pa.RecordBatch:
            ids = [i for i, texts in runs for _ in texts]
            texts = [t for _, ts in runs for t in ts]
            return pa.RecordBatch.from_pydict({
                "first": pa.array([ids[0]], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int64())),
                "ends": pa.array([np.cumsum([0, *map(len, texts)])], pa.list_(pa.int64())),
                "data": pa.array([squeeze.compress(b"".join(texts))], pa.binary())})

        whole: list[tuple[int, list[bytes]]] = []  # runs that are complete, and the one that is coming
        size, part = 0, False  # part: the block that is coming goes on with a run that was cut
        for batch in batches:
            data, ends = text_bytes(batch.column(1))
            for k, i in enumerate(batch.column(0).to_pylist()):
                t = data[ends[k]:ends[k + 1]].tobytes()
                if whole and whole[-1][0] != i and (part or size >= BLOCK_BYTES):
                    yield block(whole)
                    whole, size, part = [], 0, False
                elif whole and whole[-1][0] == i and size + len(t) > BLOCK_BYTES:
                    if len(whole) > 1:
                        yield block(whole[:-1])
                        whole = whole[-1:]
                        size = sum(map(len, whole[0][1]))
                    if size + len(t) > BLOCK_BYTES:
                        yield block(whole)
                        whole, size, part = [], 0, True
                if not whole or whole[-1][0] != i:
                    whole.append((i, []))
                whole[-1][1].append(t)
                size += len(t)
        if whole:
            yield block(whole)

    cuts = rows.mapInArrow(cut, "first long, ids array<long>, ends array<long>, data binary")
    return stored(cuts.select(F.monotonically_increasing_id().alias("block"), "*"), "blocks")


def pack(values: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte plane after byte plane: high planes are mostly zero and compress away."""
    deltas = np.diff(values, prepend=np.uint64(0))
    width = max(1, (int(deltas.max()).bit_length() + 7) // 8) if len(deltas) else 1
    planes = deltas.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return bytes([width]) + planes.T.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, :width] = planes.T
    return np.cumsum(out.view("<u8").ravel().astype(np.uint64), dtype=np.uint64)


class Block:
    """Texts of one block as one byte array, with running polynomial sums that name any substring."""

    def __init__(self, ids: list[int | None], ends: list[int], data: bytes, length: int):
        raw = zstandard.ZstdDecompressor().decompress(data, max_output_size=max(ends[-1], 1)) if ends[-1] else b""
        self.data, self.length = np.frombuffer(raw, np.uint8), length
        self.ids = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        self.ends = np.asarray(ends, np.int64)
        sizes = np.diff(self.ends)
        rank = np.unique(self.ids, return_inverse=True)[1].astype(np.int32)
        self.rank = np.repeat(rank, sizes)
        self.at = np.arange(len(self.data)) - np.repeat(self.ends[:-1], sizes)
        self.left = np.repeat(sizes, sizes) - self.at
        self.sums = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power_table(_BASE, len(self.data))[:len(self.data)],
                  out=self.sums[1:])
        self.back = power_table(_INVERSE, len(self.data) + 1)

    def names(self, starts: np.ndarray, length: int) -> np.ndarray:
        return mix64((self.sums[starts + length] - self.sums[starts]) * self.back[starts])

    def sample(self) -> tuple[np.ndarray, np.ndarray]:
        """Starts of the cover sample and their names."""
        size = self.length - PERIOD + 1
        member = np.zeros(PERIOD, bool)
        member[list(COVER)] = True
        starts = np.flatnonzero(member[self.at % PERIOD] & (self.left >= size))
        return starts, self.names(starts, size) >> np.uint64(64 - SAMPLE_BITS)

    def sorted_names(self, starts: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct names in order, each start's place among them, and the lowest and highest document rank of each."""
        order = np.argsort(names)
        ordered = names[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(len(ordered), 1), bool), ordered[1:] != ordered[:-1]]))
        place = np.empty(len(names), np.int64)
        place[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(ordered))))
        if not len(first):
            return ordered, place, np.empty(0, np.int32), np.empty(0, np.int32)
        ranks = self.rank[starts[order]]
        return ordered[first], place, np.minimum.reduceat(ranks, first), np.maximum.reduceat(ranks, first)

    def candidates(self, bits: np.ndarray | None) -> np.ndarray:
        """Starts of LENGTH bytes that hold a sample whose name is in another document."""
        starts, names = self.sample()
        distinct, place, low, high = self.sorted_names(starts, names)
        shared = low != high
        if bits is not None:
            shared |= bits[:len(distinct)]
        marks = np.zeros(len(self.data) + 1, np.int32)
        marks[starts[shared[place]] + 1] = 1
        count = np.cumsum(marks)
        possible = np.flatnonzero(self.left >= self.length)
        return possible[count[np.minimum(possible + PERIOD, len(self.data))] > count[possible]]


def _bits(rows: DataFrame) -> DataFrame:
    """One row per block: its bits of all buckets, in bucket order."""
    item = F.struct("bucket", "n", "bits")
    return rows.groupBy("block").agg(F.sort_array(F.collect_list(item)).alias("parts"))


def _joined_bits(parts: list[dict] | None) -> np.ndarray | None:
    if not parts:
        return None
    return np.concatenate([np.unpackbits(np.frombuffer(p["bits"], np.uint8))[:p["n"]].astype(bool) for p in parts])


def _buckets(total: int, each: int) -> int:
    """Number of leading bits that tell the buckets apart."""
    return min(max(0, (max(total, 1) // each).bit_length()), 30)


def _dealt(block: int, first: int | None, names: np.ndarray, width: int, lead: int) -> pa.RecordBatch:
    """Sorted names of one block, one packed row per bucket."""
    bucket = (names >> np.uint64(width - lead)).astype(np.int64) if lead else np.zeros(len(names), np.int64)
    cuts = np.flatnonzero(np.diff(bucket)) + 1
    parts = np.split(names, cuts) if len(names) else []
    keys = bucket[np.concatenate([[0], cuts])] if len(names) else bucket
    rest = np.uint64((1 << (width - lead)) - 1)
    return pa.RecordBatch.from_pydict({
        "bucket": pa.array(keys, pa.int64()), "block": pa.array([block] * len(parts), pa.int64()),
        "first": pa.array([NULL_ID if first is None else first] * len(parts), pa.int64()),
        "names": pa.array([pack(p & rest) for p in parts], pa.binary())})


def _sorted_bucket(smaller: bool):
    """Sort the suffix names of one bucket; for each say whether a smaller (or else any other) document holds it too."""
    def sort(t: pa.Table) -> pa.Table:
        lists = [unpack(p) for p in t["names"].to_pylist()]
        sizes = [len(x) for x in lists]
        names, first = np.concatenate(lists), np.repeat(t["first"].to_numpy(), sizes)
        order = np.argsort(names)
        names = names[order]
        starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
        runs = np.diff(np.append(starts, len(names)))
        firsts = first[order]
        low = np.repeat(np.minimum.reduceat(firsts, starts), runs)
        told = low < firsts if smaller else low != np.repeat(np.maximum.reduceat(firsts, starts), runs)
        out = np.empty(len(names), bool)
        out[order] = told
        packed = [np.packbits(x).tobytes() for x in np.split(out, np.cumsum(sizes)[:-1])]
        return pa.table({"block": t["block"], "bucket": t["bucket"], "n": pa.array(sizes, pa.int32()),
                         "bits": pa.array(packed, pa.binary())})
    return sort


def repeated_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, spans, kept), one row per document.

    ``spans`` are the maximal runs of removed bytes (start, end exclusive) of the UTF-8 text, ``kept`` the remaining bytes.

    * A byte goes if it lies in ``length`` bytes of its document that also start in a document with a smaller id; that is
      judged on the input texts.  Matches never cross documents.
    * Null texts count as empty.  Texts shorter than ``length`` keep all bytes.
    * Rows with the same id are no smaller documents to each other; null ids are larger than all others and equal.
    * Other columns are not read.
    """
    if length < PERIOD:
        raise ValueError(f"length must be at least {PERIOD}")
    rows = with_copies(docs, doc_id, text, length)
    copies = stored(rows.where("copy").select("id", F.octet_length("text").cast("long").alias("n_bytes")), "copies")
    blocks = blocks_of(rows.where("NOT copy").select("id", "text"))
    total = blocks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    sample_lead, suffix_lead = _buckets(total, SAMPLE_BUCKET_BYTES), _buckets(total, SUFFIX_BUCKET_BYTES)
    small_batches(blocks.sparkSession, 8)
    dealt = "bucket long, block long, first long, names binary"
    answer = "block long, bucket long, n int, bits binary"

    def opened(batch: pa.RecordBatch) -> Iterator[tuple[int, int | None, Block, dict]]:
        for k in range(len(batch)):
            row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
            yield row["block"], row["first"], Block(row["ids"], row["ends"], row["data"], length), row

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, first, b, _ in opened(batch):
                yield _dealt(block, first, distinct(b.sample()[1]), SAMPLE_BITS, sample_lead)

    def suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, first, b, row in opened(batch):
                starts = b.candidates(_joined_bits(row["sampled"]))
                yield _dealt(block, first, distinct(b.names(starts, length)), 64, suffix_lead)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, b, row in opened(batch):
                starts = b.candidates(_joined_bits(row["sampled"]))
                distinct, place, low, _ = b.sorted_names(starts, b.names(starts, length))
                gone = low[place] < b.rank[starts]
                bits = _joined_bits(row["sorted"])
                if bits is not None:
                    gone |= bits[place]
                marks = np.zeros(len(b.data) + 1, np.int32)
                marks[starts[gone]] += 1
                marks[starts[gone] + length] -= 1
                removed = np.cumsum(marks)[:-1] > 0
                out = {"doc_id": row["ids"], "n_bytes": [], "spans": [], "kept": []}
                for a, e in zip(b.ends[:-1], b.ends[1:]):
                    mine = removed[a:e]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], mine, [False]]).astype(np.int8)))
                    out["n_bytes"].append(int(e - a))
                    out["spans"].append([{"start": int(s), "end": int(t)} for s, t in edges.reshape(-1, 2)])
                    out["kept"].append(b.data[a:e][~mine].tobytes())
                kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], names=list(out))

    sampled = blocks.select("block", "first", "ids", "ends", "data").mapInArrow(samples, dealt)
    sampled = stored(_bits(sampled.groupBy("bucket").applyInArrow(_sorted_bucket(False), answer)), "sample-bits")
    with_samples = blocks.join(sampled.withColumnRenamed("parts", "sampled"), "block", "left")
    names = with_samples.mapInArrow(suffixes, dealt)
    found = stored(_bits(names.groupBy("bucket").applyInArrow(_sorted_bucket(True), answer)), "suffix-bits")
    result = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"
    cuts = with_samples.join(found.withColumnRenamed("parts", "sorted"), "block", "left").mapInArrow(cut, result)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("end")))
    return cuts.union(copies.select(F.col("id").alias("doc_id"), "n_bytes", whole.alias("spans"), F.lit(b"").alias("kept")))
