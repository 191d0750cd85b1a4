"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reviewlake.session import scratch_path

BATCH_ROWS = 512
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Rows per Arrow batch: texts can be long, so a batch holds few (Spark also bounds its bytes)."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: computed once, safe when executors are lost.

    The shuffle files of the write are of no use after it, so Spark is asked to delete them at once.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its n + 1 offsets; a null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    wide = np.int64 if pa.types.is_large_string(column.type) else np.int32
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(offsets, wide)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return whole[ends[0]:ends[-1]], ends - ends[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finalizer: spreads all bits of a 64-bit value."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def distinct(x: np.ndarray) -> np.ndarray:
    """The distinct values in order (numpy's own function takes many times as long for large arrays)."""
    x = np.sort(x)
    return x[np.concatenate([np.ones(min(len(x), 1), bool), x[1:] != x[:-1]])]


def drawn(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd 64-bit constants."""
    with np.errstate(over="ignore"):
        return mix64(np.uint64(seed) + GOLDEN * np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)


def power_table(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1) modulo 2 ** 64."""
    out = np.full(max(n, 1), np.uint64(base & 0xFFFFFFFFFFFFFFFF))
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``name`` = 1-based rank in the whole table by ``order``, without a task that holds all rows.

    Rows are sorted by ranges and written; the rank is the row's place in its range plus the sizes of the ranges before.
    """
    place = F.monotonically_increasing_id()  # range in the upper bits, place in the lower 33
    laid = stored(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place), "ranked")
    laid = laid.withColumn("_range", F.shiftright("_place", 33))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = laid.groupBy("_range").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1) + 1
    return laid.join(sizes, "_range").withColumn(name, rank).drop("_range", "_place", "_before")


def runs_of(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Adjacent rows with equal whole-number ``keys``, one table at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_numpy() for k in keys]
        changed = np.zeros(max(len(columns[0]) - 1, 0), bool)
        for c in columns:
            changed |= c[1:] != c[:-1]
        cuts = [0, *(changed.nonzero()[0] + 1).tolist(), len(columns[0])]
        for a, b in zip(cuts, cuts[1:]):
            if a == b:
                continue
            key = tuple(int(c[a]) for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
