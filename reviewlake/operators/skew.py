"""Building blocks that keep a hot group from landing in one task or one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlake.session import cut_lineage

CHUNK = 10_000


def first_rows(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows per group.

    ``row_number() <= n`` lets Spark drop rows in every map task before the shuffle, so a hot
    group sends at most ``n`` rows per task.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def numbered(df: DataFrame, keys: list[str], ordinal: str, name: str, width: int = CHUNK) -> DataFrame:
    """Add ``name`` = 1-based rank by a whole-number ``ordinal`` that is unique within ``keys``.

    Groups are cut into ranges of ``width`` ordinals.  A range holds at most ``width`` rows, so it
    is ranked in one small window; the ranks before it come from the range counts.
    """
    cut = df.withColumn("_range", F.floor(F.col(ordinal) / width))
    ranges = cut.groupBy(*keys, "_range").agg(F.count("*").alias("_rows"))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select(*keys, "_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(ordinal)
    return (
        cut.withColumn("_inside", F.row_number().over(inside))
        .join(ranges, [*keys, "_range"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_range", "_inside", "_before")
    )


def ranked(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name`` = 1-based rank within ``keys`` by ``order``, for groups too large for one task.

    Rows are sorted by ranges, so a large group spans several; a row's rank is its place in its range plus the group's
    rows in the ranges before.  The sorted rows are written first: both sides of the join see the same places.
    """
    by = [F.col(c) for c in [*keys, *order]]
    laid = cut_lineage(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id()))
    laid = laid.withColumn("_range", F.shiftright("_place", 33))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = laid.groupBy(*keys, "_range").agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    ranges = ranges.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    rank = F.col("_before") + F.col("_place") - F.col("_first") + 1
    return laid.join(ranges, [*keys, "_range"]).withColumn(name, rank).drop("_place", "_range", "_first", "_before")


def nested(
    df: DataFrame, keys: list[str], item: Column, name: str, order: list[str], chunk: int = CHUNK
) -> DataFrame:
    """Collect ``item`` structs per group into arrays of at most ``chunk`` items, in the order of ``order``.

    Rows come as (keys, ``part``, ``parts``, ``name``): part 0 holds the first ``chunk`` rows, part 1 the next, by the
    same rule for every size, so a group's arrays, part after part, are the group in order.  Sizes are counted
    first (keys only, combined before the shuffle): a group of one part is one aggregation; a larger one is ranked
    over many tasks, and no task holds more than a part.
    """
    place = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])
    sizes = df.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > chunk)
    large = cut_lineage(sizes.select(*keys, F.ceil(F.col("_rows") / chunk).cast("int").alias("parts")))

    def collected(rows: DataFrame, *by: str) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct(place.alias("place"), item.alias("item"))))
        return rows.groupBy(*keys, *by).agg(F.transform(items, lambda i: i["item"]).alias(name))

    if large.isEmpty():
        return collected(df).select(*keys, F.lit(0).alias("part"), F.lit(1).alias("parts"), name)
    small = collected(df.join(large, keys, "left_anti")).select(*keys, F.lit(0).alias("part"), F.lit(1).alias("parts"), name)
    cut = ranked(df.join(large, keys), keys, order, "_rank").withColumn("part", F.floor((F.col("_rank") - 1) / chunk).cast("int"))
    return small.unionByName(collected(cut, "part", "parts"))
