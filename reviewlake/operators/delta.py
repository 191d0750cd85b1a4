"""Line counts between two versions of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_delta(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("path",)) -> DataFrame:
    """Added, removed and common lines per file, as multisets of lines.

    Both versions are one stream of (file, line, +1) rows; equal lines are added up before the
    shuffle.  The second aggregation needs only the counts.
    """

    def lines(df: DataFrame, old_rows: int) -> DataFrame:
        return df.select(
            *keys, F.explode(F.split("content", "\n")).alias("line"),
            F.lit(old_rows).alias("o"), F.lit(1 - old_rows).alias("n"),
        )

    counts = lines(old, 1).unionByName(lines(new, 0)).groupBy(*keys, "line").agg(
        F.sum("o").alias("o"), F.sum("n").alias("n")
    )
    return counts.groupBy(*keys).agg(
        F.sum(F.greatest(F.col("n") - F.col("o"), F.lit(0))).alias("added"),
        F.sum(F.greatest(F.col("o") - F.col("n"), F.lit(0))).alias("removed"),
        F.sum(F.least("o", "n")).alias("common"),
    )
