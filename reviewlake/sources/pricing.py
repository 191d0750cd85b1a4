"""Model price list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.session import local_table

# USD per million input and output tokens.  The order matters: the first key that
# is a prefix of a model name prices it.
_PRICES = [
    ("claude-opus-4-20250514", 15.0, 75.0),
    ("claude-sonnet-4-20250514", 3.0, 15.0),
    ("claude-haiku-4-20250514", 0.25, 1.25),
    ("claude-opus-4", 15.0, 75.0),
    ("claude-sonnet-4", 3.0, 15.0),
    ("claude-haiku-4", 0.25, 1.25),
    ("claude-3-5-sonnet-20241022", 3.0, 15.0),
    ("claude-3-5-haiku-20241022", 0.80, 4.0),
    ("claude-3-opus-20240229", 15.0, 75.0),
    ("claude-3-sonnet-20240229", 3.0, 15.0),
    ("claude-3-haiku-20240307", 0.25, 1.25),
    ("gpt-4", 30.0, 60.0),
    ("gpt-4-turbo", 10.0, 30.0),
    ("gpt-4o", 2.50, 10.0),
    ("gpt-4o-mini", 0.15, 0.60),
    ("gpt-3.5-turbo", 0.50, 1.50),
]
PRICE_SCHEMA = "ordinal int, model_key string, input_per_m double, output_per_m double"


def price_rows() -> list[tuple[int, str, float, float]]:
    return [(i, *row) for i, row in enumerate(_PRICES, start=1)]


def scan_pricing(spark: SparkSession, overrides: DataFrame | None = None) -> DataFrame:
    """Price list; an override replaces a price in place, a new key goes to the end.

    ``overrides`` has ``ordinal, model_key, input_per_m, output_per_m``.
    """
    base = local_table(spark, price_rows(), PRICE_SCHEMA)
    if overrides is None:
        return base
    given = overrides.select(
        "model_key",
        (F.col("ordinal") + len(_PRICES)).alias("new_ordinal"),
        F.col("input_per_m").alias("new_input"),
        F.col("output_per_m").alias("new_output"),
    )
    joined = base.join(given, "model_key", "full_outer")
    replaced = F.col("new_ordinal").isNotNull()
    return joined.select(
        F.coalesce("ordinal", "new_ordinal").cast("int").alias("ordinal"),
        "model_key",
        F.when(replaced, F.col("new_input")).otherwise(F.col("input_per_m")).alias("input_per_m"),
        F.when(replaced, F.col("new_output")).otherwise(F.col("output_per_m")).alias("output_per_m"),
    )


def read_price_overrides(spark: SparkSession, json_text: str) -> DataFrame:
    """Overrides as a JSON object ``{model: {inputPerMillion, outputPerMillion}}``; bad JSON means none."""
    row = spark.range(1).select(
        F.from_json(F.lit(json_text), "map<string, struct<inputPerMillion:double, outputPerMillion:double>>").alias("m")
    )
    return row.select(F.posexplode(F.map_entries("m")).alias("pos", "e")).select(
        (F.col("pos") + 1).alias("ordinal"),
        F.col("e.key").alias("model_key"),
        F.col("e.value.inputPerMillion").alias("input_per_m"),
        F.col("e.value.outputPerMillion").alias("output_per_m"),
    )
