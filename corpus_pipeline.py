"""From raw documents to token ids: language ID, near duplicates, personal data, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept.  All but the last return the
columns of ``documents``:

* language: rows whose language can't be told (null text, no letter) go; the model is learned from the labelled rows;
* near_duplicates: of each group of documents with similarity 0.8 or more, the one with the smallest id stays;
* personal_data: values in ``text`` become pseudonyms, ``n_chars`` follows;
* mix: each document is repeated as often as the mix asks for, 0 to 3 times; sources weigh 5, 2, 1 in turn;
* tokens: doc_id, n_tokens and ids, one row per repetition.

SQL can express none of language, near_duplicates, mix and tokens, so ORACLE_SQL is None.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlake.llm import bpe_lexicon, entropy_mix, language_kernel, minmax_dedup, pseudonyms
from reviewlake.llm.common import stored
from reviewlake.llm.queries import TOKENIZER

ORACLE_SQL = None
SIMILAR_PERCENT = 80


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_kernel.accepted(docs, language_kernel.learn(docs, ~language_kernel.held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minmax_dedup.one_of_each(docs, percent=SIMILAR_PERCENT)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = pseudonyms.pseudonymized(docs, private="_private")
    length = F.when(F.size("_private") > 0, F.length("text")).otherwise(F.col("n_chars"))
    return rows.withColumn("n_chars", length.cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = entropy_mix.mixed(docs, F.col("source"), entropy_mix.words_in(F.col("text")), F.col("doc_id"))
    copies = F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(1), F.col("copies"))).otherwise(F.array().cast("array<int>")))
    return rows.withColumn("_copy", copies).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = bpe_lexicon.tokenized(docs.select("doc_id", "text"), TOKENIZER)
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix", mix),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next stage."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
