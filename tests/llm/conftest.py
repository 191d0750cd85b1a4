import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import edge_rows  # noqa: E402


@pytest.fixture(scope="session")
def edge(spark):
    return edge_rows.edge_docs(spark).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return edge_rows.no_docs(spark)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    """(doc_id, text, lang, source) of the small table, as Python rows."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    return [tuple(r) for r in rows]
