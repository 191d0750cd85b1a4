"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing names."""

LONG = ("lorem ipsum dolor sit amet " * 12_000) + "end"
TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood", "en", "a"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark wood", "en", "a"),
    (3, "", "en", "b"),
    (4, None, "fr", None),
    (5, " \t\n ", None, "b"),
    (6, "one", "en", "c"),
    (7, LONG, "en", None),
    (None, "a text without an id, but with words enough for two shingles or so", "en", "a"),
    (None, None, None, None),
    (8, "Ünïcödé 😀 über straße señor niño garçon", "de", "é"),
    (9, "1234567890 !!! ???", "de", "b"),
    (6, "one", "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def edge_docs(spark):
    """The rows with columns whose names clash with those that operators add."""
    rows = [(*r, "x", "y", 1, 2.0) for r in TEXTS]
    return spark.createDataFrame(rows, SCHEMA + ", private string, ids string, copies int, score double")


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
