"""When do two findings describe the same problem?"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A shared keyword makes two messages similar.
KEYWORDS = (
    "collect", "cache", "broadcast", "join", "schema", "password", "credentials",
    "udf", "rdd", "partition", "count", "null", "hardcoded",
)
MIN_OVERLAP = 0.6


def features(message: Column, line_number: Column, category: Column) -> Column:
    """Everything the test needs, computed once per finding instead of once per comparison."""
    text = F.lower(F.coalesce(message, F.lit("")))
    bits = [F.when(text.contains(k), 1 << i).otherwise(0) for i, k in enumerate(KEYWORDS)]
    return F.struct(
        F.coalesce(line_number, F.lit(0)).cast("int").alias("line"),
        reduce(lambda a, b: a.bitwiseOR(b), bits).alias("keywords"),
        category.alias("category"),
        distinct_words(text).alias("words"),
    )


def distinct_words(text: Column) -> Column:
    """The distinct words of a text.  ``split`` compiles its pattern for each row unless it is a single plain character."""
    return F.array_distinct(F.split(F.regexp_replace(text, r"[\s\x{a0}\x{feff}]+", " "), " "))


def is_similar(a: Column, b: Column) -> Column:
    """Same non-zero line, or a shared keyword, or same category and more than 60 % common words."""
    same_line = (a["line"] != 0) & (a["line"] == b["line"])
    shared_keyword = a["keywords"].bitwiseAND(b["keywords"]) != 0
    common = F.size(F.array_intersect(a["words"], b["words"]))
    overlap = common / F.greatest(F.size(a["words"]), F.size(b["words"])) > MIN_OVERLAP
    return same_line | shared_keyword | (a["category"].eqNullSafe(b["category"]) & overlap)


BUCKETS = 4096


def bucket(word: Column) -> Column:
    """Bucket of a word, which tasks can compute as well (see :func:`reviewlake.operators.holders.rarest_first`)."""
    return F.crc32(word.cast("binary")) % BUCKETS


def word_rarity(findings: DataFrame, times: Column | None = None) -> bytes:
    """One byte per word bucket that grows with the bucket's number of words in ``f.words``; a row counts ``times``.

    BUCKETS numbers, whatever the input: any order of words gives the same results, a better one compares less.
    """
    words = findings.select(F.explode("f.words").alias("word"), (F.lit(1) if times is None else times).alias("times"))
    counts = words.groupBy(bucket(F.col("word")).alias("bucket")).agg(F.sum("times")).collect()
    out = bytearray(BUCKETS)
    for k, n in counts:
        out[k] = min(255, int(8 * math.log2(n + 1)))
    return bytes(out)


def rarest_first(words: Column, rarity: bytes) -> Column:
    """The words in the common order of :func:`word_rarity`."""
    def place(w: Column) -> Column:
        at = bucket(w).cast("int") + 1
        return F.struct(F.substring(F.lit(rarity), at, F.lit(1)).alias("rarity"), w.alias("word"))

    return F.transform(F.array_sort(F.transform(words, place)), lambda p: p["word"])
