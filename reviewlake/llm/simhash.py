"""SimHash fingerprints and the exact search for fingerprints within a Hamming radius, in DataFrame operations only.

Terms are the words of a text, each together with its successor (the last word stands alone).  A term's weight is its
number of occurrences.  A term is hashed to BITS bits; each bit votes +1 or -1, weighted, and the signs of the sums are the
fingerprint.  Two votes share one long (32 bits each, which no text can overflow), so the whole vote is a sum of BITS / 2
longs per document that Spark combines before the shuffle.

The search builds one table per way to choose the blocks that must agree: with radius + 1 blocks at least one is equal, so
every pair within the radius meets in some table (pigeonhole), and is then compared on all bits.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlake.llm.common import ranked, stored

WORD_BREAK = r"[\x20\x09-\x0D]+"
BITS = 128
_LANES = BITS // 2
_MASK = 0x0000000100000001


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """Group the texts by ``keys`` and add ``high`` and ``low`` (64 bits each).

    A null or empty text, or one of white space, has no votes; its fingerprint is 0.  Keys may be null.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), WORD_BREAK), lambda w: w != "")
    listed = rows.select(*keys, words.alias("_words"))
    listed = listed.select(*keys, F.explode_outer(
        F.transform("_words", lambda w, i: F.xxhash64(w, F.get("_words", i + 1)))).alias("_h"))
    halves = {"high": F.col("_h"), "low": F.when(F.col("_h").isNotNull(), F.xxhash64(F.col("_h"), F.lit("low")))}
    votes = [F.sum(F.shiftrightunsigned(h, i).bitwiseAND(F.lit(_MASK))).alias(f"{name}{i}")
             for name, h in halves.items() for i in range(32)]
    summed = listed.groupBy(*keys).agg(F.count("_h").alias("_n"), *votes).na.fill(0, [f"{name}{i}" for name in halves for i in range(32)])

    def packed(name: str) -> Column:
        bits = F.lit(0).cast("long")
        for i in range(32):
            low, high = F.col(f"{name}{i}").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(f"{name}{i}", 32)
            bits = bits.bitwiseOR(F.when(low * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
            bits = bits.bitwiseOR(F.when(high * 2 > F.col("_n"), F.shiftleft(F.lit(1).cast("long"), i + 32)).otherwise(F.lit(0).cast("long")))
        return bits

    return summed.select(*keys, packed("high").alias("high"), packed("low").alias("low"))


def hexed(high: Column, low: Column) -> Column:
    """The fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(high), 16, "0"), F.lpad(F.hex(low), 16, "0")))


def distance(high_a: Column, low_a: Column, high_b: Column, low_b: Column) -> Column:
    """Number of bits that differ."""
    return F.bit_count(high_a.bitwiseXOR(high_b)) + F.bit_count(low_a.bitwiseXOR(low_b))


def likeness(high_a: Column, low_a: Column, high_b: Column, low_b: Column) -> Column:
    """1 for equal fingerprints, 0 for opposite ones."""
    return 1 - distance(high_a, low_a, high_b, low_b) / F.lit(float(BITS))


def _block(high: Column, low: Column, start: int, stop: int) -> Column:
    """Bits start .. stop - 1 of the fingerprint (at most 64), counted from the highest of ``high``."""
    def part(word: Column, a: int, b: int) -> Column:
        return F.shiftrightunsigned(F.shiftleft(word, a), 64 - (b - a)) if b - a < 64 else word
    if stop <= 64:
        return part(high, start, stop)
    if start >= 64:
        return part(low, start - 64, stop - 64)
    return F.shiftleft(part(high, start, 64), stop - 64).bitwiseOR(part(low, 0, stop - 64))


def near_pairs(prints: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """All pairs of different fingerprints within ``radius`` bits: (high_a, low_a, high_b, low_b, bits).

    ``prints`` has columns high and low; equal fingerprints count once, so copies are never expanded.  ``blocks`` (radius + 1
    unless given) cuts the fingerprint; each choice of blocks - radius of them is one permuted table.  More blocks mean
    more tables with longer, more selective keys.
    """
    blocks = blocks or radius + 1
    if not radius < blocks <= BITS:
        raise ValueError("blocks must be above the radius, and at most the number of bits")
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    h, low = F.col("high"), F.col("low")
    tables = [F.struct(F.lit(number).alias("number"), F.xxhash64(*[_block(h, low, edges[b], edges[b + 1]) for b in chosen]).alias("key"))
              for number, chosen in enumerate(combinations(range(blocks), blocks - radius))]
    placed = prints.select("high", "low").distinct().select("high", "low", F.explode(F.array(*tables)).alias("at")).select(
        F.col("at.number").alias("number"), F.col("at.key").alias("key"), "high", "low")
    a, b = (placed.select("number", "key", h.alias(f"high_{x}"), low.alias(f"low_{x}")) for x in "ab")
    bits = distance(*map(F.col, ("high_a", "low_a", "high_b", "low_b")))
    before = (F.col("high_a") < F.col("high_b")) | ((F.col("high_a") == F.col("high_b")) & (F.col("low_a") < F.col("low_b")))
    return a.join(b, ["number", "key"]).where(before & (bits <= radius)).select(
        "high_a", "low_a", "high_b", "low_b", bits.alias("bits")).distinct()


def edited_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Each document beside its edited text, and which document comes next.

    Documents go in descending order of their ids (null last; equal ids in order of their text's hash); after the last
    comes the first.  The edit replaces the last third of the code points by the first as many of the next document.
    Rows with equal id and text are one document.  A null text counts as empty.

    Returns (id, hash, text, edited) and (id, hash, n_chars, next_id, next_hash).  Ids and hashes find their neighbours
    first; then every text moves once, and the heads that are wanted of it once.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    texts = docs.select(F.col(doc_id).alias("id"), F.xxhash64(body).alias("hash"), body.alias("text"))
    ids = texts.select("id", "hash", F.length("text").alias("n_chars")).distinct()
    places = stored(ranked(ids, [F.col("id").desc_nulls_last(), F.col("hash").asc()], "place"), "places")
    last = places.count()
    after = places.select((F.pmod(F.col("place") - 2, F.lit(max(last, 1))) + 1).alias("place"),
                          F.col("id").alias("next_id"), F.col("hash").alias("next_hash"))
    links = stored(places.join(after, "place").drop("place"), "neighbours")
    wanted = links.select(F.col("id").alias("for_id"), F.col("hash").alias("for_hash"), "next_id", "next_hash",
                          F.floor(F.col("n_chars") / 3).cast("int").alias("take"))
    heads = (
        texts.join(wanted, F.col("id").eqNullSafe(F.col("next_id")) & (F.col("hash") == F.col("next_hash")))
        .select("for_id", "for_hash", "take", F.substr("text", F.lit(1), F.col("take")).alias("head"))
        .dropDuplicates(["for_id", "for_hash"]))
    edited = texts.join(heads, F.col("id").eqNullSafe(F.col("for_id")) & (F.col("hash") == F.col("for_hash"))).select(
        "id", "hash", "text", F.concat(F.substr("text", F.lit(1), F.length("text") - F.col("take")), "head").alias("edited"))
    return edited, links
