import hashlib
import random
from itertools import combinations

from reviewlake.llm import queries, simhash


def edited(docs):
    """Edited text of each (id, text) by the letter."""
    docs = sorted(docs, reverse=True)
    out = {}
    for k, (i, text) in enumerate(docs):
        n = len(text) // 3
        out[i] = text[:len(text) - n] + docs[(k + 1) % len(docs)][1][:n]
    return out


def test_query(spark, sf_dir, documents):
    texts = {d[0]: d[1] or "" for d in documents}
    want = edited(texts.items())
    rows = queries.QUERIES["op2_simhash"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        assert r.n_chars == len(texts[r.doc_id])
        assert r.edited_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
        bits = bin(int(r.fingerprint, 16) ^ int(r.edited_fingerprint, 16)).count("1")
        assert len(r.fingerprint) == 32 and r.near_edited == 1 - bits / 128
    same = {}
    for r in rows:
        assert same.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.98 * len(rows)


def test_votes_against_plain_sums(spark):
    """The packed votes equal one sum per bit over the same hashes."""
    rng = random.Random(2)
    texts = [(k, " ".join(rng.choice("abcdef") * rng.randint(1, 3) for _ in range(rng.randint(0, 40)))) for k in range(40)]
    docs = spark.createDataFrame(texts, "k int, text string")
    docs.createOrReplaceTempView("simhash_texts")
    terms = spark.sql("""
        SELECT k, transform(w, (x, i) -> xxhash64(x, get(w, i + 1))) AS h,
               transform(transform(w, (x, i) -> xxhash64(x, get(w, i + 1))), x -> xxhash64(x, 'low')) AS l
        FROM (SELECT k, filter(split(text, ' '), x -> x <> '') AS w FROM simhash_texts)""").collect()
    want = {}
    for r in terms:
        word = lambda hashes: sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))
        want[r.k] = (word(r.h), word(r.l))
    for r in simhash.fingerprints(docs, ["k"], "text").collect():
        assert (r.high & (1 << 64) - 1, r.low & (1 << 64) - 1) == want[r.k]


def test_all_pairs_within_the_radius(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(128) for _ in range(30)]
    prints = set(base)
    for b in base:
        for _ in range(4):
            near = b
            for bit in rng.sample(range(128), rng.randint(0, 5)):
                near ^= 1 << bit
            prints.add(near)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(signed(p >> 64), signed(p & (1 << 64) - 1)) for p in prints]
    table = spark.createDataFrame(rows + rows[:5], "high long, low long")
    whole = lambda h, l: (h & (1 << 64) - 1) << 64 | l & (1 << 64) - 1
    for radius, blocks in ((0, None), (3, None), (3, 5), (4, 6)):
        want = {frozenset(p): n for p in combinations(prints, 2) if (n := bin(p[0] ^ p[1]).count("1")) <= radius}
        got = simhash.near_pairs(table, radius, blocks).collect()
        assert {frozenset((whole(r.high_a, r.low_a), whole(r.high_b, r.low_b))): r.bits for r in got} == want
        assert len(got) == len(want)


def test_edge_rows(edge, nothing):
    rows, links = simhash.edited_texts(edge)
    assert links.count() == 11
    got = simhash.fingerprints(rows, ["id", "hash"], "text").collect()
    assert len(got) == 11
    assert all(r.high == r.low == 0 for r in got if r.id in (3, 4, 5))
    assert simhash.edited_texts(nothing)[0].count() == 0
