import hashlib
import random
import zlib

import pytest
from edge_rows import TEXTS

from reviewlake.llm import merkle_manifest, queries


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][k:k + 8]) for k in range(0, len(out[-1]), 8)])
    return out


def mates(tree, i):
    for level in tree[:-1]:
        run = level[i // 8 * 8:i // 8 * 8 + 8]
        yield run[:i % 8], run[i % 8 + 1:]
        i //= 8


def brute(rows):
    """Rows (doc_id, source, lang, n_chars, text) to sorted (doc_id, leaf, subroot, root, siblings)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(r)))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: levels([x[2] for x in sorted(groups[k])]) for k in names}
    top = levels([trees[k][-1][0] for k in names])
    out = []
    for j, k in enumerate(names):
        for i, (known, doc, d) in enumerate(sorted(groups[k])):
            proof = [("".join(a), "".join(b)) for a, b in [*mates(trees[k], i), *mates(top, j)]]
            out.append((doc if known else None, d, trees[k][-1][0], top[-1][0], proof))
    return sorted(out, key=repr)


def given(df):
    rows = merkle_manifest.manifest(df).select("doc_id", "leaf", "subroot", "root", "proof").collect()
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, [(s.before, s.after) for s in r.proof]) for r in rows), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")


@pytest.mark.parametrize("levels_in_block", [1, 2, 4])
def test_against_recursion(spark, monkeypatch, levels_in_block):
    """Trees of 1 to 700 leaves, more languages than one run; small blocks need several sweeps."""
    monkeypatch.setattr(merkle_manifest, "BLOCK_LEVELS", levels_in_block)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 8 ** levels_in_block)
    rng = random.Random(levels_in_block)
    sizes = [1, 2, 7, 8, 9, 63, 64, 65, 700, 1, 3, 513]
    langs = [None, "é", *"abcdefghij"]
    rows = [(None, "s", lang, None, rng.choice(["é😀", None, "", "Text"])) for lang, n in zip(langs, sizes) for _ in range(n)]
    rows = [(i * 3, *r[1:]) for i, r in enumerate(rows)]
    rng.shuffle(rows)
    assert given(table(spark, rows)) == brute(rows)


def test_query_folds(spark, sf_dir):
    """Only texts that tampering changes lead to another root."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in queries.QUERIES["op12_merkle_manifest"](spark, sf_dir).collect():
        text = docs[r.doc_id].text
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and lower != (text or "")
        assert r.verified == (not changed) and (r.folded_root == r.root) == r.verified


def test_edge_rows(spark, edge, nothing):
    df = edge.withColumns({"n_chars": merkle_manifest.F.length("text").cast("long"), "tree": merkle_manifest.F.lit("x"), "digest": merkle_manifest.F.lit(1)})
    rows = [(i, source, lang, None if text is None else len(text), text) for i, text, lang, source in TEXTS]
    assert given(df) == brute(rows)
    assert merkle_manifest.manifest(nothing.withColumn("n_chars", merkle_manifest.F.lit(1))).count() == 0
    one = rows[:1]
    assert given(table(spark, one)) == brute(one) == [(one[0][0], leaf(one[0]), leaf(one[0]), leaf(one[0]), [])]


def test_sweeps_deliver_by_label():
    nodes = [str(i) for i in range(70)]
    found = merkle_manifest.sent_up(nodes, 3)
    assert found == [d for level in levels(nodes) for d in level]
    proofs = merkle_manifest.sent_down(found, 70, 3, (("x", "y"),))
    assert [list(p) for p in proofs] == [[*(("".join(a), "".join(b)) for a, b in mates(levels(nodes), i)), ("x", "y")] for i in range(70)]
