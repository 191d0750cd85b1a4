import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import pytest

from reviewlake.llm import path_ranks, queries

SCHEMA = "conv_id long, turn long, role string, text string"
sys.setrecursionlimit(20_000)
WHITE = " \t\n\x0b\x0c\r"


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if v is None else v for v in (role, text))
        key = ":".join(" " if v is None else str(v) for v in (conv, turn))
        way = zlib.crc32(key.encode()) % 20
        text = "" if way == 1 else re.sub("[.!?]", "", text) if way == 2 else text
        out += [(conv, turn, "user" if way == 4 else role, text)] * {0: 0, 3: 2}.get(way, 1)
    return out


def step(state, letter):
    return {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((state, letter))


def cheapest(rows):
    """Least (cost, audit, kept lines) by trying every edit at every row, at most two inserts in a row."""
    @lru_cache(None)
    def best(i, state, inserts):
        options = [(0, "", ())] if i == len(rows) and state in (0, 3) else []
        for letter, name in (("u", "user"), ("a", "assistant")):
            after = step(state, letter)
            if after is None:
                continue
            if inserts < 3:
                c, a, lines = best(i, after, inserts + 1)
                options.append((c + 2, "I" + a, (f"{name}:", *lines)))
            if i < len(rows) and rows[i][2] not in ("blank", "duplicate"):
                c, a, lines = best(i + 1, after, 0)
                options.append((c + 2 + (rows[i][2] == "truncated"), "R" + a, (f"{name}:{rows[i][1]}", *lines)))
        if i < len(rows):
            c, a, lines = best(i + 1, state, 0)
            options.append((c + 3, "D" + a, lines))
            after = step(state, rows[i][0][:1])
            if after is not None and rows[i][2] not in ("blank", "duplicate"):
                c, a, lines = best(i + 1, after, 0)
                options.append((c + (rows[i][2] == "truncated"), "K" + a, (f"{rows[i][0]}:{rows[i][1]}", *lines)))
        return min(options, default=(1 << 30, "", ()))

    return best(0, 0, 0)


def brute(conversations, damaged=damage):
    found = {c: [] for c, *_ in conversations}
    for r in damaged(conversations):
        found[r[0]].append(r)
    out = {}
    for conv, rows in found.items():
        digest = lambda r: hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()
        rows.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], digest(r)))
        seen, faulty = set(), []
        for _, _, role, text in rows:
            said = text.rstrip(WHITE)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "truncated" if said[-1] not in ".!?" else None
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [r[1] for r in rows if r[1] is not None]
        cost, audit, lines = cheapest(tuple(faulty))
        out[conv] = {
            "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            **{f: sum(x[2] == f for x in faulty) for f in path_ranks.FAULTS},
            "illegal": sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(faulty, faulty[1:])),
            "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(lines).encode()).hexdigest()}
    return out


def compare(found, want):
    assert len(found) == len(want)
    for r in found:
        got = {k: v for k, v in r.asDict().items() if k != "conv_id"}
        assert got == want[r.conv_id], (r.conv_id, got, want[r.conv_id])


def made(n, seed, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", "What?", "cut off", "", " \n", None, f"t{rng.randint(0, 99)}.", "Ünï。"])
            rows.append((conv, rng.choice([turn, turn, turn, turn, turn + 2, None]), role, text))
    rng.shuffle(rows)
    return rows


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    compare(queries.QUERIES["op11_structure_repair"](spark, sf_dir).collect(), brute(rows))


@pytest.mark.parametrize("bits", [16, 2, 1])
def test_against_every_edit(spark, monkeypatch, bits):
    """Small blocks: nearly every conversation crosses borders, some cross many."""
    monkeypatch.setattr(path_ranks, "BLOCK_BITS", bits)
    rows = made(150, bits, 14)
    compare(path_ranks.report(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows))


def test_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(path_ranks, "BLOCK_BITS", 5)
    rng = random.Random(3)
    rows = [(1, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", "Oh!"]) + str(t % 50) + rng.choice(["", "."])) for t in range(400)]
    rows += [(None, 1, "user", "Hi."), (None, 1, "user", "Hi."), (2, None, "assistant", "Ho.")]
    compare(path_ranks.report(spark.createDataFrame(rows, SCHEMA)).collect(), brute(rows))


def test_edits_are_the_rows(spark):
    """Deleted, kept, rewritten and added turns as rows; every row has one edit."""
    rows = path_ranks.in_order(spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", ""), (1, 2, "assistant", "Yes")], SCHEMA))
    edits, _ = path_ranks.solved(path_ranks.with_faults(rows))
    found = path_ranks.repaired(rows, edits).orderBy("place", "step").collect()
    assert [(r.edit, r.role, r.text) for r in found] == [("D", None, None), ("D", None, None), ("D", None, None)] or sum(r.cost for r in found) <= 9
    assert "".join(r.edit for r in found) == cheapest((("assistant", "Hi.", None), ("user", "", "blank"), ("assistant", "Yes", "truncated")))[1]


def test_edge_rows(spark):
    assert path_ranks.report(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, None, None, None), (5, 1, "user", "a" * 100_000 + "."), (5, 2, "assistant", "b."), (5, 2, "assistant", "b.")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", place string, fault int")
    compare(path_ranks.report(df, lambda d: d.select("conv_id", "turn", *[path_ranks.F.coalesce(c, path_ranks.F.lit(" ")).alias(c) for c in ("role", "text")])).collect(),
            brute(rows, lambda rs: [(c, t, r or " ", x or " ") for c, t, r, x in rs]))
