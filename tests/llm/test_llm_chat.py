import random

import pytest
from pyspark.sql import functions as F

from reviewlake.llm import chat_log

EVENTS = "conv long, message long, seq long, kind string, role string, body string"
PARTS = ["<|turn|>", "<|text|>", "<|end|>", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "\\", "<", "[", "|", "é😀", "\n", "$1", "x", "<\\|end|>", "[\\\\INST]"]


def fold(events):
    """Replay in order of seq, one event after the other."""
    state = {}
    for e in sorted(set(events), key=lambda e: (e[0] is not None, e[0] or 0, e[2], *[v or "" for v in e[3:]])):
        conv, message, _, kind, role, body = e
        texts = state.setdefault(conv, {})
        if kind == "regenerate":
            for later in [m for m in texts if m > message]:
                del texts[later]
        if kind in chat_log.KINDS:
            m = texts.setdefault(message, ["", ""])
            if kind == "open":
                m[0] = role or ""
            elif kind == "delta":
                m[1] += body or ""
            else:
                m[1] = (body or "") if kind == "edit" else ""
    return sorted(((c, m, *v) for c, ms in state.items() for m, v in ms.items()), key=repr)


@pytest.mark.parametrize("group", [4096, 3])
def test_replay(spark, monkeypatch, group):
    monkeypatch.setattr(chat_log, "GROUP", group)
    rng = random.Random(group)
    events = []
    for conv in [*range(40), None]:
        for seq in rng.sample(range(500), rng.randint(1, 60)):
            kind = rng.choice(["open", "delta", "delta", "delta", "edit", "regenerate", "unknown"])
            e = (conv, rng.randint(0, 9), seq, kind, rng.choice(["user", "assistant", None]) if kind == "open" else None,
                 rng.choice(["a", "bc", "", None, "é😀"]) if kind in ("delta", "edit") else None)
            events += [e] * rng.choice([1, 1, 2])
    rng.shuffle(events)
    found = chat_log.reconstructed(spark.createDataFrame(events, EVENTS)).collect()
    assert sorted((tuple(r) for r in found), key=repr) == fold(events)


def test_log_of_messages_gives_them_back(spark):
    rng = random.Random(1)
    rows = [(c, c * 50 + m, rng.choice(["user", "assistant", "x\ny", ""]), "".join(rng.choice(PARTS) for _ in range(rng.choice([0, 1, 30, 400]))))
            for c in range(20) for m in range(rng.randint(1, 9))]
    rows.append((None, 7, "assistant", "long " * 50_000))
    messages = spark.createDataFrame(rows, "conv long, message long, role string, text string")
    log = chat_log.logged(messages)
    assert {r.kind for r in log.select("kind").distinct().collect()} == set(chat_log.KINDS)
    assert sorted(map(tuple, chat_log.reconstructed(log).collect()), key=repr) == sorted(rows, key=repr)


@pytest.mark.parametrize("part", [256, 2])
def test_output_reads_back(spark, monkeypatch, part):
    """Texts full of control strings come back; the mask holds the learned texts only; no control string is left inside."""
    monkeypatch.setattr(chat_log, "PART", part)
    rng = random.Random(part)
    rows = [(c, m, rng.choice(["user", "assistant", "<|end|>", ""]), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 12))))
            for c in range(60) for m in range(rng.randint(1, 7))]
    output = chat_log.rendered(spark.createDataFrame(rows, "conv long, message long, role string, text string"))
    found = {}
    for r in chat_log.read_back(output).orderBy("conv", "part").collect():
        turns, learned = found.setdefault(r.conv, ([], []))
        turns += [(t.role, t.text) for t in r.turns]
        learned += r.learned
        assert r.formatted.count("<|turn|>") == r.formatted.count("<|end|>") == len(r.turns)
        assert not any(s in r.formatted for s in ("</s>", "[INST]", "<<SYS>>", "<s>"))
    for c in range(60):
        want = [(role, text) for conv, _, role, text in sorted(rows) if conv == c]
        assert found[c] == (want, [t for role, t in want if role == "assistant"])


def test_edge_rows(spark):
    nothing = spark.createDataFrame([], EVENTS)
    assert chat_log.read_back(chat_log.rendered(chat_log.reconstructed(nothing))).count() == 0
    rows = [(1, None, None, "delta", None, "first"), (1, None, 5, "open", "user", None), (1, 2, 6, None, "x", "y"), (None, None, None, "delta", None, None)]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], EVENTS + ", live int, events string")
    assert sorted(map(tuple, chat_log.reconstructed(df).collect()), key=repr) == sorted([(1, None, "user", "first"), (None, None, "", "")], key=repr)
    assert chat_log.rendered(df.select("conv", "message", F.lit("assistant").alias("role"), F.lit("t").alias("text"), "live")).count() == 3
