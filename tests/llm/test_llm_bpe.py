import hashlib
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from edge_rows import TEXTS
from tokenizers import Tokenizer

from reviewlake.llm import bpe_lexicon, queries

PATH = queries.TOKENIZER


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_query(spark, sf_dir, documents, library):
    rows = {r.doc_id: r for r in queries.QUERIES["op10_bpe"](spark, sf_dir).collect()}
    assert len(rows) == len(documents)
    for i, text, *_ in documents:
        ids, r = ids_of(library, text or ""), rows[i]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_random_texts(library):
    rng = random.Random(1)
    parts = [*"ab'stREVMLDΣσςİI é́Å \n\t\x1c\x85 ​9½中字ñ!?$", "<|endoftext|>", "<|startoftext|>", "'ll", "'RE", "the", "zzq", "  "]
    encoder = bpe_lexicon.Encoder(PATH, None)
    for _ in range(4000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert encoder.encode(text) == ids_of(library, text), repr(text)


def test_every_letter_of_the_basic_planes(library):
    """All characters below U+0530 (Latin, Greek, Cyrillic), alone, in a word and beside a digit."""
    encoder = bpe_lexicon.Encoder(PATH, None)
    for code in range(0x530):
        for text in (chr(code), f"a{chr(code)}b", f"1{chr(code)} {chr(code)}!"):
            assert encoder.encode(text) == ids_of(library, text), hex(code)


def test_lexicon_holds_its_words(tmp_path):
    rng = random.Random(2)
    words = {"".join(rng.choice("abcé") for _ in range(rng.randint(1, 9))): tuple(rng.sample(range(9), rng.randint(0, 4))) for _ in range(3000)}
    path = str(tmp_path / "lexicon.bin")
    bpe_lexicon.Lexicon.write(path, words)
    held = bpe_lexicon.Lexicon(path)
    assert all(held.get(w) == ids for w, ids in words.items())
    assert all(held.get(w) is None for w in ("", "d", "abcabcabcabc", "x" * 50) if w not in words)
    states = len(held.final)
    prefixes = {w.encode()[:k] for w in words for k in range(len(w.encode()) + 1)}
    assert states < len(prefixes) / 2  # suffixes are shared
    bpe_lexicon.Lexicon.write(path, {})
    assert bpe_lexicon.Lexicon(path).get("a") is None


def test_lexicon_never_changes_ids(tmp_path, documents):
    vocabulary = bpe_lexicon.Vocabulary(PATH)
    words = sorted({w for d in documents for w in vocabulary.words(vocabulary.normal(d[1]))})[::2]
    path = str(tmp_path / "lexicon.bin")
    bpe_lexicon.Lexicon.write(path, {w: vocabulary.merge(w) for w in words})
    with_lexicon, without = bpe_lexicon.Encoder(PATH, path), bpe_lexicon.Encoder(PATH, None)
    for d in documents[:60]:
        assert with_lexicon.encode(d[1]) == without.encode(d[1])


def test_long_words_and_pieces(library, monkeypatch):
    monkeypatch.setattr(bpe_lexicon, "PIECE_CHARS", 50)
    encoder = bpe_lexicon.Encoder(PATH, None)
    for text in ("x" * 30_000, "don't stop " * 100, "ab" * 200 + " " + "word " * 60, "\n" * 300):
        assert encoder.encode(text) == ids_of(library, text)


def test_remembered_is_bounded():
    seen = bpe_lexicon.Remembered(3)
    for k in "abcabcdeabc":
        if k not in seen.known([k]):
            seen.keep({k: (k,)})
        assert seen.known([k, "z"]) == {k: (k,)}
    assert len(seen.newer) <= 3 and len(seen.older) <= 3


def test_many_texts_as_one_by_one(monkeypatch, library):
    """Small groups of chunks, special tokens and empty texts between others."""
    monkeypatch.setattr(bpe_lexicon, "CHUNKS_AT_ONCE", 3)
    texts = ["", "a b c d e", "x<|endoftext|>y z", "  ", "the the the the", "<|startoftext|><|endoftext|>", "don't é stop"] * 3
    ids, sizes = bpe_lexicon.Encoder(PATH, None).encode_many(texts)
    want = [ids_of(library, t) for t in texts]
    assert sizes.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_both_merges_agree():
    rng, v = random.Random(5), bpe_lexicon.Vocabulary(PATH)
    words = ["".join(rng.choice("etaoinshré中") for _ in range(rng.randint(1, 14))) for _ in range(2000)]
    for word, ids in zip(words, v.merge_many(words)):
        parts = [v.symbols[b] for b in word.encode()]
        parts[-1] += v.end
        assert ids == v._merge_long(parts), word


def test_edge_rows(edge, nothing, library):
    twice = bpe_lexicon.decode(bpe_lexicon.tokenized(edge, PATH), PATH)
    once = bpe_lexicon.tokenized(edge, PATH, decoded="decoded")
    rows = once.collect()
    assert sorted(map(repr, twice.collect())) == sorted(map(repr, rows))
    assert len(rows) == len(TEXTS)
    for r in rows:
        want = ids_of(library, r.text or "")
        assert list(r.ids) == want and r.decoded == library.decode(want, skip_special_tokens=False) and r.private == "x"
    assert bpe_lexicon.tokenized(nothing, PATH).count() == 0


def test_frequent_words_stay_remembered():
    """A word that is asked for again and again stays, however many others pass."""
    seen = bpe_lexicon.Remembered(4)
    seen.keep({"often": (1,)})
    for k in range(50):
        assert seen.known(["often"]) == {"often": (1,)}
        seen.keep({f"w{k}": (2,)})
        assert len(seen.newer) + len(seen.older) <= 8


def test_remembered_chunks_are_small(tmp_path):
    """Chunks that the lexicon knows cost the worker a few tens of bytes each, in flat arrays."""
    rng, path = random.Random(6), str(tmp_path / "lexicon.bin")
    words = sorted({"".join(rng.choice("etaoinshrdlu") for _ in range(8)) for _ in range(20_000)})
    bpe_lexicon.Lexicon.write(path, dict(zip(words, bpe_lexicon.Vocabulary(PATH).merge_many(words))))
    encoder = bpe_lexicon.Encoder(PATH, path)
    tracemalloc.start()
    try:
        ids, sizes = encoder.encode_many([" ".join(words), " ".join(words[::-1])])
        del ids
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert sizes[0] == sizes[1] >= len(words) and held < 100 * len(words)


def test_chunk_table_is_bounded_and_keeps_what_is_asked_for():
    table = bpe_lexicon.ChunkTable(8)
    table.places(pa.array([], pa.string()))
    table.keep(pa.array(["often"]), np.array([2]), np.array([7, 8], np.int32))
    for k in range(50):
        at = int(table.places(pa.array(["often", "never"]))[0])
        start = int(table.sizes[:at].sum())
        assert table.ids[start:start + 2].tolist() == [7, 8] and table.sizes[at] == 2
        table.keep(pa.array([f"w{k}", "x" * 65]), np.array([1, 1]), np.array([k, 0], np.int32))
        assert len(table.keys) == len(table.sizes) == len(table.asked) <= 8 and len(table.ids) == table.sizes.sum()


def test_split_of_many_as_one_by_one():
    rng, v = random.Random(7), bpe_lexicon.Vocabulary(PATH)
    parts = [*"abzAZ.,;:!?'1$_", "é", "×", "÷", "ß", "ɏ", "ɐ", "\u02b0", "ª", "中", "ii", "the", "s", "\u0301"]
    chunks = list(dict.fromkeys(["", *("".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) for _ in range(5000))]))
    order, words, counts = v.split(pa.array(["cut", *chunks], pa.string()).slice(1))
    assert sorted(order.to_pylist()) == sorted(chunks)
    ends = np.cumsum(counts).tolist()
    for chunk, a, b in zip(order.to_pylist(), [0, *ends], ends):
        assert words[a:b].to_pylist() == v.words_of(chunk) == v.words(chunk), repr(chunk)


def test_tally_counts_and_is_bounded():
    rng, tally, want = random.Random(8), bpe_lexicon.Tally(50), {}
    for _ in range(40):
        keys = [f"k{min(rng.randint(0, 19), rng.randint(0, 19))}" for _ in range(30)] + [f"rare{rng.random()}" for _ in range(40)]
        tally.add(pa.array(keys))
        assert tally.rows <= 200
        for k in keys:
            want[k] = want.get(k, 0) + 1
    keys, times = tally.most(5)
    best = sorted(want.values())[-5:]
    assert sorted(times.tolist()) == best and all(want[k] == n for k, n in zip(keys.to_pylist(), times.tolist()))
