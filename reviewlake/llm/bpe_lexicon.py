"""BPE encoding and decoding through a minimal acyclic lexicon automaton.

Words that are frequent in the corpus are compiled, with their token ids, into a minimal acyclic automaton (equal
suffixes share states).  A word's path adds up to its ordinal, and the ordinal points to its ids, so the ids need not
be stored in the states.  The automaton is one flat file that Spark ships to the executors, where it is memory-mapped
once for all workers.  A word that it doesn't hold is merged exactly by the merge table.

The lexicon decides speed only, never a result.
"""

from __future__ import annotations

import atexit
import heapq
import json
import mmap
import os
import re
import shutil
import sys
import tempfile
import types
import unicodedata
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlake.llm.common import small_batches, stored, text_bytes

LEXICON_WORDS = 200_000
COUNTED_WORDS = 200_000
CACHED_WORDS = 20_000
CACHED_CHUNKS = 60_000
LONG_WORD = 64
PIECE_CHARS = 1 << 20
CHUNKS_AT_ONCE = 1 << 16
ENCODED_ROWS = 1024
SHORT_WORD = 40
LATIN_END = "\u0250"  # letters below are the same in all versions of Unicode
NO_RANK = (1 << 31) - 1
MERGED_AT_ONCE = 4096


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    shifted = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(shifted)) for b in range(256)]


def of_process() -> dict:
    """What tasks of one worker process leave for later ones."""
    return sys.modules.setdefault("_bpe_encoders", types.ModuleType("_bpe_encoders")).__dict__


class Vocabulary:
    """Merge rules, ids and special tokens of a word-end BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: rank for rank, pair in enumerate(pairs)}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*self.ids.values(), *self.specials.values()]) + 1)
        for token, i in chain(self.ids.items(), self.specials.items()):
            self.tokens[i] = token
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.special = regex.compile(
            "(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")",
        ) if self.specials else None
        self.symbols = byte_symbols()
        self._number_pairs(pairs)
        # Words that need no pattern: Latin letters, with one mark behind them, where the pattern cuts just there.
        marks = [m for m in ".,;:!?" if self.words(f"ab{m}") == ["ab", m] and self.words("Ab") == ["Ab"]]
        self.marks = frozenset(marks)

    @classmethod
    def of_worker(cls, path: str) -> Vocabulary:
        """The vocabulary of this worker process, read once for all its tasks."""
        held = of_process()
        if f"vocabulary {path}" not in held:
            held[f"vocabulary {path}"] = cls(path)
        return held[f"vocabulary {path}"]

    def merge(self, word: str) -> tuple[int, ...]:
        """Ids of one word: the adjacent pair of lowest rank is merged first, the leftmost among equals."""
        return self.merge_many([word])[0]

    def merge_many(self, words: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word.  Words of similar length are merged side by side, very long ones by themselves."""
        raw = [w.encode("utf-8") for w in words]
        out: list[tuple[int, ...]] = [()] * len(raw)
        order = sorted((k for k in range(len(raw)) if len(raw[k]) <= SHORT_WORD), key=lambda k: len(raw[k]))
        for at in range(0, len(order), MERGED_AT_ONCE):
            group = order[at:at + MERGED_AT_ONCE]
            for k, ids in zip(group, self._merge_side_by_side([raw[k] for k in group])):
                out[k] = ids
        for k, word in enumerate(raw):
            if len(word) > SHORT_WORD:
                parts = [self.symbols[b] for b in word]
                parts[-1] += self.end
                out[k] = self._merge_long(parts)
        return out

    def _number_pairs(self, pairs: list[tuple[str, str]]) -> None:
        """Numbers instead of symbols: those of the vocabulary keep their ids, others get larger numbers."""
        numbers = dict(self.ids)
        self.n_ids = max(numbers.values(), default=-1) + 1
        number = lambda s: numbers.setdefault(s, self.n_ids + len(numbers))
        self.first = np.array([number(s) for s in self.symbols], np.int64)
        self.last = np.array([number(s + self.end) for s in self.symbols], np.int64)
        keys = np.array([number(a) << 32 | number(b) for a, b in pairs], np.int64)
        self.made = np.array([number(a + b) for a, b in pairs] or [0], np.int64)
        self.pair_rank = np.argsort(keys, kind="stable").astype(np.int32)
        self.pair_keys = keys[self.pair_rank]

    def _ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NO_RANK where there is no such merge (a missing symbol is -1)."""
        if not len(self.pair_keys):
            return np.full(a.shape, NO_RANK, np.int32)
        wanted = np.where((a >= 0) & (b >= 0), a << 32 | b, -1)
        at = np.minimum(np.searchsorted(self.pair_keys, wanted), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == wanted, self.pair_rank[at], NO_RANK).astype(np.int32)

    def _merge_side_by_side(self, raw: list[bytes]) -> list[tuple[int, ...]]:
        """One merge of every word per round; a word without a pair to merge leaves."""
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        width = int(sizes.max(initial=1))
        data = np.frombuffer(b"".join(raw), np.uint8)
        parts = np.full((len(raw), width + 1), -1, np.int64)
        parts[np.arange(width + 1) < sizes[:, None]] = self.first[data]
        some = sizes > 0
        parts[some.nonzero()[0], sizes[some] - 1] = self.last[data[(np.cumsum(sizes) - 1)[some]]]
        rank = self._ranks_of(parts[:, :-1], parts[:, 1:])
        rows, open_parts = np.arange(len(raw)), parts
        columns = np.arange(width + 1)
        while len(rows):
            i = rank.argmin(axis=1)
            here = np.arange(len(rows))
            least = rank[here, i]
            done = least == NO_RANK
            if done.any():
                parts[rows[done]] = open_parts[done]
                rows, open_parts, rank, i, least = (x[~done] for x in (rows, open_parts, rank, i, least))
                here = here[:len(rows)]
            if not len(rows):
                break
            open_parts[here, i] = self.made[least]
            moved = np.minimum(columns + (columns > i[:, None]), width)
            open_parts = np.take_along_axis(open_parts, moved, 1)
            rank = np.take_along_axis(rank, np.minimum(columns[:-1] + (columns[:-1] >= i[:, None]), width - 1), 1)
            rank[here, i] = self._ranks_of(open_parts[here, i], open_parts[here, i + 1])
            left = (i > 0).nonzero()[0]
            rank[left, i[left] - 1] = self._ranks_of(open_parts[left, i[left] - 1], open_parts[left, i[left]])
        held = (parts >= 0) & (parts < self.n_ids)
        flat, ends = parts[held].tolist(), np.cumsum(held.sum(axis=1)).tolist()
        return [tuple(flat[x:y]) for x, y in zip([0, *ends], ends)]

    def _merge_long(self, parts: list[str | None]) -> tuple[int, ...]:
        """Pairs wait in a heap and symbols form a linked list, so a very long word takes n log n steps."""
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(ranks[p], i, p) for i in range(n - 1) if (p := (parts[i], parts[i + 1])) in ranks]
        heapq.heapify(waiting)
        while waiting:
            _, i, pair = heapq.heappop(waiting)
            j = after[i]
            if parts[i] is None or j >= n or (parts[i], parts[j]) != pair:
                continue
            parts[i], parts[j] = pair[0] + pair[1], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) < n and (p := (parts[left], parts[right])) in ranks:
                    heapq.heappush(waiting, (ranks[p], left, p))
        return tuple(self.ids[p] for p in parts if p is not None and p in self.ids)

    def words_of(self, chunk: str) -> list[str]:
        """The words of a run without white space."""
        if self.marks and chunk and max(chunk) < LATIN_END:
            if chunk.isalpha():
                return [chunk]
            if chunk[-1] in self.marks and chunk[:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.words(chunk)

    def split(self, chunks: pa.Array) -> tuple[pa.Array, pa.Array, np.ndarray]:
        """The chunks in another order, the words of all of them in that order, and the number of words of each.

        Those that :meth:`words_of` takes for Latin words without the pattern are found by their bytes, all at once.
        """
        data, ends = text_bytes(chunks)
        before = np.concatenate([[0], data[:-1]]).astype(np.uint8)[:len(data)]
        small = data | 0x20
        two = (before >= 0xC3) & (before <= 0xC8) & (data & 0xC0 == 0x80) & ~((before == 0xC3) & ((data == 0x97) | (data == 0xB7)))
        letter = ((small >= ord("a")) & (small <= ord("z"))) | ((data >= 0xC3) & (data <= 0xC8)) | two
        others = np.diff(np.concatenate([[0], np.cumsum(~letter)])[ends])
        size = np.diff(ends)
        last = np.zeros(len(size), np.uint8)
        last[size > 0] = data[ends[1:][size > 0] - 1]
        marked = (others == 1) & (size > 1) & np.isin(last, [ord(m) for m in self.marks])
        easy = (((others == 0) & (size > 0)) | marked) & bool(self.marks)
        plain, hard = chunks.filter(pa.array(easy)), chunks.filter(pa.array(~easy))
        found = [self.words(c) for c in hard.to_pylist()]
        data, ends = text_bytes(plain)
        starts = np.sort(np.concatenate([ends, ends[1:][marked[easy]] - 1])).astype(np.int32)
        latin = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(data))])
        counts = np.concatenate([1 + marked[easy], np.fromiter(map(len, found), np.int64, len(found))])
        return pa.concat_arrays([plain, hard]), pa.concat_arrays([latin, pa.array(list(chain.from_iterable(found)), pa.string())]), counts

    def normal(self, text: str) -> str:
        """NFC and lower case, each character by itself (a final sigma is not special)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:
                text = text.replace("Σ", "σ")
        return text.lower()


def gathered(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts``, one behind the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(starts - (ends - sizes), sizes) + np.arange(int(sizes.sum()))]


class Lexicon:
    """Minimal acyclic automaton from UTF-8 words to ids, in flat arrays of one memory-mapped file.

    File: eight int64 numbers (array lengths and the root), then the arrays.  State s owns arcs first[s] .. first[s + 1]; an
    arc has a label (one byte), a target and the number of words that sort before it among those through s; final[s]
    marks an accepted word.
    """

    FIELDS = (("label", "B"), ("final", "B"), ("first", "i"), ("target", "i"), ("skipped", "i"), ("starts", "i"), ("ids", "i"))

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.file = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        *sizes, self.root = np.frombuffer(self.file, np.int64, 8).tolist()
        at = 64
        for (name, kind), n in zip(self.FIELDS, sizes):
            setattr(self, name, np.frombuffer(self.file, np.int32 if kind == "i" else np.uint8, n, at))
            at += -(-n * (4 if kind == "i" else 1) // 8) * 8
        # Arcs are sorted by state and label, so one number finds an arc.
        self.arc = np.repeat(np.arange(len(self.final), dtype=np.int64), np.diff(self.first)) * 256 + self.label

    def ordinals(self, words: pa.Array) -> np.ndarray:
        """Ordinal of each word, -1 for a word that isn't held; all words walk through the automaton side by side."""
        data, ends = text_bytes(words)
        start, length, out = ends[:-1], np.diff(ends), np.full(len(words), -1, np.int64)
        walking, state, ordinal = np.arange(len(words)), np.full(len(words), self.root, np.int64), np.zeros(len(words), np.int64)
        for step in range(int(length.max(initial=0)) + 1):
            done = length[walking] == step
            accepted = done & (self.final[state] == 1)
            out[walking[accepted]] = ordinal[accepted]
            walking, state, ordinal = walking[~done], state[~done], ordinal[~done]
            if not len(walking) or not len(self.arc):
                break
            wanted = state * 256 + data[start[walking] + step]
            arc = np.minimum(np.searchsorted(self.arc, wanted), len(self.arc) - 1)
            held = self.arc[arc] == wanted
            walking, arc = walking[held], arc[held]
            state, ordinal = self.target[arc].astype(np.int64), ordinal[held] + self.skipped[arc]
        return out

    def get_many(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are held, the number of ids of each of these, and all their ids."""
        ordinals = self.ordinals(words)
        held = ordinals >= 0
        first = self.starts[ordinals[held]].astype(np.int64)
        sizes = self.starts[ordinals[held] + 1] - first
        return held, sizes, gathered(self.ids, first, sizes)

    def get(self, word: str) -> tuple[int, ...] | None:
        held, _, ids = self.get_many(pa.array([word], pa.string()))
        return tuple(ids.tolist()) if held[0] else None

    @classmethod
    def write(cls, path: str, entries: dict[str, tuple[int, ...]]) -> None:
        """Build from sorted words: a state is frozen, and shared with an equal one, once no later word can reach it."""
        words = sorted((w.encode("utf-8"), ids) for w, ids in entries.items())
        known: dict[tuple, int] = {}
        frozen: list[tuple[bool, tuple[tuple[int, int], ...], int]] = []
        path_nodes: list[list] = [[False, []]]

        def freeze(depth: int) -> int:
            """Freeze the open states below ``depth``; returns the state that was open there."""
            below = -1
            while len(path_nodes) > depth:
                final, arcs = path_nodes.pop()
                if below >= 0:
                    arcs[-1] = (arcs[-1][0], below)
                key = (final, tuple(arcs))
                if key not in known:
                    known[key] = len(frozen)
                    frozen.append((final, key[1], int(final) + sum(frozen[t][2] for _, t in arcs)))
                below = known[key]
            return below

        last = b""
        for word, _ in words:
            shared = len(os.path.commonprefix([word, last]))
            if (below := freeze(shared + 1)) >= 0:
                path_nodes[-1][1][-1] = (path_nodes[-1][1][-1][0], below)
            for b in word[shared:]:
                path_nodes[-1][1].append((b, -1))
                path_nodes.append([False, []])
            path_nodes[-1][0] = True
            last = word
        root = freeze(0)
        first, final, label, target, skipped = [0], [], [], [], []
        for is_final, arcs, _ in frozen:
            passed = int(is_final)
            for b, t in arcs:
                label.append(b)
                target.append(t)
                skipped.append(passed)
                passed += frozen[t][2]
            final.append(int(is_final))
            first.append(len(label))
        starts = np.cumsum([0, *(len(ids) for _, ids in words)])
        arrays = [label, final, first, target, skipped, starts, [i for _, ids in words for i in ids]]
        with open(path, "wb") as f:
            f.write(np.asarray([*map(len, arrays), root], np.int64).tobytes())
            for values, (_, kind) in zip(arrays, cls.FIELDS):
                raw = np.asarray(values, np.int32 if kind == "i" else np.uint8).tobytes()
                f.write(raw + b"\0" * (-len(raw) % 8))


SEPARATORS = re.compile("[\x1c-\x1f]")
SPACE = regex.compile(r"\s")


def _pieces(text: str) -> Iterator[str]:
    """The text, cut at white space after each PIECE_CHARS characters: no word spans a cut."""
    at = 0
    while len(text) - at > PIECE_CHARS:
        cut = SPACE.search(text, at + PIECE_CHARS)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def _chunks(text: str) -> list[str]:
    """The runs between white space.  (str.split also cuts at four control characters, which aren't white space here.)"""
    return SPACE.split(text) if SEPARATORS.search(text) else text.split()


class Tally:
    """Counts of strings; when there are more than twice ``size``, those with the ``size`` largest counts stay."""

    def __init__(self, size: int):
        self.size, self.rows = size, 0
        self.parts = [pa.table({"key": pa.array([], pa.string()), "n": pa.array([], pa.int64())})]

    def add(self, keys: pa.Array, times: np.ndarray | None = None) -> None:
        if times is None:
            found = keys.value_counts()
            keys, times = found.field("values"), found.field("counts").to_numpy()
        self.parts.append(pa.table({"key": keys, "n": pa.array(times, pa.int64())}))
        self.rows += len(keys)
        if self.rows > 4 * self.size:
            self._fold()

    def _fold(self) -> None:
        whole = pa.concat_tables(self.parts).group_by("key", use_threads=False).aggregate([("n", "sum")])
        whole = whole.rename_columns({"n_sum": "n"}).select(["key", "n"])
        if len(whole) > 2 * self.size:
            whole = whole.take(pc.select_k_unstable(whole, self.size, [("n", "descending")]))
        self.parts, self.rows = [whole], len(whole)

    def most(self, size: int) -> tuple[pa.Array, np.ndarray]:
        """The strings that came more than once, at most the ``size`` most frequent ones, and their counts."""
        self._fold()
        whole = self.parts[0].filter(pc.greater(self.parts[0]["n"], 1))
        whole = whole.take(pc.select_k_unstable(whole, size, [("n", "descending")])) if len(whole) > size else whole
        return whole["key"].combine_chunks(), whole["n"].to_numpy()


class Remembered:
    """Results by key, in two generations of a bounded size: the older one goes when the newer one is full.

    What is asked for again moves to the newer one, so that frequent keys stay though few are held.
    """

    def __init__(self, size: int):
        self.size, self.newer, self.older = size, {}, {}

    def known(self, keys: list[str]) -> dict[str, tuple[int, ...]]:
        """Those of the keys that are remembered."""
        newer, older = self.newer, self.older
        found = {k: v for k in keys if (v := newer.get(k)) is not None}
        again = {k: v for k in keys if k not in found and (v := older.get(k)) is not None}
        self.keep(again)
        return found | again

    def keep(self, found: dict[str, tuple[int, ...]]) -> None:
        for key, value in found.items():
            if len(key) <= LONG_WORD:
                if len(self.newer) >= self.size:
                    self.newer, self.older = {}, self.newer
                self.newer[key] = value


class ChunkTable:
    """Ids by chunk in flat arrays, which take some tens of bytes a chunk where a dict of tuples takes hundreds.

    When it holds more than ``size`` chunks, the half of them asked for last stay.
    """

    def __init__(self, size: int):
        self.size, self.calls = size, 0
        self.keys, self.ids = pa.array([], pa.string()), np.empty(0, np.int32)
        self.sizes, self.asked = np.empty(0, np.int64), np.empty(0, np.int64)

    def places(self, keys: pa.Array) -> np.ndarray:
        """Place of each chunk, -1 for one that isn't held."""
        self.calls += 1
        at = pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)
        self.asked[at[at >= 0]] = self.calls
        return at

    def keep(self, keys: pa.Array, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Chunks that aren't held, with the number of ids of each and all their ids."""
        short = pc.less_equal(pc.binary_length(keys), LONG_WORD).to_numpy(zero_copy_only=False)
        self.keys = pa.concat_arrays([self.keys, keys.filter(pa.array(short))])
        self.ids = np.concatenate([self.ids, ids[np.repeat(short, sizes)]])
        self.sizes = np.concatenate([self.sizes, sizes[short]])
        self.asked = np.concatenate([self.asked, np.full(int(short.sum()), self.calls)])
        if len(self.keys) > self.size:
            last = np.sort(np.argsort(self.asked, kind="stable")[len(self.keys) - self.size // 2:])
            stays = np.zeros(len(self.keys), bool)
            stays[last] = True
            self.keys, self.ids = self.keys.take(pa.array(last)), self.ids[np.repeat(stays, self.sizes)]
            self.sizes, self.asked = self.sizes[last], self.asked[last]


class Encoder:
    """Exact encoder of one worker: remembered words, then lexicon, then merges.

    The chunks of many texts are taken together: each distinct one is resolved once, and the ids are gathered by index.
    """

    def __init__(self, vocabulary_path: str, lexicon_path: str | None):
        self.vocabulary = Vocabulary.of_worker(vocabulary_path)
        self.lexicon = Lexicon(lexicon_path) if lexicon_path else None
        self.words, self.chunks = Remembered(CACHED_WORDS), ChunkTable(CACHED_CHUNKS)

    @classmethod
    def of_worker(cls, vocabulary_path: str, lexicon: str | None) -> Encoder:
        """The encoder of this worker process, which later tasks find with its words remembered."""
        held = of_process()
        key = f"{vocabulary_path}|{lexicon}"
        if key not in held:
            for old in [k for k in held if "|" in k]:
                del held[old]
            held[key] = cls(vocabulary_path, SparkFiles.get(lexicon) if lexicon else None)
        return held[key]

    def _ids_of_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of some distinct words, and all their ids in order."""
        if self.lexicon:
            held, held_sizes, held_ids = self.lexicon.get_many(words)
        else:
            held, held_sizes, held_ids = np.zeros(len(words), bool), np.empty(0, np.int64), np.empty(0, np.int32)
        rest = words.filter(pa.array(~held)).to_pylist()
        found = self.words.known(rest)
        new = [w for w in rest if w not in found]
        made = dict(zip(new, self.vocabulary.merge_many(new)))
        self.words.keep(made)
        lists = [found[w] if w in found else made[w] for w in rest]
        sizes = np.empty(len(words), np.int64)
        sizes[held], sizes[~held] = held_sizes, np.fromiter(map(len, lists), np.int64, len(lists))
        ids = np.empty(int(sizes.sum()), np.int32)
        of_held = np.repeat(held, sizes)
        ids[of_held], ids[~of_held] = held_ids, np.fromiter(chain.from_iterable(lists), np.int32, len(ids) - len(held_ids))
        return sizes, ids

    def _ids_of_chunks(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct chunks in another order, the number of ids of each, and all their ids in that order."""
        chunks, words, counts = self.vocabulary.split(chunks)
        coded = words.dictionary_encode()
        codes = coded.indices.to_numpy()
        sizes, ids = self._ids_of_words(coded.dictionary)
        of_word = sizes[codes]
        of_chunk = np.diff(np.concatenate([[0], np.cumsum(of_word)])[np.cumsum(counts)], prepend=0)
        return chunks, of_chunk, gathered(ids, (np.cumsum(sizes) - sizes)[codes], of_word)

    def _resolved(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks in order, and the number of ids of each chunk."""
        coded = chunks.dictionary_encode()
        codes, table = coded.indices.to_numpy(), self.chunks
        at = table.places(coded.dictionary)
        new = at < 0
        some, new_sizes, new_ids = self._ids_of_chunks(coded.dictionary.filter(pa.array(new)))
        at[new] = len(table.sizes) + pc.index_in(coded.dictionary.filter(pa.array(new)), value_set=some).to_numpy()
        sizes = np.concatenate([table.sizes, new_sizes])
        ids = np.concatenate([table.ids, new_ids])
        table.keep(some, new_sizes, new_ids)
        at = at[codes]
        return gathered(ids, (np.cumsum(sizes) - sizes)[at], sizes[at]), sizes[at]

    def encode_many(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and the number of ids of each text."""
        v, parts, sizes = self.vocabulary, [], np.zeros(len(texts), np.int64)
        chunks: list[pa.Array] = []
        owners: list[int] = []
        waiting = 0

        def flush() -> None:
            nonlocal waiting
            if not waiting:
                return
            ids, counts = self._resolved(pa.concat_arrays(chunks))
            parts.append(ids)
            ends = np.cumsum(list(map(len, chunks)))
            np.add.at(sizes, owners, np.diff(np.concatenate([[0], np.cumsum(counts)])[ends], prepend=0))
            chunks.clear()
            owners.clear()
            waiting = 0

        for k, text in enumerate(texts):
            special = v.special and any(s in text for s in v.specials)
            for j, part in enumerate(v.special.split(text) if special else [text]):
                if j % 2:
                    flush()
                    parts.append(np.array([v.specials[part]], np.int32))
                    sizes[k] += 1
                    continue
                for piece in _pieces(part):
                    chunks.append(pa.array(_chunks(v.normal(piece)), pa.string()))
                    owners.append(k)
                    waiting += len(chunks[-1])
                    if waiting >= CHUNKS_AT_ONCE:
                        flush()
        flush()
        return np.concatenate([*parts, np.empty(0, np.int32)]), sizes

    def encode(self, text: str) -> list[int]:
        return self.encode_many([text])[0].tolist()


def frequent_words(docs: DataFrame, vocabulary_path: str, text: str = "text", words: int = LEXICON_WORDS) -> list[str]:
    """The most frequent words over all texts, at most ``words``: those whose count reaches the lowest power of two that so
    few reach.  No more than these go to the driver.

    Each task counts its words and keeps the COUNTED_WORDS largest counts, whatever the input, so that memory and the
    shuffle stay bounded; the counts of rare words are therefore lower bounds.
    """
    small_batches(docs.sparkSession)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, chunks = Vocabulary.of_worker(vocabulary_path), Tally(COUNTED_WORDS)
        waiting: list[pa.Array] = []
        size = 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                for piece in _pieces(t or ""):
                    waiting.append(pa.array(_chunks(v.normal(piece)), pa.string()))
                    size += len(waiting[-1])
                    if size >= CHUNKS_AT_ONCE:
                        chunks.add(pa.concat_arrays(waiting))
                        waiting, size = [], 0
        if waiting:
            chunks.add(pa.concat_arrays(waiting))
        known, times = chunks.most(COUNTED_WORDS)
        order, parts, sizes = v.split(known)
        seen = Tally(words)
        seen.add(parts, np.repeat(times[pc.index_in(order, value_set=known).to_numpy()], sizes))
        top, times = seen.most(words)
        short = pc.less_equal(pc.utf8_length(top), LONG_WORD)
        yield pa.RecordBatch.from_arrays([top.filter(short), pa.array(times, pa.int64()).filter(short)], names=["word", "n"])
        pa.default_memory_pool().release_unused()

    totals = stored(docs.select(text).mapInArrow(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    scale = F.floor(F.log2("n")).cast("int")
    sizes = {r.scale: r["count"] for r in totals.groupBy(scale.alias("scale")).count().collect()}
    least, held = 64, 0
    while least > 0 and held + sizes.get(least - 1, 0) <= words:
        least -= 1
        held += sizes.get(least, 0)
    return totals.where(scale >= least).orderBy(F.desc("n"), "word").select("word").toArrow().column("word").to_pylist()


def ship_lexicon(spark: SparkSession, words: list[str], vocabulary_path: str) -> str:
    """Compile ``words`` and send the file to all executors; returns the name to look it up by.

    Executors that join later fetch it too, so the driver's copy stays until the driver ends.
    """
    vocabulary = Vocabulary(vocabulary_path)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = os.path.realpath(tempfile.mkdtemp(prefix="lexicon-"))
    atexit.register(shutil.rmtree, folder, True)
    Lexicon.write(f"{folder}/{name}", dict(zip(words, vocabulary.merge_many(words))))
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def joined_tokens(tokens: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The tokens of each text joined by one space."""
    if not len(ids):
        return pa.array([""] * (len(ends) - 1), pa.string())
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), tokens.take(pa.array(ids)))
    return pc.binary_join(lists, " ")


def encode(docs: DataFrame, vocabulary_path: str, text: str = "text", lexicon: str | None = None,
           ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """Add the column ``ids`` (array<int>) with the whole text's tokens; a null text counts as empty.

    Equal to the public tokenizer without added special tokens, cutting and padding.  Strings of special tokens in a
    text become those tokens, as there.  All other columns are kept; a column named like ``ids`` is replaced.  With
    ``decoded``, that column gets the text decoded from the ids in the same pass (see :func:`decode`).
    """
    docs = docs.drop(*[c for c in (ids, decoded) if c])
    added = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    schema = T.StructType([*docs.schema.fields, *added])
    names = schema.names
    at = docs.columns.index(text)
    small_batches(docs.sparkSession, ENCODED_ROWS)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of_worker(vocabulary_path, lexicon)
        tokens = pa.array(encoder.vocabulary.tokens, pa.string())
        for batch in batches:
            flat, sizes = encoder.encode_many([t or "" for t in batch.column(at).to_pylist()])
            ends = np.concatenate([[0], np.cumsum(sizes)])
            columns = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            if decoded:
                columns.append(joined_tokens(tokens, flat, ends))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=names)
        pa.default_memory_pool().release_unused()

    return docs.mapInArrow(encoded, schema)


def decode(docs: DataFrame, vocabulary_path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add the column ``text``: the tokens joined by one space, special tokens included; null ids give an empty text."""
    docs = docs.drop(text)
    schema = T.StructType([*docs.schema.fields, T.StructField(text, T.StringType())])
    at = docs.columns.index(ids)
    small_batches(docs.sparkSession)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(Vocabulary(vocabulary_path).tokens, pa.string())
        for batch in batches:
            column = batch.column(at)
            ends = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy())])
            texts = joined_tokens(tokens, column.flatten().to_numpy(), ends)
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, text])

    return docs.mapInArrow(decoded, schema)


def tokenized(docs: DataFrame, vocabulary_path: str, text: str = "text", decoded: str | None = None) -> DataFrame:
    """Frequent words, lexicon and ids (and decoded text) in one call."""
    words = frequent_words(docs, vocabulary_path, text)
    return encode(docs, vocabulary_path, text, ship_lexicon(docs.sparkSession, words, vocabulary_path), decoded=decoded)
