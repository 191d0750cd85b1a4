"""First-holder index: the first known finding of a file that a new finding is similar to, without a scan of all."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MIN_OVERLAP = 0.6
REMEMBERED = 200_000
ROWS_AT_ONCE = 10_000
BYTES_AT_ONCE = 16 << 20


def least_common(size: int) -> int:
    """Fewest common words with which a set of ``size`` words can be similar to any other: more than 60 %."""
    return 3 * size // 5 + 1


class FirstHolders:
    """Known findings of one file in order.

    Of the findings on a line, and of those with a keyword, only the first can be an answer, so one place each is kept.  For
    the overlap, a finding is posted under its rarest words: two sets with more than MIN_OVERLAP of the larger
    one in common share one of the first ``size - least_common(size) + 1`` words of each, whatever the order of words.
    """

    def __init__(self) -> None:
        self.names: list[tuple[int, int]] = []
        self.words: list[frozenset[str]] = []
        self.by_line: dict[int, int] = {}
        self.by_keyword: dict[int, int] = {}
        self.by_word: dict[tuple[str | None, str], list[int]] = {}

    @staticmethod
    def _posted(words: list[str]) -> list[str]:
        return words[:len(words) - least_common(len(words)) + 1]

    def first(self, line: int, keywords: int, category: str | None, words: list[str]) -> tuple[int, int] | None:
        """(kind, ordinal) of the first similar finding.  ``words`` are distinct and in the common order, rarest first."""
        none = len(self.names)
        best = self.by_line.get(line, none) if line else none
        while keywords:
            bit = keywords & -keywords
            best = min(best, self.by_keyword.get(bit, none))
            keywords ^= bit
        own, tested = frozenset(words), set()
        for word in self._posted(words):
            for k in self.by_word.get((category, word), ()):
                if k >= best:
                    break
                if k not in tested:
                    tested.add(k)
                    other = self.words[k]
                    if len(own & other) / max(len(own), len(other)) > MIN_OVERLAP:
                        best = k
                        break
        return self.names[best] if best < none else None

    def add(self, name: tuple[int, int], line: int, keywords: int, category: str | None, words: list[str]) -> None:
        k = len(self.names)
        self.names.append(name)
        self.words.append(frozenset(words))
        if line:
            self.by_line.setdefault(line, k)
        while keywords:
            bit = keywords & -keywords
            self.by_keyword.setdefault(bit, k)
            keywords ^= bit
        for word in self._posted(words):
            self.by_word.setdefault((category, word), []).append(k)


class Places(dict):
    """Place of each word in the common order of :func:`reviewlake.functions.similarity.word_rarity`, computed when first asked for.

    REMEMBERED words at most are held.
    """

    def __init__(self, rarity: bytes) -> None:
        self.rarity = rarity

    def __missing__(self, word: str) -> tuple[int, str]:
        if len(self) >= REMEMBERED:
            self.clear()
        place = self[word] = (self.rarity[zlib.crc32(word.encode("utf-8")) % len(self.rarity)], word)
        return place

    def rarest_first(self, joined: str) -> list[str]:
        """Words joined by blanks in the common order."""
        return sorted(joined.split(" "), key=self.__getitem__)


def rarest_first(joined: str, rarity: bytes) -> list[str]:
    """Words joined by blanks in the common order of ``rarity``."""
    return Places(rarity).rarest_first(joined)


def whole_findings(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The same rows in order, cut so that adjacent rows with equal ``names`` come in one batch.

    Small batches are put together to ROWS_AT_ONCE rows or BYTES_AT_ONCE: a session's batches may hold a few hundred rows
    only, and each costs some milliseconds.
    """
    waiting: list[pa.RecordBatch] = []
    rows = size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        waiting.append(batch)
        rows, size = rows + batch.num_rows, size + batch.nbytes
        if rows < ROWS_AT_ONCE and size < BYTES_AT_ONCE:
            continue
        batch = pa.concat_batches(waiting)
        columns, cut = [batch.column(n) for n in names], batch.num_rows - 1
        while cut and all(c[cut - 1].as_py() == c[cut].as_py() for c in columns):
            cut -= 1
        if cut:
            yield batch.slice(0, cut)
        waiting = [batch.slice(cut)]
        rows, size = waiting[0].num_rows, waiting[0].nbytes
    if waiting:
        yield pa.concat_batches(waiting)


def classes(batch: pa.RecordBatch, names: list[str], codes: np.ndarray | int = 0) -> np.ndarray:
    """A number per row, equal for rows with equal ``names`` (and ``codes``)."""
    for name in names:
        coded = batch[name].dictionary_encode(null_encoding="encode")
        codes = codes * max(len(coded.dictionary), 1) + coded.indices.to_numpy().astype(np.int64)
        codes = np.unique(codes, return_inverse=True)[1]
    return codes


def greedy(keys: list[str], rarity: bytes):
    """A task over rows sorted by (keys, kind, ordinal): each model finding with the finding it belongs to.

    Rows are (keys, kind, ordinal, line, keywords, category, words, others), words joined by blanks; kind 0 is a rule finding.
    Model findings come out with all but kind, line, keywords and words, and with ``target_model`` and ``target``.  One
    file's known findings are held at a time, not its rows.  Findings with equal features go to the same one, as later
    candidates come behind it, so the last REMEMBERED answers of a file are kept.  Where an ordinal repeats, each of its rows
    goes wherever one of them goes.
    """
    features = ["line", "keywords", "category", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, known, told, places = None, FirstHolders(), {}, Places(rarity)
        for batch in whole_findings(batches, [*keys, "kind", "ordinal"]):
            kind, files = batch["kind"].to_numpy(), classes(batch, keys)
            _, first, cls = np.unique(classes(batch, ["kind", *features], files), return_index=True, return_inverse=True)
            # Decided row by row: the rule findings, and of the model findings with equal features the first of a file.
            decided = np.union1d((kind == 0).nonzero()[0], first)
            hits: list = [(0, None)] * len(first)
            some = batch.take(pa.array(decided))
            for c, own, is_model, ordinal, *said in zip(cls[decided].tolist(), zip(*(some[k].to_pylist() for k in keys)),
                                                        *(some[n].to_pylist() for n in ("kind", "ordinal", *features))):
                if own != file:
                    file, known, told = own, FirstHolders(), {}
                what = tuple(said)
                hit = told.get(what) if is_model else None
                if hit is None:
                    held = (*said[:-1], places.rarest_first(said[-1]))
                    hit = known.first(*held) if is_model else None
                    if hit is None:
                        hit = (is_model, ordinal)
                        known.add(hit, *held)
                    if is_model:
                        if len(told) >= REMEMBERED:
                            told.clear()
                        told[what] = hit
                hits[c] = hit
            rows = ((kind == 1) & batch["ordinal"].is_valid().to_numpy(zero_copy_only=False)).nonzero()[0]
            goes = cls[rows]
            finding = classes(batch, ["ordinal"], files)[rows]
            starts = np.concatenate([[True], finding[1:] != finding[:-1]]).nonzero()[0] if len(rows) else rows
            sizes = np.diff([*starts, len(rows)])
            if (sizes > 1).any():
                # Each row of a repeated finding meets the place of each: sizes[i] ** 2 rows.
                own_size = np.repeat(sizes, sizes)
                met = np.arange(own_size.sum()) - np.repeat(np.cumsum(own_size) - own_size, own_size)
                goes = goes[np.repeat(np.repeat(starts, sizes), own_size) + met]
                rows = np.repeat(rows, own_size)
            models = batch.drop_columns(["kind", "line", "keywords", "words"]).take(pa.array(rows))
            ends = [pa.array([h[k] for h in hits], t).take(pa.array(goes)) for k, t in ((0, pa.int32()), (1, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*models.columns, *ends], names=[*models.schema.names, "target_model", "target"])

    return run


def noted(keys: list[str], base: list[str], names: list[str]):
    """A task over the rows of :func:`greedy`: findings that become issues with their ``base`` columns as a struct, and for each
    finding the ``notes`` (ordinal, reasoning) of all that are attached to it within a batch.  Columns come as ``names``."""
    place = [*keys, "target_model", "target"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            is_base = pc.fill_null(pc.and_(pc.equal(batch["target_model"], 1), pc.equal(batch["ordinal"], batch["target"])), False)
            own = batch.filter(is_base)
            whole = pa.StructArray.from_arrays([*(own[c] for c in base), pa.array([1] * own.num_rows, pa.int32())], [*base, "is_model"])
            others = pa.Table.from_batches([batch.filter(pc.invert(is_base))]).group_by(place, use_threads=False)
            lists = others.aggregate([("ordinal", "list"), ("reasoning", "list")]).combine_chunks()
            ordinals, said = (lists[f"{c}_list"].combine_chunks() for c in ("ordinal", "reasoning"))
            notes = pa.ListArray.from_arrays(ordinals.offsets, pa.StructArray.from_arrays(
                [ordinals.values, said.values], ["ordinal", "reasoning"]))
            n = len(notes)
            yield pa.RecordBatch.from_arrays([*(own[c] for c in place), whole, pa.nulls(own.num_rows, notes.type)], names=names)
            yield pa.RecordBatch.from_arrays([*(lists[c].combine_chunks() for c in place), pa.nulls(n, whole.type), notes], names=names)

    return run
