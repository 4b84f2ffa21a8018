"""Benchmark decontamination by spaced seeds.

Fixed masks pick some word positions of a window and ignore the others. Masked hashes of the benchmark items are joined
with those of the documents; around every hit the two texts are compared word by word along the hit's diagonal, and an
overlap counts if some window has enough equal words. The masks are chosen so that every window with as many
substitutions as allowed is hit by one of them.

Defined cases: null or empty texts and items overlap with nothing; items shorter than the window must occur whole, with as
many substitutions as ``allowed`` says for their length (none under 8 words), however short they are; a caller to whom a few
words are ordinary phrases and no evidence may leave out items under ``shortest`` words; repeated
documents each get their rows, repeated item ids count as one item; null document ids keep their rows; empty tables give
an empty result; other columns are not read by ``overlaps`` and kept by ``clean``.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm import kernels
from quire.llm.arrow import lean

#: Words of a window, substitutions allowed in it, words picked by a mask.
WINDOW, SUBSTITUTIONS, WEIGHT = 13, 3, 5

#: Hits, and words along their diagonals, that are looked at together: bounds the memory of texts that repeat a phrase.
HITS = 1 << 21

#: Benchmark words sent to every task at once (about 50 bytes a word); more are taken in blocks, one pass each.
BLOCK_WORDS = 400_000

SCHEMA = "doc_id long, item_id long, doc_start long, item_start long, n_words long, n_equal long"


def allowed(words: int) -> int:
    """Substitutions allowed in an item shorter than the window."""
    return 0 if words < 8 else 1 if words < 11 else 2


@functools.lru_cache(maxsize=16)
def masks(window: int = WINDOW, substitutions: int = SUBSTITUTIONS, weight: int = WEIGHT) -> tuple[tuple[int, ...], ...]:
    """Few masks of ``weight`` positions of which one, somewhere in the window, avoids any ``substitutions`` positions."""
    misses = [frozenset(c) for c in itertools.combinations(range(window), substitutions)]
    options = []
    for span in range(weight, window + 1):
        for inner in itertools.combinations(range(1, span - 1), weight - 2):
            m = (0, *inner, span - 1)
            options.append((m, frozenset(k for k, bad in enumerate(misses) if any(not any(o + i in bad for i in m) for o in range(window - span + 1)))))
    left, chosen = frozenset(range(len(misses))), []
    while left:
        m, covered = max(options, key=lambda x: len(x[1] & left))
        if not covered & left:
            raise ValueError("no masks of this weight find all windows with so many substitutions")
        chosen.append(m)
        left -= covered
    return tuple(chosen)


_FACTORS = [int(x) | 1 for x in np.random.default_rng(77).integers(1 << 40, 1 << 63, 64)]
_BITS = 22


def _masked(words: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    n = len(words) - mask[-1]
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = words[:n] * np.uint64(_FACTORS[0])
        for j, i in enumerate(mask[1:], 1):
            h += words[i : n + i] * np.uint64(_FACTORS[j])
    return h


class Passages:
    """A block of benchmark items with their masked hashes."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, substitutions: int = SUBSTITUTIONS, weight: int = WEIGHT, shortest: int = 1):
        self.window, self.need = window, window - substitutions
        self.ids = [i for i, _ in items]
        data, offsets = kernels.strings(pa.array([t for _, t in items], pa.large_string()))
        self.words, counts, _ = kernels.words(data, offsets)
        self.ends = np.cumsum(counts)
        self.starts = self.ends - counts
        self.item_of = np.repeat(np.arange(len(items)), counts)
        # (item length or None for all from the window on, mask)
        self.masks = [(None, m) for m in masks(window, substitutions, weight)]
        for n in sorted({int(c) for c in counts if max(1, shortest) <= c < window}):
            self.masks += [(n, m) for m in (masks(n, allowed(n), weight) if allowed(n) else [tuple(range(n))])]
        self.tables = []
        for n, mask in self.masks:
            h = _masked(self.words, mask)
            at = np.arange(len(h))
            whole = self.item_of[at] == self.item_of[at + mask[-1]] if len(at) else np.zeros(0, bool)
            length = counts[self.item_of[at]]
            keep = whole & (length >= window if n is None else length == n)
            at, h = at[keep], h[keep]
            order = np.argsort(h, kind="stable")
            maybe = np.zeros(1 << _BITS, bool)
            maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)] = True
            self.tables.append((h[order], at[order], maybe))

    def _diagonals(self, words: np.ndarray, text_of: np.ndarray) -> np.ndarray:
        """(text, item, distance between the two places) of all hits, in blocks of hits."""
        found = [np.zeros((0, 3), np.int64)]
        for (_, mask), (keys, places, maybe) in zip(self.masks, self.tables, strict=True):
            h = _masked(words, mask)
            at = np.flatnonzero(maybe[(h >> np.uint64(64 - _BITS)).astype(np.int64)]) if len(h) else np.zeros(0, np.int64)
            at = at[text_of[at] == text_of[at + mask[-1]]] if len(at) else at
            lo, hi = np.searchsorted(keys, h[at], "left"), np.searchsorted(keys, h[at], "right")
            at, lo, n = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            total, a = np.cumsum(n), 0
            while a < len(at):
                b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + HITS, "right")))
                k = n[a:b]
                place = places[np.repeat(lo[a:b], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)]
                g = np.repeat(at[a:b], k)
                found.append(np.unique(np.stack([text_of[g], self.item_of[place], g - place], 1), axis=0))
                a = b
        return np.unique(np.concatenate(found), axis=0)

    def _need(self, size: int) -> int:
        """Equal words that a window of ``size`` words must have."""
        return self.need if size == self.window else size - allowed(size)

    def overlaps(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(text, item, start in the text, start in the item, words, equal words) of each text's best overlap with each item."""
        words, counts, _ = kernels.words(data, offsets)
        ends = np.cumsum(counts)
        starts, text_of = ends - counts, np.repeat(np.arange(len(counts)), counts)
        diagonals = self._diagonals(words, text_of)
        if not len(diagonals):
            return []
        t, i, d = diagonals.T
        lo, hi = np.maximum(starts[t], self.starts[i] + d), np.minimum(ends[t], self.ends[i] + d)
        size = np.minimum(self.window, self.ends[i] - self.starts[i])
        keep = hi - lo >= size
        diagonals, lo, hi, size = diagonals[keep], lo[keep], hi[keep], size[keep]
        need = np.array([self._need(k) for k in range(self.window + 1)])[size]
        best: dict[tuple[int, int], tuple[int, int, int, int]] = {}
        length, a = hi - lo, 0
        reach = np.cumsum(length)
        while a < len(diagonals):
            b = max(a + 1, int(np.searchsorted(reach, (reach[a - 1] if a else 0) + HITS, "right")))
            n = length[a:b]
            first = np.cumsum(n) - n
            at = np.arange(n.sum()) - np.repeat(first, n) + np.repeat(lo[a:b], n)
            same = words[at] == self.words[at - np.repeat(diagonals[a:b, 2], n)]
            total = np.concatenate([[0], np.cumsum(same)])
            width = np.repeat(size[a:b], n)
            inside = np.arange(len(at)) + width <= np.repeat(first + n, n)
            equal = total[np.minimum(np.arange(len(at)) + width, len(at))] - total[:-1]
            good = np.flatnonzero(inside & (equal >= np.repeat(need[a:b], n)))
            own = np.searchsorted(first, good, "right") - 1
            for k in np.unique(own).tolist():
                self._best(best, diagonals[a + k], good[own == k] - first[k], same[first[k] : first[k] + n[k]], int(lo[a + k]), int(size[a + k]), starts)
            a = b
        return [(t, i, -x[1], -x[2], x[3], x[0]) for (t, i), x in sorted(best.items())]

    def _best(self, best: dict, diagonal: np.ndarray, good: np.ndarray, same: np.ndarray, lo: int, size: int, starts: np.ndarray) -> None:
        """Keep the stretch of good windows with the most equal words for this text and item (ties: the earliest)."""
        t, i, d = diagonal.tolist()
        for run in np.split(good, np.flatnonzero(np.diff(good) > size) + 1):
            a, b = int(run[0]), int(run[-1]) + size
            inner = np.flatnonzero(same[a:b])
            a, b = a + int(inner[0]), a + int(inner[-1]) + 1
            found = (int(same[a:b].sum()), -(lo + a - int(starts[t])), -(lo + a - d - int(self.starts[i])), b - a)
            if found > best.get((t, i), (0, 0, 0, 0)):
                best[t, i] = found


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_words: int, shortest: int) -> Iterator[Passages]:
    """Items in blocks of bounded size; the driver holds one block at a time."""
    items, size = [], 0
    for r in benchmark.select(benchmark[id_col], benchmark[text_col]).where(benchmark[text_col].isNotNull()).toLocalIterator():
        items.append((r[0], r[1]))
        size += r[1].count(" ") + 1
        if size >= block_words:
            yield Passages(items, shortest=shortest)
            items, size = [], 0
    if items:
        yield Passages(items, shortest=shortest)


def _found(passages: Passages, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
    data, offsets = kernels.strings(column)
    for i, j in kernels.slices(offsets):
        for t, *rest in passages.overlaps(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]):
            yield t + i, *rest


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, shortest: int = 1) -> DataFrame:
    """One row for each document and item that overlap: where the best overlap is, its words, and how many are equal."""
    spark = docs.sparkSession
    narrow, out = docs.select(docs[id_col], docs[text_col]), None
    for block in _blocks(benchmark, item_col, item_text_col, block_words, shortest):
        shared = spark.sparkContext.broadcast(block)  # at most ``block_words`` words and one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                seen: dict[tuple[int, object], tuple] = {}
                for t, i, *rest in _found(shared.value, b.column(1)):
                    key = (t, shared.value.ids[i])
                    if key not in seen or rest[3] > seen[key][3]:
                        seen[key] = tuple(rest)
                rows = [(b.column(0)[t].as_py(), item, *rest) for (t, item), rest in seen.items()]
                columns = list(zip(*rows, strict=True)) or [()] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "doc_start", "item_start", "n_words", "n_equal"])

        part = narrow.mapInArrow(lean(run), SCHEMA)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], SCHEMA)


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS, shortest: int = 1) -> DataFrame:
    """The rows of ``docs``, all their columns, that overlap with no item."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for block in _blocks(benchmark, item_col, item_text_col, block_words, shortest):
        shared = spark.sparkContext.broadcast(block)  # at most ``block_words`` words and one item

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[t for t, *_ in _found(shared.value, b.column(at))]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(lean(run), docs.schema)
    return docs
