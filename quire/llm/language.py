"""Language identification by bit-sliced Bloom filters over character n-grams.

Each filter position holds a bit for every language; the conjunction of an n-gram's positions is the set of all
languages that have it. A text's per-language popcounts, corrected for the filter's false positives, decide.

Defined cases: text that is null or has no letter is ``und`` with score 0; a text with letters of which no n-gram is
known goes to the language with most training texts, with score 0; ties go likewise; repeated rows and null ids are rows
like any other; an empty table gives an empty result; with nothing to learn from all texts are ``und``; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from quire.llm import kernels
from quire.llm.arrow import lean
from quire.llm.folds import SAMPLE_EACH, sample

#: Bytes of an n-gram, positions of the filter (a power of two), hash functions, times an n-gram must occur in the sample.
GRAM, POSITIONS, HASHES, LEAST = 5, 1 << 21, 3, 3

#: Texts of a language for each time more, from one up to LEAST, that an n-gram must occur.
FEW = 50

#: Languages of one word of the filter; more languages take more words. N-grams from which a low score is evidence.
WORD, EVIDENCE = 32, 12

SCHEMA = "doc_id long, lang_pred string, score double, n_grams long"

_FOLD = np.full(256, 32, np.uint8)  # digits and punctuation read as a space
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every n-gram over lower-cased UTF-8 bytes: at most one space at an end and none inside, or a whole shorter word."""
    framed = np.full(len(data) + 2 * (len(offsets) - 1), 32, np.uint8)
    n = np.diff(offsets)
    row = np.repeat(np.arange(len(n)), n)
    framed[np.arange(len(data)) + 2 * row + 1] = _FOLD[data]
    space = framed == 32
    places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for size in range(3, GRAM + 1):  # below GRAM a space, a word and a space
        m = len(framed) - size + 1
        if m < 1:
            continue
        keep = ~space[1 : m + 1]
        for i in range(2, size - 1):
            keep &= ~space[i : m + i]
        if size < GRAM:
            keep &= space[:m] & space[size - 1 : m + size - 1]
        at = np.flatnonzero(keep)
        h = np.zeros(len(at), np.uint64)
        for i in range(size):
            h = (h << np.uint64(8)) | framed[at + i].astype(np.uint64)
        places.append(at)
        hashes.append(h)
    at = np.concatenate(places)
    return kernels.mix(np.concatenate(hashes) + np.uint64(0x51ED27)), np.searchsorted(offsets[1:] + 2 * np.arange(1, len(offsets)), at, "right")


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


class LanguageFilters:
    """The bit-sliced filter and the false-positive rate of each language's slice."""

    def __init__(self, texts: list[str], langs: list[str], least: int = LEAST):
        """Learned from labelled texts; languages in order of their number of texts."""
        names, counts = np.unique(np.array(langs, object).astype(str), return_counts=True) if langs else (np.zeros(0, str), np.zeros(0, int))
        self.names = [str(names[i]) for i in np.lexsort((names, -counts))]
        self.bits = np.zeros((max(1, -(-len(self.names) // WORD)), POSITIONS), np.uint32)
        for k, name in enumerate(self.names):
            data, offsets = kernels.strings(_lower(pa.array([t for t, x in zip(texts, langs, strict=True) if x == name], pa.large_string())))
            found = [np.unique(grams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[0], return_counts=True) for i, j in kernels.slices(offsets)]
            h = np.concatenate([x for x, _ in found])
            order = np.argsort(h, kind="stable")
            h, c = h[order], np.concatenate([x for _, x in found])[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, int)
            total = np.add.reduceat(c, first) if len(first) else np.zeros(0, int)
            for p in self._positions(h[first][total >= min(least, 1 + len(offsets) // FEW)]):
                self.bits[k // WORD, p] |= np.uint32(1 << k % WORD)
        self.false = np.array([float(np.mean(self._slice(self.bits, k))) ** HASHES for k in range(len(self.names))])

    @staticmethod
    def _slice(words: np.ndarray, k: int) -> np.ndarray:
        """The bits of language ``k`` in words of masks."""
        return (words[k // WORD] >> np.uint32(k % WORD)) & np.uint32(1)

    @staticmethod
    def _positions(h: np.ndarray) -> Iterator[np.ndarray]:
        bits = POSITIONS.bit_length() - 1
        for i in range(HASHES):
            yield ((h >> np.uint64(i * (64 - bits) // max(1, HASHES - 1))) & np.uint64(POSITIONS - 1)).astype(np.int64)

    def languages(self, h: np.ndarray) -> np.ndarray:
        """Bit masks, in words, of the languages that have each n-gram (some by error)."""
        p = self._positions(h)
        mask = self.bits[:, next(p)]
        for x in p:
            mask &= self.bits[:, x]
        return mask

    def decide(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, score, n-grams) of each lower-cased text."""
        h, row = grams(data, offsets)
        n = len(offsets) - 1
        total = np.bincount(row, minlength=n)
        mask = self.languages(h)
        counts = np.stack([np.bincount(row[self._slice(mask, k).astype(bool)], minlength=n) for k in range(len(self.names))], 1)
        share = (counts - total[:, None] * self.false) / (1 - self.false) / np.maximum(total, 1)[:, None]
        best = np.argmax(share, 1)
        return best, np.clip(share[np.arange(n), best], 0, 1), total


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", each: int = SAMPLE_EACH) -> LanguageFilters:
    """Filters from about ``each`` labelled documents of every language outside the held-out fold."""
    rows = sample(docs.select(id_col, text_col, lang_col).where(docs[text_col].isNotNull()), id_col, lang_col, each).select(text_col, lang_col).collect()
    return LanguageFilters([r[0] for r in rows], [r[1] for r in rows])


def _predict(f: LanguageFilters, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language number, past the last for ``und``; score; n-grams) of each text of a column."""
    letters = np.asarray(pc.match_substring_regex(column, r"\p{L}").fill_null(False).cast(pa.uint8())).astype(bool)
    n = len(column)
    best, score, total = np.full(n, len(f.names)), np.zeros(n), np.zeros(n, np.int64)
    if f.names:
        data, offsets = kernels.strings(_lower(column))
        for i, j in kernels.slices(offsets, kernels.BLOCK):
            best[i:j], score[i:j], total[i:j] = f.decide(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
    return np.where(letters, best, len(f.names)), np.where(letters, score, 0.0), total


def identify(docs: DataFrame, filters: LanguageFilters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and the number of n-grams looked up, of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # POSITIONS words of 4 bytes for every 32 languages

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.names, "und"], object)
        for b in batches:
            best, score, total = _predict(shared.value, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(names[best], pa.string()), pa.array(score), pa.array(total)], names=["doc_id", "lang_pred", "score", "n_grams"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(lean(predict), SCHEMA)


def keep_identified(docs: DataFrame, filters: LanguageFilters, least: float, text_col: str = "text") -> DataFrame:
    """The rows, all their columns, whose text has a letter and no evidence against all learned languages.

    A score under ``least`` is evidence where the text has ``EVIDENCE`` n-grams or more.
    """
    shared = docs.sparkSession.sparkContext.broadcast(filters)  # POSITIONS words of 4 bytes for every 32 languages
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best, score, total = _predict(shared.value, b.column(at))
            yield b.filter(pa.array((best < len(shared.value.names)) & ((score >= least) | (total < EVIDENCE))))

    return docs.mapInArrow(lean(keep), docs.schema)
