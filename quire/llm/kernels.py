"""Array kernels over Arrow string buffers, shared by the text operators.

Texts stay in the Arrow buffer they arrive in: words are found and hashed with whole-array numpy operations, in
blocks of bounded size, so that one very long text costs no more memory at a time than many short ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes handled at a time; bounds the temporaries of the word kernels (about 40 bytes a byte).
BLOCK = 1 << 20

_U = np.uint64
_MUL = _U(0x9E3779B97F4A7C15)


def _byte_values() -> np.ndarray:
    """A 64-bit value per byte, equal for A-Z and a-z."""
    v = np.random.default_rng(20_240_607).integers(1, 1 << 63, 256, dtype=np.uint64) | _U(1)
    v[65:91] = v[97:123]
    return v


_VALUE = _byte_values()
_BASE = 0xD1342543DE82EF95
_BASE_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept for the largest n so far."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, BLOCK + 4096)
        with np.errstate(over="ignore"):
            have = np.full(size, base, np.uint64)
            have[0] = 1
            have = np.cumprod(have)
        _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    lo, hi = int(offsets[0]), int(offsets[-1])
    data = np.frombuffer(data, np.uint8)[lo:hi] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - lo


def slices(offsets: np.ndarray, size: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts take about ``size`` bytes together (a longer text is alone)."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1
        j = min(n, max(i + 1, j))
        yield i, j
        i = j


def _cuts(data: np.ndarray, block: int) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``block`` that end behind white space."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + block)
        if end < n:
            gap = np.flatnonzero(_SPACE[data[at:end]])
            while not len(gap) and end < n:  # one word longer than a block
                more = np.flatnonzero(_SPACE[data[end : end + block]])
                if len(more):
                    gap, end = more + (end - at), min(n, end + block)
                else:
                    end = min(n, end + block)
            if end < n or len(gap):
                end = at + int(gap[-1]) + 1 if len(gap) and end < n else end
        yield at, end
        at = end


def words(data: np.ndarray, offsets: np.ndarray, hashes: bool = True, block: int = BLOCK):
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text, lower-cased A-Z: (hash of each word or None, words per text, first byte of each word).

    Words of one text never join those of the next, even where no white space stands between the two.
    """
    heads, found = [], []
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    for lo, hi in _cuts(data, block):
        part = data[lo:hi]
        solid = ~_SPACE[part]
        before = np.empty_like(solid)
        before[0] = False
        before[1:] = solid[:-1]
        starts = np.flatnonzero(solid & (~before | edge[lo:hi]))
        heads.append(starts + lo)
        if hashes and len(starts):
            after = np.empty_like(solid)
            after[-1] = False
            after[:-1] = solid[1:]
            ends = np.flatnonzero(solid & (~after | edge[lo + 1 : hi + 1])) + 1
            n = hi - lo
            with np.errstate(over="ignore"):
                total = np.empty(n + 1, np.uint64)
                total[0] = 0
                np.cumsum(_VALUE[part] * _power(_BASE, n), out=total[1:])
                h = (total[ends] - total[starts]) * _power(_BASE_INV, n)[starts]
                found.append(mix(h + (ends - starts).astype(np.uint64) * _MUL))
    heads = np.concatenate(heads) if heads else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(heads, offsets))
    return (np.concatenate(found) if found else np.zeros(0, np.uint64)) if hashes else None, counts, heads


def shingles(word_hashes: np.ndarray, counts: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingle hashes of each text; the whole sequence where it has fewer words."""
    ends = np.cumsum(counts)
    with np.errstate(over="ignore"):
        n = len(word_hashes)
        if n >= k:
            rolled = np.zeros(n - k + 1, np.uint64)
            for i in range(k):
                rolled = mix(rolled * _MUL + word_hashes[i : n - k + 1 + i])
        for end, c in zip(ends.tolist(), counts.tolist(), strict=True):
            if c == 0:
                yield np.zeros(0, np.uint64)
            elif c < k:
                h = np.full(1, 0xA5A5_0000 + c, np.uint64)
                for w in word_hashes[end - c : end]:
                    h = mix(h * _MUL + w)
                yield h
            else:
                one = np.sort(rolled[end - c : end - k + 1])
                keep = np.empty(len(one), bool)
                keep[0] = True
                np.not_equal(one[1:], one[:-1], out=keep[1:])
                yield one[keep]
