"""Byte-level BPE over cached pre-tokens, and exact token counts at every prefix.

A worker keeps one encoder for each vocabulary file. Every text is cut at the vocabulary's special strings, the rest into
pre-tokens by the byte-level pattern, and each pre-token is looked up in a bounded cache. Characters beyond a plain
repertoire, for which a regular expression's classes and the library's may differ, are first replaced by one of the same
class; the library itself is asked once for the class of each such character.
"""

from __future__ import annotations

import array
import functools
import re
import sys

import numpy as np

from quire.llm.arrow import CACHES

#: Pre-tokens of a cache's younger half. Full, it becomes the older half, whose entries last if they are asked for again.
CACHE_ENTRIES = 400_000

#: The pre-token pattern of byte-level BPE, over characters for which \w and \d agree with \p{L} and \p{N}.
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿ]")


class _Shape(dict):
    """Code point -> a plain character of the same class in the pre-token pattern, as the library cuts it."""

    def __init__(self, pieces):
        super().__init__()
        self.pieces = pieces

    def __missing__(self, point: int) -> str:
        c = chr(point)
        if not _OTHER.match(c):
            found = c
        elif len(self.pieces("a" + c)) == 1:
            found = "é"
        elif len(self.pieces("1" + c)) == 1:
            found = "1"
        elif len(self.pieces("!" + c)) == 1:
            found = "!"
        else:
            found = "\t"
        self[point] = found
        return found


def _byte_alphabet() -> list[str]:
    """The printable character that byte-level BPE writes for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class _Memo(dict):
    """A dictionary that makes what it lacks, and forgets what has not been asked for in two fillings."""

    def __init__(self, make, entries: int):
        super().__init__()
        self.make, self.entries, self.older = make, entries, {}

    def __missing__(self, key):
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """One vocabulary file of the tokenizers library."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        import os

        if sys.byteorder != "little" or array.array("I").itemsize != 4:
            raise RuntimeError("ids are kept as the machine's own little-endian 32-bit integers")
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self._model = self.library.model
        self.specials = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        if any(t.lstrip or t.rstrip or t.single_word for t in self.library.get_added_tokens_decoder().values()) or self.library.normalizer is not None:
            raise ValueError("special strings that take their surroundings, and normalizers, are not provided for")
        # the longest special string that starts first, as the library finds them
        self._special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self._shape = _Shape(lambda text: self.library.pre_tokenizer.pre_tokenize_str(text))
        self._ids = _Memo(self._encode_piece, entries)
        self._sums = _Memo(lambda piece: self._fill(piece)[-1], entries)
        self._tables = _Memo(self._fill, entries)
        self._pairs: dict[tuple[str, str], bool] = {}
        self._alphabet = _byte_alphabet()
        self._vocab = self.library.get_vocab(with_added_tokens=False)
        self._longest = max(map(len, self._vocab), default=1)

    def _has_special(self, text: str) -> bool:
        return any(s in text for s in self.specials)

    def shaped(self, text: str) -> str:
        """The text with characters beyond the plain repertoire replaced by plain ones of their class."""
        return text.translate(self._shape) if _OTHER.search(text) else text

    def segments(self, text: str) -> list[tuple[int, int, int | None]]:
        """(start, end, id) of the special strings of a text, and with id None of what is between them."""
        out, at = [], 0
        for m in self._special.finditer(text) if self._special else ():
            out += [(at, m.start(), None), (m.start(), m.end(), self.specials[m[0]])]
            at = m.end()
        return [x for x in [*out, (at, len(text), None)] if x[1] > x[0]]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text without special strings."""
        shape = self.shaped(text)
        return _PIECES.findall(text) if shape is text else [text[m.start() : m.end()] for m in _PIECES.finditer(shape)]

    def encode(self, text: str) -> bytes:
        """Ids of the whole text as little-endian unsigned 32-bit integers."""
        if not self._has_special(text):
            return b"".join(map(self._ids.__getitem__, self.pieces(text)))
        return b"".join(array.array("I", [i]).tobytes() if i is not None else b"".join(map(self._ids.__getitem__, self.pieces(text[a:b]))) for a, b, i in self.segments(text))

    def _letters(self, piece: str) -> str:
        return "".join(map(self._alphabet.__getitem__, piece.encode()))

    def _encode_piece(self, piece: str) -> bytes:
        return array.array("I", [t.id for t in self._model.tokenize(self._letters(piece))]).tobytes()

    # -- prefix dynamic programming -------------------------------------------------------------------------------

    def _stays(self, left: str, right: str) -> bool:
        """Whether BPE over the two tokens' bytes leaves exactly these two tokens; remembered."""
        if len(self._pairs) > 2 * CACHE_ENTRIES:
            self._pairs.clear()
        known = self._pairs[left, right] = [t.value for t in self._model.tokenize(left + right)] == [left, right]
        return known

    def table(self, piece: str) -> tuple[int, ...]:
        """Token counts of every byte prefix of one pre-token: entry i is for its first i bytes.

        The last token of each prefix's encoding is the one vocabulary entry that ends there and stays separate from
        the last token of what is before it, so each prefix needs one step from a shorter one and none is encoded.
        """
        return self._tables[piece]

    def _fill(self, piece: str) -> tuple[int, ...]:
        s = self._letters(piece)
        vocab, known, longest, n = self._vocab, self._pairs, self._longest, len(s)
        counts, last = [0] * (n + 1), [""] * (n + 1)
        for end in range(1, n + 1):
            for start in range(end - longest if end > longest else 0, end):
                t = s[start:end]
                if t not in vocab:
                    continue
                if start:
                    pair = last[start], t
                    stays = known[pair] if pair in known else self._stays(*pair)
                else:
                    stays = end == 1 or self._whole(t)
                if stays:
                    counts[end], last[end] = counts[start] + 1, t
                    break
            else:  # no entry fits: count this prefix by the library
                found = [x.value for x in self._model.tokenize(s[:end])]
                counts[end], last[end] = len(found), found[-1]
        return tuple(counts)

    @functools.lru_cache(maxsize=100_000)  # noqa: B019  encoders live as long as the worker
    def _whole(self, token: str) -> bool:
        """Whether BPE over a token's own bytes gives that token."""
        return len(self._model.tokenize(token)) == 1

    def count(self, text: str) -> int:
        """Tokens of the whole text: the last entries of its pre-tokens' tables."""
        return sum(1 if i is not None else sum(self.sizes(self.pieces(text[a:b]))) for a, b, i in self.segments(text))

    def sizes(self, pieces: list[str]) -> list[int]:
        """Tokens of each pre-token: the last entry of its table."""
        return list(map(self._sums.__getitem__, pieces))

    def fitting(self, text: str, budget: int) -> tuple[int, int]:
        """(tokens of the text, code points of its longest prefix within the budget)."""
        if self._has_special(text):
            p = PrefixCounts(self, text)
            return p.at(len(text)), p.longest(budget)
        pieces = self.pieces(text)
        sizes = self.sizes(pieces)
        total = sum(sizes)
        if total <= budget:
            return total, len(text)
        k, used = 0, 0
        while used <= budget:
            used += sizes[k]
            k += 1
        # the last prefix within the budget ends near pre-token k: look there, from a pre-token that begins a new run
        first = max(0, k - 4)
        while first and pieces[first].isspace():
            first -= 1
        stop = k + 1
        while stop < len(pieces) and pieces[stop - 1].isspace():
            stop += 1
        tail = PrefixCounts(self, "".join(pieces[first : stop + 1]))
        return total, sum(map(len, pieces[:first])) + tail.longest(budget - sum(sizes[:first]))

    def prefixes(self, text: str) -> "PrefixCounts":
        return PrefixCounts(self, text)


class PrefixCounts:
    """Exact token counts of all prefixes of one text, without encoding any of them.

    Holds the count and start of each pre-token; a prefix that ends inside one adds an entry of that pre-token's
    table. Three ends need care, as they are cut differently than in the whole text: a run of white space at the end is
    one pre-token, half a contraction is an apostrophe and letters, and part of a special string is ordinary text, which
    goes on from the last pre-token before it.
    """

    def __init__(self, encoder: Encoder, text: str):
        self.encoder, self.text = encoder, text
        self.pieces, self.special, self.shape, sizes = [], set(), "", []
        for a, b, i in encoder.segments(text):
            part = encoder.shaped(text[a:b])
            if i is None:
                spans = [(a + m.start(), a + m.end()) for m in _PIECES.finditer(part)]
                sizes += encoder.sizes([text[x:y] for x, y in spans])
                self.pieces += spans
                self.shape += part
            else:
                self.special.add(len(self.pieces))
                self.pieces.append((a, b))
                sizes.append(1)
                self.shape += "!" * (b - a)
        self.before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)
        self.starts = np.array([a for a, _ in self.pieces] + [len(text)], np.int64)

    def at(self, end: int) -> int:
        """Tokens of ``text[:end]`` (code points)."""
        end = max(0, min(end, len(self.text)))
        if not end:
            return 0
        k = int(np.searchsorted(self.starts, end, "right")) - 1
        if k in self.special and end > self.starts[k]:
            back = k if k == 0 or k - 1 in self.special else k - 1
            return int(self.before[back]) + self.encoder.count(self.text[int(self.starts[back]) : end])
        if self.shape[end - 1].isspace() and end < len(self.text):
            run, first = end, int(self.starts[max([x for x in (k - 1, k) if x in self.special], default=-1) + 1]) if {k - 1, k} & self.special else 0
            while run > first and self.shape[run - 1].isspace():
                run -= 1
            return (self._inside(run) if run else 0) + self.encoder.table(self.text[run:end])[-1]
        return self._inside(end)

    def _inside(self, end: int) -> int:
        k = int(np.searchsorted(self.starts, end, "right")) - 1
        start = int(self.starts[k])
        if start == end:
            return int(self.before[k])
        part = self.text[start:end]
        if part[0] == "'" and len(part) == 2 and part[1].isalpha() and end < self.pieces[k][1]:
            return int(self.before[k]) + self.encoder.table("'")[-1] + self.encoder.table(part[1])[-1]
        return int(self.before[k]) + self.encoder.table(self.text[start : self.pieces[k][1]])[len(part.encode())]

    def longest(self, budget: int) -> int:
        """Code points of the longest prefix of at most ``budget`` tokens.

        Counts of prefixes are not monotone (a longer prefix can merge to fewer tokens), so the answer is the largest
        ``end`` with ``at(end) <= budget``; a pre-token beyond the first excess can only be reached through its start,
        whose count is a lower bound for all that follows, which ends the search.
        """
        n = len(self.text)
        if self.at(n) <= budget:
            return n
        k = int(np.searchsorted(self.before, budget, "right"))  # pre-token k starts beyond the budget
        stop = int(self.starts[min(k, len(self.starts) - 1)])
        while stop < n and self.shape[stop].isspace():
            stop += 1
        return next(e for e in range(min(stop, n), -1, -1) if self.at(e) <= budget)


@functools.lru_cache(maxsize=4)
def encoder(path: str, entries: int = CACHE_ENTRIES) -> Encoder:
    """This worker's encoder for a vocabulary file, with caches of twice ``entries`` pre-tokens (about 300 bytes each)."""
    return Encoder(path, entries)


CACHES.append(encoder.cache_clear)
