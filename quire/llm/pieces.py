"""SentencePiece BPE: encoding by a table of each prefix's last token, and decoding.

The encoding of a prefix of an encoded text, cut where one of its tokens ends, is a prefix of that encoding, and tokens make
up an encoding exactly if each two neighbours do. So the last token of a prefix is the one vocabulary entry that ends there
(an automaton lists them) and is compatible with the last token of what is before it. A table of these last tokens holds
the encodings of all prefixes; ids are read off it backwards.

Texts are cut where no entry reaches across, as is checked in the vocabulary: before runs of spaces, and after letters and
at line ends. What is between two cuts gets one table, remembered while it is short.

Defined cases: a null text counts as empty and has no ids; white space and characters of no piece are encoded as the
library does it (the latter as bytes); repeated rows and null ids are rows like any other; an empty table gives an empty
result; other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.arrow import CACHES, lean
from quire.llm.bpe import _Memo

#: Characters of a part that is remembered, and parts of a cache's younger half (about 400 bytes each).
REMEMBERED, CACHE_ENTRIES = 40, 250_000
#: How pieces write a space, and the normalizer that changes nothing. Fixed values.
SPACE, IDENTITY = "▁", b"identity"
#: Text of the unknown piece when decoded. Fixed value.
UNKNOWN = " ⁇ "
#: Above every id: a character without piece is the token of this number plus its code point.
_CHARS = 1 << 20
#: Below every score.
_NEVER = float("-inf")

SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _fields(message: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a serialized protocol buffer."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = message[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(message):
        tag = number()
        size = {0: 0, 1: 8, 5: 4}.get(tag & 7)
        if size == 0:
            yield tag >> 3, number()
        else:
            size = number() if size is None else size
            yield tag >> 3, message[at : at + size]
            at += size


def _cuts(joints: set[str]) -> str:
    """Pattern of parts of an escaped text, cut before runs of spaces, after letters and at line ends.

    ``joints`` are all pairs of neighbours in pieces. A letter after which some piece goes on with another kind of character
    counts as another kind itself; with a line end in some piece, only runs of spaces are cut.
    """
    if any("\n" in j for j in joints):
        return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
    letter, other = re.compile(r"[^\W\d_]"), set()
    while found := {a for a, b in joints if letter.match(a) and a not in other and (b in other or not letter.match(b))}:
        other |= found
    more = "".join(map(re.escape, sorted(other)))
    return rf"{SPACE}*[^\W\d_{more}]+|{SPACE}*(?:[^\w{SPACE}\n]|[\d_{more}])+[^\W\d_{more}]*|\n+|{SPACE}+"


class Pieces:
    """One BPE model file of the sentencepiece library."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        model = list(_fields(library.serialized_model_proto()))
        trainer, normal = (dict(_fields(next((v for f, v in model if f == n), b""))) for n in (2, 3))
        # a BPE model with byte fallback; text is only given a space before it and its spaces are written as SPACE
        if trainer.get(3) != 2 or not trainer.get(35) or trainer.get(24) or normal.get(1) != IDENTITY or normal.get(2) or not normal.get(3, 1) or normal.get(4, 1) or not normal.get(5, 1):
            raise ValueError("only BPE models with byte fallback and the identity normalizer are provided for")
        n = library.get_piece_size()
        texts = [library.id_to_piece(i) for i in range(n)]
        other = [library.is_control(i) or library.is_unknown(i) or library.is_byte(i) for i in range(n)]
        if any(library.is_unused(i) for i in range(n)):
            raise ValueError("unused pieces are not provided for")
        self.texts = texts
        self.ids = {t: i for i, t in enumerate(texts) if not other[i]}
        self.scores = {t: library.get_score(i) for t, i in self.ids.items()}
        self.byte_ids = [library.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        #: What each id stands for: bytes, nothing for a control piece.
        self.bytes = [b"" if library.is_control(i) else UNKNOWN.encode() if library.is_unknown(i) else texts[i].replace(SPACE, " ").encode() for i in range(n)]
        for b, i in enumerate(self.byte_ids):
            self.bytes[i] = bytes([b])
        self._ends = ahocorasick.Automaton()
        for t, i in self.ids.items():
            self._ends.add_word(t, (len(t), i))
        self._ends.make_automaton()
        self._decimal = list(map(str, range(n)))
        self._pairs: dict[int, bool] = {}
        self._parts = _Memo(self._part, CACHE_ENTRIES)
        joints = {t[k : k + 2] for t in self.ids for k in range(len(t) - 1)}
        if any(a != SPACE == b for a, b in joints):
            raise ValueError("a piece reaches across the start of a run of spaces")
        self._cut = re.compile(_cuts(joints))

    # -- prefix table -------------------------------------------------------------------------------------------------

    def merged(self, text: str) -> list[str]:
        """BPE of a short text by definition: the best pair that makes a piece is joined, the leftmost of equals, until none is left."""
        parts, score = list(text), self.scores.get
        gains = [score(a + b, _NEVER) for a, b in zip(parts, parts[1:], strict=False)]
        while gains and (best := max(gains)) > _NEVER:
            k = gains.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
            del gains[k]
            if k < len(gains):
                gains[k] = score(parts[k] + parts[k + 1], _NEVER)
            if k:
                gains[k - 1] = score(parts[k - 1] + parts[k], _NEVER)
        return parts

    def _text(self, token: int) -> str:
        return self.texts[token] if token < _CHARS else chr(token - _CHARS)

    def _stays(self, left: int, right: int) -> bool:
        """Whether BPE of two tokens' text leaves these two; ``left`` below 0: whether the right one is left by itself."""
        tokens = [self._text(x) for x in (left, right) if x >= 0]
        if len(self._pairs) > 2_000_000:
            self._pairs.clear()
        out = self._pairs[left << 32 | right] = self.merged("".join(tokens)) == tokens
        return out

    def table(self, text: str) -> list[int]:
        """The last token of the encoding of every prefix of ``text`` (spaces written as SPACE); entry 0 is -1."""
        last, known, done = [-1] * (len(text) + 1), self._pairs, 0
        for end, (length, token) in self._ends.iter(text):
            if end < done:  # the one token that ends here is found
                continue
            while done < end:  # no piece fits there: a character on its own
                last[done + 1] = _CHARS + ord(text[done])
                done += 1
            left = last[end + 1 - length]
            stays = known.get(left << 32 | token)
            if self._stays(left, token) if stays is None else stays:
                last[end + 1], done = token, end + 1
        for at in range(done, len(text)):
            last[at + 1] = _CHARS + ord(text[at])
        return last

    def read_back(self, text: str, table: list[int], end: int | None = None) -> list[int]:
        """Ids of the prefix ``text[:end]``, whole text by default."""
        out, at = [], len(text) if end is None else end
        while at:
            token = table[at]
            if token < _CHARS:
                out.append(token)
                at -= len(self.texts[token])
            else:
                out += [self.byte_ids[b] for b in reversed(chr(token - _CHARS).encode())]
                at -= 1
        return out[::-1]

    def part_ids(self, part: str) -> list[int]:
        """Ids of one part of an escaped text."""
        return self.read_back(part, self.table(part))

    # -- whole texts --------------------------------------------------------------------------------------------------

    @staticmethod
    def escaped(text: str) -> str:
        """The text as pieces write it, with the space that the model puts before it."""
        return SPACE + text.replace(" ", SPACE) if text else ""

    def parts(self, text: str) -> list[str]:
        """Parts of an escaped text: no token reaches from one into the next."""
        return self._cut.findall(text)

    def encode(self, text: str) -> list[int]:
        return [i for part in self.parts(self.escaped(text)) for i in self.part_ids(part)]

    def joined(self, ids: list[int]) -> bytes:
        """The bytes that ids stand for."""
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids: list[int]) -> str:
        """The text of ids without control pieces: bytes that are no UTF-8 become replacement characters, the first space is left out."""
        return self._shown(self.joined(ids))

    @staticmethod
    def _shown(joined: bytes) -> str:
        return joined[joined[:1] == b" " :].decode(errors="replace")

    def _part(self, part: str) -> tuple[int, str, bytes]:
        ids = self.part_ids(part)
        return len(ids), ",".join(map(self._decimal.__getitem__, ids)), self.joined(ids)

    def digest(self, text: str) -> tuple[int, str, str]:
        """(ids, sha256 of the ids in decimal, joined by commas, sha256 of the decoded text) of a whole text."""
        found = [self._parts[p] if len(p) <= REMEMBERED else self._part(p) for p in self.parts(self.escaped(text))]
        ids = ",".join([x[1] for x in found])
        shown = self._shown(b"".join([x[2] for x in found]))
        return sum([x[0] for x in found]), hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """This worker's tables for a model file."""
    return Pieces(path)


CACHES.append(pieces.cache_clear)


def encode_decode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: number of ids, and digests of the ids and of the text that they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            found = [p.digest(t.as_py() or "") for t in b.column(1)]
            n, ids, shown = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(shown, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(lean(run, caches=True), SCHEMA)


def token_ids(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.int64()), pa.array([p.encode(t.as_py() or "") for t in b.column(1)], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(lean(run, caches=True), "doc_id long, ids array<int>")
