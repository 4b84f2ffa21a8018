"""Alignment of two tokenizers' tokens over whole texts, by segments that are tokenised once.

Texts are cut before runs of white space, where neither vocabulary has an entry that reaches across (checked in both), so
tokens and aligned groups never leave a segment.

1. Documents are gathered into blocks of a bounded number of segments, and a block names each of its different segments once.
2. A block's segments are dealt by a hash of their text to buckets. A bucket tokenises and aligns each text once, whatever
   number of blocks has it, and sends each block the alignments of its segments.
3. A block composes its documents, and says in how many of them each pair of ids is linked.
4. Blocks get back the sums over all documents for their own pairs, and add them up for each document.

What goes between blocks and buckets is packed, one row for a block and bucket, so rows do not grow with segments. Buckets
grow in number with the characters of the corpus, so that the texts of one fit into a task; rows of a bucket are read one
after the other. Each step is written before the next begins.

Defined cases: a text that is null, empty, or not kept byte for byte by both tokenizers has no tokens, and counts in no
pair; repeated rows are documents of their own; null ids are ids like any other; an empty table gives an empty result;
other columns of the input are not read.
"""

from __future__ import annotations

import functools
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire import scratch
from quire.llm.arrow import CACHES, lean, partition_id
from quire.llm.bpe import encoder
from quire.llm.pieces import SPACE, pieces

#: Segments, repeats counted, at which a block is closed (4 bytes each), and characters of the corpus for each bucket.
BLOCK, BUCKET_CHARS, LEAST_BUCKETS = 500_000, 8_000_000, 64
#: White space before which texts may be cut, where the vocabularies allow it. Fixed values.
SPACES = " \t\n\v\f\r"

COMPOSED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
SUMS = ("n_a", "n_b", "n_groups", "n_links")


def _pack(*parts: np.ndarray | bytes) -> bytes:
    """Several arrays as one compressed string of bytes."""
    raw = [x if isinstance(x, bytes) else np.ascontiguousarray(x).tobytes() for x in parts]
    return zstandard.ZstdCompressor(level=3).compress(np.array([len(x) for x in raw], np.int64).tobytes() + b"".join(raw))


def _unpack(packed: bytes, *kinds: str) -> list[np.ndarray]:
    """The arrays of :func:`_pack`, of the kinds given."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    ends = np.cumsum(np.frombuffer(raw, np.int64, len(kinds))).tolist()
    at = 8 * len(kinds)
    return [np.frombuffer(memoryview(raw)[at + lo : at + hi], kind) for kind, lo, hi in zip(kinds, [0, *ends], ends, strict=False)]


def _offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)]).astype(np.int64)


def _texts(lengths: np.ndarray, data: np.ndarray) -> list[str]:
    raw, ends = data.tobytes(), _offsets(lengths).tolist()
    return [raw[lo:hi].decode() for lo, hi in zip(ends, ends[1:], strict=False)]


def _kind(ids: int) -> str:
    """Integers that hold as many ids."""
    return "<u2" if ids <= 1 << 16 else "<u4"


@functools.lru_cache(maxsize=1)
def _decimals(ids: int) -> list[np.ndarray]:
    """Decimal ids with what may follow them in the text of groups."""
    return [np.array([str(i) + c for i in range(ids)], object) for c in ",|;\n"]


def group_texts(steps: np.ndarray, a: np.ndarray, b: np.ndarray, links: np.ndarray) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each segment; ``links`` are the segments' numbers of links, none of them 0."""
    if not len(links):
        return []
    group = np.cumsum(steps == 0) - 1
    group_a, group_b = group[steps != 2], group[steps != 1]
    last_a, last_b = np.append(group_a[1:] != group_a[:-1], True), np.append(group_b[1:] != group_b[:-1], True)
    closes = np.zeros(len(b), bool)
    closes[np.cumsum(steps != 1)[np.cumsum(links) - 1] - 1] = True
    words = np.empty(len(a) + len(b), object)
    place_a = np.arange(len(a)) + _offsets(np.bincount(group_b))[group_a]
    place_b = np.arange(len(b)) + _offsets(np.bincount(group_a))[1:][group_b]
    tables = _decimals(int(max(a.max(), b.max())) // 8192 * 8192 + 8192)
    for place, ids, sign in ((place_a, a, np.where(last_a, 1, 0)), (place_b, b, np.where(closes, 3, np.where(last_b, 2, 0)))):
        for k, table in enumerate(tables):
            words[place[sign == k]] = table[ids[sign == k]]
    return "".join(words.tolist()).encode().splitlines()


class _Numbers(dict):
    """Numbers keys in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        found = self[key] = len(self)
        return found


class Aligner:
    """Both vocabularies: ``a`` of the tokenizers library (byte-level), ``b`` of sentencepiece."""

    def __init__(self, a: str, b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a, self.b = encoder(a), pieces(b)
        self._library_a, self._library_b = Tokenizer.from_file(a), sentencepiece.SentencePieceProcessor(model_file=b)
        self._library_a.encode_special_tokens = True  # their strings are plain text
        back = {c: i for i, c in enumerate(self.a._alphabet)}
        shown = {i: t for t, i in self._library_a.get_vocab(with_added_tokens=True).items()}
        tokens = [shown.get(i, "") for i in range(max(shown) + 1)]
        self.a_bytes = [bytes(map(back.__getitem__, t)) if all(c in back for c in t) else b"" for t in tokens]
        self._size_a, self._size_b = (np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b.bytes))
        self.kind = _kind(max(len(self.a_bytes), len(self.b.bytes)))
        texts = [x.decode(errors="replace") for x in self.a_bytes] + [t.replace(SPACE, " ") for t in self.b.ids]
        # characters that some entry has after one that is no white space
        reached = {y for t in texts for x, y in zip(t, t[1:], strict=False) if not x.isspace()}
        cuts = re.escape("".join(c for c in SPACES if c not in reached))
        #: White space and what follows it; white space before which nothing may be cut goes on with the segment.
        self._segment = re.compile(rf"\s*\S+(?:[^\S{cuts}]\s*\S*)*|\s+")
        self._one = self.b.ids[SPACE]

    def segments(self, text: str) -> list[str]:
        """Parts of a text; no token of either vocabulary, and no pre-token, reaches from one into the next."""
        return self._segment.findall(text)

    def encode(self, segments: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of segments by both vocabularies."""
        ids_a = [x.ids for x in self._library_a.encode_batch_fast(segments, add_special_tokens=False)]
        # the library puts a space before each text
        spaced = [k for k, t in enumerate(segments) if t[0] == " "]
        ids_b: list = [None] * len(segments)
        for k, found in zip(spaced, self._library_b.encode([segments[k][1:] for k in spaced], num_threads=1), strict=True):
            ids_b[k] = found or [self._one]
        for k, t in enumerate(segments):
            if ids_b[k] is None:
                ids_b[k] = [i for part in self.b.parts(t.replace(" ", SPACE)) for i in self.b.part_ids(part)]
        return ids_a, ids_b

    def kept(self, segments: list[str], ids_a: list[list[int]], ids_b: list[list[int]]) -> list[bool]:
        """Whether both vocabularies keep a segment's bytes."""
        return [b"".join(map(self.a_bytes.__getitem__, x)) == (raw := t.encode()) == b"".join(map(self.b.bytes.__getitem__, y)) and raw != b"" for t, x, y in zip(segments, ids_a, ids_b, strict=True)]

    def align(self, segments: list[str]) -> list[tuple[int, bytes, bytes, bytes]]:
        """Of each segment: links, what is new in each link as bytes (0: a group, 1: the token of a, 2: that of b), and the ids
        of a and of b as integers of :func:`_kind`; no links where a tokenizer does not keep the segment."""
        ids_a, ids_b = self.encode(segments)
        some = [k for k, ok in enumerate(self.kept(segments, ids_a, ids_b)) if ok]
        out = [(0, b"", b"", b"")] * len(segments)
        if not some:
            return out
        n_a, n_b = (_offsets(np.array([len(ids[k]) for k in some], np.int64)) for ids in (ids_a, ids_b))
        a, b = (np.fromiter(chain.from_iterable(ids[k] for k in some), np.int64) for ids in (ids_a, ids_b))
        # both lists of tokens cover the same bytes, segment by segment
        size_a = self._size_a[a]
        end_a, end_b = np.cumsum(size_a), np.cumsum(self._size_b[b])
        first = np.searchsorted(end_b, end_a - size_a, "right")
        n = np.searchsorted(end_b, end_a, "left") - first + 1
        at_a = np.repeat(np.arange(len(a)), n)
        at_b = np.repeat(first - _offsets(n)[:-1], n) + np.arange(n.sum())
        new_a, new_b = np.append(True, at_a[1:] != at_a[:-1]), np.append(True, at_b[1:] != at_b[:-1])
        steps = np.where(new_a & new_b, 0, np.where(new_a, 1, 2)).astype("u1").tobytes()
        links = _offsets(n)[n_a].tolist()
        wide = np.dtype(self.kind).itemsize
        raw_a, raw_b = a.astype(self.kind).tobytes(), b.astype(self.kind).tobytes()
        n_a, n_b = (wide * n_a).tolist(), (wide * n_b).tolist()
        for i, k in enumerate(some):
            out[k] = links[i + 1] - links[i], steps[links[i] : links[i + 1]], raw_a[n_a[i] : n_a[i + 1]], raw_b[n_b[i] : n_b[i + 1]]
        return out


@functools.lru_cache(maxsize=1)
def aligner(a: str, b: str) -> Aligner:
    return Aligner(a, b)


CACHES.append(aligner.cache_clear)


def blocks(docs: DataFrame, a: str, b: str, id_col: str, text_col: str, bound: int, buckets: int) -> DataFrame:
    """Rows of blocks: one without bucket, with the documents' ids, numbers of segments, and segments by their numbers in the block; and one for each bucket, with its segments' numbers and texts."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, number, ids, uses, known, held = aligner(a, b), partition_id() << 32, [], [], _Numbers(), 0

        def close() -> Iterator[pa.RecordBatch]:
            sizes = np.array([len(x) for x in uses], np.int64)
            whole = _pack(np.array([i is None for i in ids], "u1"), np.array([i or 0 for i in ids], "<i8"), sizes, np.concatenate(uses) if uses else np.zeros(0, "<i4"))
            dealt: dict[int, list[bytes]] = {}
            for k, text in enumerate(known):
                raw = text.encode()
                dealt.setdefault(zlib.crc32(raw) % buckets, []).append((k, raw))
            rows = [(None, whole)]
            for bucket, found in dealt.items():
                rows.append((bucket, _pack(np.diff(np.array([k for k, _ in found], "<i4"), prepend=np.int32(0)), np.array([len(x) for _, x in found], "<i4"), b"".join(x for _, x in found))))
            yield pa.RecordBatch.from_arrays([pa.array([number] * len(rows), pa.int64()), pa.array([x for x, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], names=["block", "bucket", "packed"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py()
                found = al.segments(" " + text) if text else []
                ids.append(doc_id)
                uses.append(np.fromiter(map(known.__getitem__, found), "<i4", len(found)))
                held += len(found) + 1
                if held >= bound:
                    yield from close()
                    number, ids, uses, known, held = number + 1, [], [], _Numbers(), 0
        if ids:
            yield from close()

    return docs.select(docs[id_col].cast("long"), docs[text_col]).mapInArrow(lean(cut, caches=True), "block long, bucket int, packed binary")


def aligned(dealt: DataFrame, a: str, b: str) -> DataFrame:
    """Rows (bucket, home, packed texts) become (home, packed alignments); each text of a bucket is aligned once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        al, bucket, known = aligner(a, b), None, {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part, rows, fresh = batch.slice(lo, 64), [], {}
                here = part.column(0).to_pylist()
                for at, packed in zip(here, part.column(2).to_pylist(), strict=True):
                    gaps, lengths, data = _unpack(packed, "<i4", "<i4", "u1")
                    rows.append((at, gaps, _texts(lengths, data)))
                for at in dict.fromkeys(here):  # rows come sorted by bucket
                    if at != bucket:
                        bucket, known = at, {}
                    fresh = list(dict.fromkeys(t for x, _, texts in rows if x == at for t in texts if t not in known))
                    for k in range(0, len(fresh), 20_000):
                        known.update(zip(fresh[k : k + 20_000], al.align(fresh[k : k + 20_000]), strict=True))
                    own = [(gaps, [known[t] for t in texts]) for x, gaps, texts in rows if x == at]
                    packed = [_pack(gaps, np.array([x[0] for x in found], "<i4"), *(b"".join([x[i] for x in found]) for i in (1, 2, 3))) for gaps, found in own]
                    homes = [h for h, x in zip(part.column(1).to_pylist(), here, strict=True) if x == at]
                    yield pa.RecordBatch.from_arrays([pa.array(homes, pa.int64()), pa.array(packed, pa.binary())], names=["home", "packed"])

    ordered = dealt.select("bucket", "home", "packed").repartition("bucket").sortWithinPartitions("bucket")
    return ordered.mapInArrow(lean(run, caches=True), "home long, packed binary")


def _composed(left: pa.Table, right: pa.Table, kind: str) -> pa.Table:
    """One block: its rows (pair, docs), and a row with what its documents have, for :func:`_summed`."""
    block = left.column("block")[0].as_py()
    nulls, ids, sizes, uses = _unpack(left.column("packed")[0].as_py(), "u1", "<i8", "<i8", "<i4")
    rows = [_unpack(x, "<i4", "<i4", "u1", kind, kind) for x in right.column("packed").to_pylist()]
    joined = lambda k: np.concatenate([np.zeros(0, np.int64), *(x[k] for x in rows)]).astype(np.int64)
    numbers = np.concatenate([np.zeros(0, np.int64), *(np.cumsum(x[0]) for x in rows)]).astype(np.int64)
    links, steps, a, b = (joined(k) for k in (1, 2, 3, 4))
    order, segment = np.argsort(numbers), np.repeat(np.arange(len(links)), links)
    pairs, code = np.unique(a[np.cumsum(steps != 2) - 1] << 32 | b[np.cumsum(steps != 1) - 1], return_inverse=True)
    heads = np.stack([np.bincount(segment, x, len(links)).astype(np.int64) for x in (steps != 2, steps != 1, steps == 0)] + [links], 1)
    starts, heads = _offsets(links)[:-1][order], heads[order]
    shown = np.full(len(links), b"", object)
    shown[links > 0] = group_texts(steps, a, b, links[links > 0])
    shown = shown[order].tolist()

    doc = np.repeat(np.arange(len(ids)), sizes)
    lost = heads[:, 3] == 0
    kept = (sizes > 0) & (np.bincount(doc, lost[uses], len(ids)) == 0)
    ends = _offsets(sizes)
    sums = []
    for k in range(4):
        total = _offsets(heads[:, k][uses])
        sums.append(np.where(kept, total[ends[1:]] - total[ends[:-1]], 0))
    digests = []
    for k in range(len(ids)):
        digests.append(hashlib.sha256(b";".join([shown[i] for i in uses[ends[k] : ends[k + 1]].tolist()])).digest() if kept[k] else b"")

    # links of each document, every segment once
    each = np.unique(doc[kept[doc]].astype(np.int64) * max(1, len(lost)) + uses[kept[doc]])
    at, segment = each // max(1, len(lost)), each % max(1, len(lost))
    n = heads[segment, 3]
    found = np.repeat(at, n) * max(1, len(pairs)) + code[np.repeat(starts[segment] - _offsets(n)[:-1], n) + np.arange(n.sum())]
    count = np.bincount(np.unique(found) % max(1, len(pairs)), minlength=len(pairs))
    some = np.flatnonzero(count)
    dense = np.full(len(pairs), -1, np.int64)  # pairs that only documents without tokens have are left out
    dense[some] = np.arange(len(some))
    links = np.repeat(starts - _offsets(heads[:, 3])[:-1], heads[:, 3]) + np.arange(heads[:, 3].sum())
    state = _pack(kept.astype("u1"), *sums, heads[:, 3].astype("<i4"), dense[code[links]].astype("<i4"), b"".join(digests))
    m = len(some)
    return pa.table({"block": pa.array([block] * (m + 1), pa.int64()), "pair": pa.array([None, *pairs[some].tolist()], pa.int64()), "docs": pa.array([None, *count[some].tolist()], pa.int64()), "packed": pa.array([state, *[None] * m], pa.binary())})


def _summed(left: pa.Table, right: pa.Table) -> pa.Table:
    """One block's documents: with the sums over links of how many documents of the corpus have their pair."""
    packed = dict(zip(left.column("composed").to_pylist(), left.column("packed").to_pylist(), strict=True))
    nulls, ids, sizes, uses = _unpack(packed[False], "u1", "<i8", "<i8", "<i4")
    kept, *sums, n, codes, digests = _unpack(packed[True], "u1", *["<i8"] * 4, "<i4", "<i4", "u1")
    order = np.argsort(right.column("pair").to_numpy())  # as numbered
    docs, best = (np.append(right.column(c).to_numpy()[order].astype(np.int64), 0) for c in ("docs", "best"))
    at, ends, more = _offsets(n), _offsets(sizes), []
    for value in (best, docs):
        total = _offsets(value[codes])
        total = _offsets((total[at[1:]] - total[at[:-1]])[uses])
        more.append(np.where(kept > 0, total[ends[1:]] - total[ends[:-1]], 0))
    raw, where, shas = digests.tobytes(), 0, []
    for ok in kept.tolist():
        shas.append(raw[where : where + 32].hex() if ok else "")
        where += 32 * ok
    columns = dict(zip([*SUMS, "n_best", "count_sum"], [*sums, *more], strict=True))
    return pa.table({"doc_id": pa.array(ids, pa.int64(), mask=nulls > 0), **{c: pa.array(v, pa.int64()) for c, v in columns.items()}, "groups_sha256": pa.array(shas, pa.string())})


def _in_task(make, *more):
    """``make`` as Spark takes it: a function of two tables, with nothing left in the worker's memory pool."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = make(left, right, *more)
        pa.default_memory_pool().release_unused()
        return out

    return run


def _whole(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("bucket").isNull()).select("block", "packed")


def _first_pass(rows: DataFrame, a: str, b: str) -> DataFrame:
    """What :func:`_composed` says of all blocks, written. No frame of its plan outlives the call, so that its shuffle files may go."""
    dealt = rows.where(F.col("bucket").isNotNull()).select(F.col("block").alias("home"), "bucket", "packed")
    together = _whole(rows).groupBy("block").cogroup(aligned(dealt, a, b).groupBy("home"))
    return scratch.materialize(together.applyInArrow(_in_task(_composed, aligner(a, b).kind), "block long, pair long, docs long, packed binary"), "align-composed")


def align(docs: DataFrame, a: str, b: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, chars: int = BUCKET_CHARS) -> DataFrame:
    """Per document: tokens, groups, links, links that are their id's most usual, sum of links' counts, digest of the groups."""
    spark = docs.sparkSession
    buckets = max(LEAST_BUCKETS, (docs.agg(F.sum(F.length(docs[text_col]))).first()[0] or 0) // chars)
    rows = scratch.materialize(blocks(docs, a, b, id_col, text_col, block, buckets), "align-blocks")
    composed = _first_pass(spark.read.schema(rows.schema).parquet(rows._quire_path), a, b)
    scratch.release(spark)

    linked = composed.where(F.col("pair").isNotNull()).select(F.col("block").alias("home"), "pair", "docs")
    counts = linked.groupBy("pair").agg(F.sum("docs").alias("docs"))
    # an id of a has no more partners than b has entries
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    counts = scratch.materialize(counts.select("pair", "docs", (F.col("docs") == most).cast("int").alias("best")), "align-pairs")
    known = linked.drop("docs").join(counts.hint("merge"), "pair")
    states = composed.where(F.col("pair").isNull()).select("block", "packed", F.lit(True).alias("composed"))
    return _whole(rows).withColumn("composed", F.lit(False)).union(states).groupBy("block").cogroup(known.groupBy("home")).applyInArrow(_in_task(_summed), COMPOSED)
