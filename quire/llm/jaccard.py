"""Exact Jaccard join of word n-gram sets by vertical partitioning of the global n-gram order.

The order of all n-grams is that of their hashes. It is cut into fragments; a pair's overlap is the sum of its overlaps in
the fragments. Three steps:

* candidates: a linked pair differs in at most k n-grams, so it disagrees in at most k fragments, and of the first k + 1
  fragments of each that hold something at least one is the same for both. Sets meet under the hashes of those (fragment,
  its n-grams), which strangers almost never share, however common their single n-grams are. A set with no more than k
  such fragments is cut anew in another order, until it has enough; both sets of a pair go through the same cuts as far as
  the first that suits one of them, so no pair is lost and no set is ever met by what it lacks;
* bounds: the parity of the n-grams that fall on each bit of a sketch; two sketches differ in no more bits than the sets
  differ in n-grams, so pairs whose sketches differ in too many bits are dropped without loss;
* counting: the sets that met someone are written once, cut into fragments; a candidate pair's n-grams are compared
  fragment by fragment, partial overlaps counted apart and summed.

Equal sets are one node. Buckets of a fragment hash are not expanded into pairs: members are compared to one hub each,
and then only members of different components are compared, block by block, so a group of n near copies costs about n
comparisons.
Large buckets of members that do not link are split by the hashes of other families of cuts first, under each of which a
linked pair must meet again. Hot keys of every join are spread over tasks.

Defined cases: null texts, and texts without words, have the empty set and link with nothing; shorter texts than n words
have one n-gram, the whole sequence; rows that repeat an id are rows of one node each, their component is the smallest id
reachable; null ids keep their rows, with a null component unless linked with others; an empty table gives an empty
result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import scratch
from quire.llm import kernels
from quire.llm.arrow import lean, small, spread
from quire.llm.components import components

_U = np.uint64

#: N-grams of a counting fragment at most, about; fragments that every set is cut into at least.
COUNT_FRAGMENT, LEAST_FRAGMENTS = 1024, 4

#: N-grams or signatures of a batch that a task gives out, about.
OUT_GRAMS = 1 << 18

#: 64-bit words of the bitmap of shared signatures (16 bytes a word are sent to every task, whatever the input).
BITMAP_WORDS = 1 << 19

#: 64-bit words of the smallest parity sketch.
LEAST_SKETCH = 16

#: Cuts that a family tries before it meets a set by each of its n-grams (which also finds every linked pair).
TRIES = 32

#: Members outside the hub's component that a bucket is compared with at once; buckets with more are split by up to so many
#: further families of cuts.
BUCKET_OUT, FAMILIES = 1 << 14, 3

#: Sketch words of a block of members, about; blocks are compared two by two, in pieces of so many sketch words.
BLOCK_WORDS, PIECE_WORDS = 1 << 15, 1 << 19


class Cuts:
    """Size classes and fragment numbers for one threshold ``share`` / 100."""

    def __init__(self, share: int):
        if not 50 < share <= 100:
            raise ValueError("the threshold is over 50 and at most 100 hundredths")
        self.share, self.lower, self.plans, self.met = share, [1], {}, {}

    def _grow(self, n: int) -> None:
        while self.lower[-1] <= n:
            self.lower.append(max(self.lower[-1] + 1, self.lower[-1] * 3 // 2))

    def size_class(self, n: int) -> int:
        """The class c with lower[c] <= n < lower[c + 1]."""
        self._grow(n)
        return int(np.searchsorted(self.lower, n, "right")) - 1

    def upper(self, c: int) -> int:
        """The largest size of class ``c``."""
        while len(self.lower) <= c + 1:
            self._grow(self.lower[-1])
        return self.lower[c + 1] - 1

    def differ(self, n: int, c: int | None = None) -> int:
        """The most n-grams in which a set of ``n`` differs from a linked one, the smaller of the two being of class ``c``."""
        other = n * 100 // self.share if c is None or self.upper(c) >= n else self.upper(c)
        return (n + other) * (100 - self.share) // (100 + self.share)

    def fragments(self, c: int) -> int:
        """Fragments for class ``c``: the fewest of which its sets fill more than they may differ in, in most cuts.

        0 where no number of them does: there every n-gram is a fragment of its own.
        """
        if c not in self.plans:
            ends = [(n, self.differ(n) + 1) for n in (self.lower[c] if c < len(self.lower) else self.upper(c - 1) + 1, self.upper(c))]
            most = 64 * sum(n for n, _ in ends)

            def fills(m: int) -> bool:
                for n, need in ends:
                    empty = math.exp(-n / m)
                    if m * (1 - empty) - math.sqrt(max(0.0, m * empty * (1 - (1 + n / m) * empty))) < need:
                        return False
                return True

            lo, hi = 0, 1
            while hi <= most and not fills(hi):
                lo, hi = hi, 2 * hi
            while hi - lo > 1 and hi <= most:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if fills(mid) else (mid, hi)
            self.plans[c] = hi if hi <= most else 0
        return self.plans[c]

    def classes(self, n: int) -> list[tuple[int, int, int]]:
        """(class, its fragments, fragments to meet under) of a set of ``n`` n-grams, as the smaller and the larger of a pair."""
        if n not in self.met:
            own, least = self.size_class(n), self.size_class(max(1, -(-n * self.share // 100)))
            self.met[n] = [(c, self.fragments(c), self.differ(n, c) + 1) for c in range(least, own + 1) if self.differ(n, c)]
        return self.met[n]


def _fragment_of(s: np.ndarray, m: int) -> np.ndarray:
    """The fragment, 0 .. m - 1, of each hash: ``m`` equal ranges of the global order."""
    return ((s >> _U(32)) * _U(m)) >> _U(32)


def signatures(s: np.ndarray, cuts: Cuts, family: int = 0) -> np.ndarray:
    """Hashes under which a set can be met: linked sets that differ share one, in every family of cuts."""
    out, orders = [], {}
    with np.errstate(over="ignore"):
        for c, m, need in cuts.classes(len(s)):
            for t in range(family * TRIES, (family + 1) * TRIES) if m else ():
                if t not in orders:
                    x = s if t == 0 else np.sort(kernels.mix(s + _U(0x9E3779B97F4A7C15) * _U(t)))
                    orders[t] = x, kernels.mix(x + _U(0x2545F4914F6CDD1D))
                x, spun = orders[t]
                at = _fragment_of(x, m)
                first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
                base = kernels.mix(np.array([c, t], np.uint64) + _U(0x9E37))
                total = np.add.reduceat(spun, first)[:need]
                out.append(kernels.mix(total + kernels.mix(base[0] + (base[1] ^ at[first[:need]]))))
                if len(first) >= need:
                    break
            else:
                out.append(kernels.mix(s[:need] + kernels.mix(np.array([c], np.uint64) + _U(0x51))))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity of the set's hashes on each bit, as signed 64-bit words; about a bit for an n-gram, a power of two of words.

    Halves of a sketch put together by XOR are the sketch of half the length.
    """
    words = LEAST_SKETCH
    while 64 * words < len(s):
        words *= 2
    odd = np.bincount((kernels.mix(s + _U(0x1B873593)) % _U(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def node_id(s: np.ndarray) -> int:
    """A 64-bit id of a set, equal for equal sets."""
    with np.errstate(over="ignore"):
        return int(kernels.mix(np.array([np.sum(kernels.mix(s), dtype=np.uint64) + _U(len(s)) * _U(0x9E3779B97F4A7C15)])).view(np.int64)[0])


def _sets(b: pa.RecordBatch, column: int, n: int) -> Iterator[np.ndarray]:
    data, offsets = kernels.strings(b.column(column))
    for i, j in kernels.slices(offsets):
        h, counts, _ = kernels.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        yield from kernels.shingles(h, counts, n)


def _signed(docs: DataFrame, n: int, share: int) -> DataFrame:
    """doc_id, h, size of every row; sketch and signatures where a task meets a set for the first time."""

    def packed(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
        h, sizes, sketches, sigs = zip(*rows, strict=True)
        lists = []
        for x in (sigs, sketches):
            off = pa.array(np.concatenate([[0], np.cumsum([0 if y is None else len(y) for y in x])]).astype(np.int32))
            lists.append(pa.ListArray.from_arrays(off, pa.array(np.concatenate([np.zeros(0, np.int64), *(y for y in x if y is not None)]))))
        return pa.RecordBatch.from_arrays([ids, pa.array(h, pa.int64()), pa.array(sizes, pa.int64()), pa.array([x is not None for x in sigs], pa.bool_()), *lists], names=["doc_id", "h", "size", "first", "sigs", "sketch"])

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, met = Cuts(share), set()
        for b in batches:
            rows, size, at = [], 0, 0
            for s in _sets(b, 1, n):
                h = node_id(s) if len(s) else None
                new = h is not None and h not in met
                met.add(h)
                rows.append((h, len(s), sketch(s) if new else None, signatures(s, cuts).view(np.int64) if new else None))
                size += len(rows[-1][3]) if new else 0
                if size > OUT_GRAMS:
                    yield packed(b.column(0).slice(at, len(rows)), rows)
                    rows, size, at = [], 0, at + len(rows)
            if rows:
                yield packed(b.column(0).slice(at, len(rows)), rows)

    return docs.mapInArrow(lean(sign), "doc_id long, h long, size long, first boolean, sigs array<long>, sketch array<long>")


def _fragments_of(size: int) -> int:
    """Counting fragments of a pair whose smaller set has ``size`` n-grams."""
    f = LEAST_FRAGMENTS
    while f * COUNT_FRAGMENT < size:
        f *= 2
    return f


def _fragments_column(size):
    return F.greatest(F.lit(LEAST_FRAGMENTS), F.pow(F.lit(2.0), F.ceil(F.log2(size / COUNT_FRAGMENT))).cast("int"))


def _cut_sets(docs: DataFrame, known: DataFrame, n: int, share: int) -> DataFrame:
    """h, of, f, grams: the sets of ``known`` cut into ``of`` fragments, for every ``of`` that a pair of theirs can need."""

    def packed(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
        h, of, number, grams = zip(*rows, strict=True)
        off = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in grams])]).astype(np.int32))
        return pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(of, pa.int32()), pa.array(number, pa.int32()), pa.ListArray.from_arrays(off, pa.array(np.concatenate(grams)))], names=["h", "of", "f", "grams"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met, rows, size = set(), [], 0
        for b in batches:
            for s in _sets(b, 0, n):
                if not len(s) or (k := node_id(s)) in met:
                    continue
                met.add(k)
                for m in {_fragments_of(len(s)), _fragments_of(-(-len(s) * share // 100))}:
                    edges = np.searchsorted(_fragment_of(s, m), np.arange(m + 1)).tolist()
                    rows += [(k, m, f, s[edges[f] : edges[f + 1]].view(np.int64)) for f in range(m)]
                    size += len(s)
                if size > OUT_GRAMS:
                    yield packed(rows)
                    rows, size = [], 0
        if rows:
            yield packed(rows)

    # filtered where they are made if the ids are few enough to send to every task, else after a shuffle
    sets = docs.select("text").mapInArrow(lean(cut), "h long, of int, f int, grams array<long>").join(small(known.select("h")), "h", "left_semi")
    # a set met by several tasks is there once only
    return scratch.materialize(sets.dropDuplicates(["h", "of", "f"]), "jaccard-sets")


def _links(sets: DataFrame, pairs: DataFrame, share: int) -> DataFrame:
    """Of candidate ``pairs`` (a, b, size_a, size_b) those that link: partial overlaps by fragment, summed by pair."""
    p = pairs.withColumn("of", _fragments_column(F.least("size_a", "size_b")))
    left = sets.select(F.col("h").alias("a"), "of", "f", F.col("grams").alias("grams_a"))
    right = sets.select(F.col("h").alias("b"), "of", "f", F.col("grams").alias("grams_b"))
    cut = scratch.materialize(p.join(left, ["a", "of"]), "jaccard-cut")
    partial = spread(cut, right, ["b", "of", "f"]).select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("partial"))
    overlap = partial.groupBy("a", "b", "size_a", "size_b").agg(F.sum("partial").alias("overlap"))
    out = scratch.materialize(overlap.where(F.col("overlap") * (100 + share) >= share * (F.col("size_a") + F.col("size_b"))).select("a", "b"), "jaccard-links")
    scratch.drop(cut)
    return out


def _may_link(share: int, size_a, size_b, a: str, b: str):
    """Whether sizes and parity sketches leave a pair possible; a sketch of twice the other's length is put together."""
    a, b = F.col(a), F.col(b)
    words = F.least(F.size(a), F.size(b))

    def half(x):
        return F.when(F.size(x) > words, F.zip_with(F.slice(x, F.lit(1), words), F.slice(x, words + 1, words), lambda p, q: p.bitwiseXOR(q))).otherwise(x)

    bits = F.aggregate(F.zip_with(half(a), half(b), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda n, x: n + x)
    sized = F.least(size_a, size_b) * 100 >= F.greatest(size_a, size_b) * share
    return sized & F.when(sized, bits * (100 + share) <= (size_a + size_b) * (100 - share)).otherwise(F.lit(False))


def _classified(docs: DataFrame, n: int, share: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, h (its set, null without words), size, least (smallest id of its component), least_h (that row's set) of every row."""
    docs = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    signed = scratch.materialize(_signed(docs, n, share), "jaccard-signed")
    sigs = signed.where("first").select("h", F.explode("sigs").alias("sig"))
    # one hub for every signature that at least two sets have
    hubs = sigs.groupBy("sig").agg(F.min("h").alias("hub"), F.max("h").alias("top")).where("hub < top").select("sig", "hub")
    hubs = scratch.materialize(hubs, "jaccard-hubs")
    # a bitmap of those signatures, of fixed size, spares most of the others the shuffle
    word, bit = F.shiftright("sig", 6).bitwiseAND(F.lit(BITMAP_WORDS - 1)), F.col("sig").bitwiseAND(F.lit(63)).cast("int")
    bitmap = F.broadcast(hubs.groupBy(word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(sig & 63L as int))")).alias("bits")))
    likely = scratch.materialize(sigs.join(bitmap, word == F.col("word")).where(F.getbit("bits", bit) == 1).select("h", "sig"), "jaccard-likely")
    stars = scratch.materialize(spread(likely, hubs, ["sig"]).where("h <> hub").groupBy("h", "hub").agg(F.count(F.lit(1)).alias("shared")), "jaccard-stars")
    rows = scratch.materialize(signed.select("doc_id", "h", "size"), "jaccard-rows")
    # from here on only sets that share a signature
    met = stars.select("h").unionByName(stars.select(F.col("hub").alias("h"))).distinct()
    nodes = signed.where("first").select("h", "size", F.col("sketch").alias("k")).dropDuplicates(["h"])
    known = scratch.materialize(nodes.join(met, "h", "left_semi"), "jaccard-known")
    for done in (signed, hubs, likely):
        scratch.drop(done)
    scratch.release(docs.sparkSession)
    # a set's hubs in one row: no more of them than it has signatures
    held = scratch.materialize(stars.groupBy("h").agg(F.collect_list(F.struct("shared", "hub")).alias("hubs")), "jaccard-held")
    scratch.drop(stars)
    work = _Counting(docs, known, n, share)
    # first every member with the hub it shares most with, then with those hubs that are not in its component yet
    work.compare(held.select(F.col("h").alias("a"), F.array_max("hubs")["hub"].alias("b")))
    work.compare(_apart(held, work.roots).select(F.col("h").alias("a"), F.col("hub").alias("b")))
    work.count(_cross(docs, held, known, work.roots, n, share))
    roots = work.roots
    # the smallest id of each set first, then of each component, then of each row whose set is not alone
    of_set = rows.where("h is not null").groupBy("h").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")).alias("s"), F.count(F.lit(1)).alias("_rows"))
    of_set = scratch.materialize(of_set.join(roots.select(F.col("node").alias("h"), "root"), "h", "left").where("_rows > 1 or root is not null").select("h", F.coalesce("root", "h").alias("c"), "s"), "jaccard-of-set")
    of_c = of_set.groupBy("c").agg(F.min("s").alias("best"))
    of_set = spread(of_set.select("h", "c"), of_c, ["c"]).select("h", F.col("best.doc_id").alias("least"), F.col("best.h").alias("least_h"), F.lit(True).alias("grouped"))
    out = spread(rows, scratch.materialize(of_set, "jaccard-least"), ["h"], "left")
    alone = F.col("grouped").isNull()
    return out.select("doc_id", "h", "size", F.when(alone, F.col("doc_id")).otherwise(F.col("least")).alias("least"), F.when(alone, F.col("h")).otherwise(F.col("least_h")).alias("least_h"))


class _Counting:
    """Links found so far and their components; sets are cut once, when a pair first needs them."""

    def __init__(self, docs: DataFrame, known: DataFrame, n: int, share: int):
        self.docs, self.known, self.n, self.share = docs, known, n, share
        self.sets = self.cut = self.links = None
        self.roots = docs.sparkSession.createDataFrame([], "node long, root long")

    def compare(self, pairs: DataFrame) -> None:
        """Count the pairs (a, b) that sizes and sketches leave possible."""
        a, b = (self.known.select(F.col("h").alias(v), F.col("size").alias(f"size_{v}"), F.col("k").alias(f"k_{v}")) for v in ("a", "b"))
        sided = scratch.materialize(pairs.join(a, "a"), "jaccard-sided")
        self.count(spread(sided, b, ["b"]).where(_may_link(self.share, F.col("size_a"), F.col("size_b"), "k_a", "k_b")).select("a", "b", "size_a", "size_b"))
        scratch.drop(sided)

    def count(self, pairs: DataFrame) -> None:
        """Count the overlaps of pairs (a, b, size_a, size_b), and bring links and components up to date."""
        pairs = scratch.materialize(pairs, "jaccard-pairs")
        if not pairs.take(1):
            return
        ids = pairs.select(F.col("a").alias("h")).unionByName(pairs.select(F.col("b").alias("h"))).distinct()
        ids = scratch.materialize(ids if self.cut is None else ids.join(self.cut, "h", "left_anti"), "jaccard-cut-ids")
        if ids.take(1):
            cut = _cut_sets(self.docs, ids, self.n, self.share)
            self.sets, self.cut = (cut, ids) if self.cut is None else (self.sets.unionByName(cut), self.cut.unionByName(ids))
        links = _links(self.sets, pairs, self.share)
        self.links = links if self.links is None else self.links.unionByName(links)
        self.roots = scratch.materialize(components(self.links), "jaccard-roots")


def _owned(held: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(h, c, hubs) with each set's component, and the distinct (c, hub, c_hub) of different components."""
    owned = scratch.materialize(held.join(roots.withColumnRenamed("node", "h"), "h", "left").select("h", F.coalesce("root", "h").alias("c"), "hubs"), "jaccard-owned")
    met = scratch.materialize(owned.select("c", F.explode("hubs.hub").alias("hub")).distinct(), "jaccard-met")
    apart = spread(met, roots.withColumnRenamed("node", "hub"), ["hub"], "left").select("c", "hub", F.coalesce("root", "hub").alias("c_hub"))
    return owned, scratch.materialize(apart.where("c <> c_hub"), "jaccard-apart")


def _apart(held: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, hub) of every set and hub of its in different components."""
    owned, apart = _owned(held, roots)
    return owned.select("h", "c", F.explode("hubs.hub").alias("hub")).join(apart, ["c", "hub"], "left_semi").select("h", "hub")


def _cross(docs: DataFrame, held: DataFrame, known: DataFrame, roots: DataFrame, n: int, share: int) -> DataFrame:
    """Pairs of one hub's members in different components, of which at least one is not in the hub's.

    Linked sets share a signature, so both are members of its hub (or are it); pairs with the hub itself are known. A hub
    with too many such members is split: linked sets share a signature in every family of cuts, so only those of its
    members that do stay together. What no family can split is compared all the same.
    """
    owned, apart = _owned(held, roots)
    hubs = scratch.materialize(apart.select("hub", "c_hub").distinct(), "jaccard-open-hubs")
    members = scratch.materialize(owned.select("h", "c", F.explode("hubs.hub").alias("hub")).join(hubs.select("hub"), "hub", "left_semi"), "jaccard-members")
    stated = scratch.materialize(spread(members, hubs, ["hub"]).select(F.col("hub").alias("g"), "h", "c", (F.col("c") != F.col("c_hub")).alias("out")), "jaccard-tied")
    stated = spread(stated, known.select("h", "size", "k"), ["h"])
    groups, found, sets = scratch.materialize(stated, "jaccard-stated"), None, None
    for family in range(1, FAMILIES + 2):
        words = F.size("k").cast("long")
        outs = groups.groupBy("g").agg(F.count_if("out").alias("outs"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("out"), words)).alias("out_words"), F.sum(F.when(~F.col("out"), words)).alias("in_words")).where("outs > 0 and n > 1").drop("n")
        groups = scratch.materialize(spread(groups, scratch.materialize(outs, "jaccard-outs"), ["g"]), "jaccard-groups")
        large = F.lit(False) if family > FAMILIES else F.col("outs") > BUCKET_OUT
        pairs = scratch.materialize(_member_pairs(groups.where(~large), share), "jaccard-member-pairs")
        found = pairs if found is None else found.unionByName(pairs)
        hot = groups.where(large).select("g", "h", "size", "k", "c", "out")
        if not hot.take(1):
            break
        if sets is None:
            sets = _cut_sets(docs, scratch.materialize(hot.select("h").distinct(), "jaccard-hot-ids"), n, share)
        groups = scratch.materialize(_split(hot, known, sets, share, family), "jaccard-split")
    return found.distinct()


def _member_pairs(groups: DataFrame, share: int) -> DataFrame:
    """(a, b, size_a, size_b) of every two members of a group in different components that may link and of which one is marked ``out``.

    Members are gathered into blocks of bounded size, those marked ``out`` apart; each of their blocks meets the group's
    blocks, and only pairs that sizes and sketches leave possible become rows.
    """
    blocks = F.ceil(F.when(F.col("out"), F.col("out_words")).otherwise(F.col("in_words")) / BLOCK_WORDS)
    gathered = groups.groupBy("g", "out", F.pmod(F.xxhash64("h"), blocks).alias("block")).agg(F.collect_list(F.struct("h", "size", "c", "k")).alias("members"))
    y = scratch.materialize(gathered, "jaccard-blocks")
    x = y.where("out").select("g", F.col("block").alias("block_x"), F.col("members").alias("x"))
    met = spread(y, x, ["g"]).where(~F.col("out") | (F.col("block_x") <= F.col("block")))
    return met.select("x", F.col("members").alias("y"), (F.col("out") & (F.col("block_x") == F.col("block"))).alias("same")).mapInArrow(lean(_possible_pairs(share)), "a long, b long, size_a long, size_b long")


def _possible_pairs(share: int):
    """Rows (x, y, same), two blocks of members, to their possible pairs; ``same`` says that the two are one block."""

    def members(column: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        m = column[i].values
        h, size, c = (np.asarray(m.field(v)) for v in ("h", "size", "c"))
        k = m.field("k")
        ends = np.asarray(k.offsets)
        words, first, values = ends[1:] - ends[:-1], ends[:-1], np.asarray(k.values).view(np.uint64)
        by_length = []
        for w in np.unique(words).tolist():
            at = np.flatnonzero(words == w)
            by_length.append((at, values[first[at][:, None] + np.arange(w)]))
        return h, size, c, by_length

    def folded(k: np.ndarray, words: int) -> np.ndarray:
        while k.shape[1] > words:
            k = k[:, : k.shape[1] // 2] ^ k[:, k.shape[1] // 2 :]
        return k

    def possible(x, y, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
        (hx, sx, cx, kx), (hy, sy, cy, ky) = x, y
        for at_x, all_x in kx:
            for at_y, all_y in ky:
                words = min(all_x.shape[1], all_y.shape[1])
                a, b = folded(all_x, words), folded(all_y, words)
                rows, step = max(1, PIECE_WORDS // max(1, len(at_y))), max(1, PIECE_WORDS // words)
                for begin in range(0, len(at_x), rows):
                    own = at_x[begin : begin + rows, None]
                    least, most = np.minimum(sx[own], sy[at_y]), np.maximum(sx[own], sy[at_y])
                    mask = (cx[own] != cy[at_y]) & (least * 100 >= most * share)
                    if same:
                        mask &= own < at_y
                    ii, jj = np.nonzero(mask)
                    for p in range(0, len(ii), step):
                        i, j = ii[p : p + step] + begin, jj[p : p + step]
                        bits = np.bitwise_count(a[i] ^ b[j]).sum(1, dtype=np.int64)
                        i, j = at_x[i], at_y[j]
                        ok = bits * (100 + share) <= (sx[i] + sy[j]) * (100 - share)
                        i, j = i[ok], j[ok]
                        first = hx[i] < hy[j]
                        if len(i):
                            yield np.minimum(hx[i], hy[j]), np.maximum(hx[i], hy[j]), np.where(first, sx[i], sy[j]), np.where(first, sy[j], sx[i])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, same in enumerate(b.column(2).to_pylist()):
                for pairs in possible(members(b.column(0), i), members(b.column(1), i), same):
                    yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in pairs], names=["a", "b", "size_a", "size_b"])

    return run


def _split(groups: DataFrame, known: DataFrame, sets: DataFrame, share: int, family: int) -> DataFrame:
    """The groups cut by their members' signatures of another family; members that share none with another are left out."""
    own = known.join(groups.select("h").distinct(), "h", "left_semi").select("h", _fragments_column(F.col("size")).alias("of"))
    whole = own.join(sets, ["h", "of"]).groupBy("h").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("f", "grams"))), lambda x: x["grams"])).alias("grams"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = Cuts(share)
        for b in batches:
            h, sig = [], []
            for k, s in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                x = signatures(np.asarray(s.values).view(np.uint64), cuts, family).view(np.int64)
                h.append(np.full(len(x), k, np.int64))
                sig.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (h, sig)], names=["h", "sig"])

    signed = scratch.materialize(whole.mapInArrow(lean(sign), "h long, sig long"), "jaccard-family")
    # a signature that no other set has keeps nobody together: gone before the members are joined to theirs
    shared = signed.groupBy("sig").agg(F.min("h").alias("low"), F.max("h").alias("top")).where("low < top").select("sig")
    signed = scratch.materialize(spread(signed, shared, ["sig"]).select("h", "sig"), "jaccard-shared")
    parts = spread(scratch.materialize(groups, "jaccard-hot"), signed, ["h"]).select(F.xxhash64("g", "sig").alias("g"), "h", "size", "k", "c", "out")
    return parts.dropDuplicates(["g", "h"])


def jaccard_components(docs: DataFrame, n: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row; two rows link when their sets' Jaccard is at least share / 100."""
    rows = _classified(docs, n, share, id_col, text_col)
    return rows.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, share: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, all its columns, of each component: its smallest id's (null ids last, then by set).

    Of rows with the same id and set one stays; documents without words always stay.
    """
    found = scratch.materialize(_classified(docs, n, share, id_col, text_col), "jaccard-found")
    twice = scratch.materialize(found.groupBy("doc_id").count().where("count > 1 or doc_id is null").select(F.col("doc_id").alias("_twice")), "jaccard-twice")
    gone = found.where("h is not null and doc_id <> least").select(F.col("doc_id").alias("_gone")).join(twice, F.col("_gone") == F.col("_twice"), "left_anti")
    # the ids to drop are as many as the copies: sent to every task if they are few enough, else the texts are shuffled
    kept = docs.join(small(scratch.materialize(gone.distinct(), "jaccard-gone")), docs[id_col] == F.col("_gone"), "left_anti")
    if not twice.take(1):
        return kept
    again = kept.join(twice, kept[id_col].eqNullSafe(F.col("_twice")), "left_semi")
    rest = kept.join(twice, kept[id_col].eqNullSafe(F.col("_twice")), "left_anti")
    at, schema = docs.columns.index(text_col), T.StructType([*docs.schema.fields, T.StructField("_node", T.LongType())])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            node = pa.array([node_id(s) if len(s) else None for s in _sets(b, at, n)], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, node], names=[*b.schema.names, "_node"])

    marked = again.mapInArrow(lean(mark), schema)
    wordless = marked.where("_node is null").drop("_node")
    stays = found.where("h is not null").select(F.col("least").alias("_id"), F.col("least_h").alias("_h")).distinct()
    chosen = marked.join(stays, marked[id_col].eqNullSafe(F.col("_id")) & (F.col("_node") == F.col("_h")), "left_semi")
    chosen = chosen.withColumn("_n", F.row_number().over(Window.partitionBy(id_col, "_node").orderBy(text_col))).where("_n = 1").drop("_node", "_n")
    return rest.unionByName(chosen).unionByName(wordless)
