"""Linking mentions of known entities in texts, and merging graphs whose nodes go by several names.

A name can occur in a text only where the name's first characters do, so places of texts meet names by an equi-join on those, and
only the places that it finds are compared. No name or text is sent to every task but where Spark itself measures a table as small.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import scratch

#: Characters of a name that texts are looked up by; shorter names by all they have.
GRAM = 5


#: Slots that the first characters of names are hashed to; a text's places whose slot has no name go at once.
SLOTS = 1 << 18

#: Multiplier of the rolling hash.
_M = np.uint32(2654435761)


def _fold_table() -> dict[int, int]:
    """Code points that have another one in the place of all those equal to them without regard to case."""
    out = {}
    for c in map(chr, range(0x110000)):
        up = c.upper()
        up = up if len(up) == 1 else c
        low = up.lower()
        low = low if len(low) == 1 else "i" if up == "İ" else up
        if low != c:
            out[ord(c)] = ord(low)
    return out


@functools.cache
def _folds() -> dict[int, int]:
    return _fold_table()


def _fold(text: str) -> str:
    """A text so that letters equal without regard to case are equal; every character stays one character."""
    return text.lower() if text.isascii() else text.translate(_folds())


def _slots(text: str, n: int) -> np.ndarray:
    """The slot of each run of ``n`` characters of a folded text."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    runs = len(codes) - n + 1
    if runs < 1:
        return np.zeros(0, np.uint32)
    h = np.full(runs, n, np.uint32)
    for j in range(n):
        h = h * _M + codes[j : j + runs]
        h ^= h >> np.uint32(15)
    return (h * _M) >> np.uint32(14)


def mentions(docs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, name, mention, start, end): where the names (name) occur in docs (doc_id, text), without regard to case.

    Occurrences of one name do not overlap: the leftmost is taken, then the next one after its end. Those of different
    names may. Places count characters, the end is exclusive. Defined cases: null and empty texts have no mentions, null
    and empty names have none, a name given several times counts once, repeated documents are rows of their own.

    A place of a text becomes a row only if the characters there hash to a slot in which a name begins, with as many
    characters as the longest such name has. These rows meet the names by the first characters and are compared whole.
    """
    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = [_fold(x) for x in b.column(0).to_pylist()]
            grams = [k[:GRAM] for k in keys]
            slots = [int(_slots(g, len(g))[0]) for g in grams]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.string()), pa.array(grams, pa.string()), pa.array(slots, pa.int32()), pa.array([len(g) for g in grams], pa.int32()), pa.array([len(k) for k in keys], pa.int32())], names=["name", "k", "gram", "slot", "n", "length"])

    known = names.where("name is not null and name <> ''").select("name").distinct()
    known = scratch.materialize(known.mapInArrow(folded, "name string, k string, gram string, slot int, n int, length int"), "names")
    # at most SLOTS numbers for each of at most GRAM lengths, however many names there are
    longest: dict[int, np.ndarray] = {}
    for r in known.groupBy("n", "slot").agg(F.max("length").alias("length")).collect():
        longest.setdefault(r.n, np.zeros(SLOTS, np.int32))[r.slot] = r.length
    doc_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("doc_id", doc_type), *(T.StructField(c, t) for c, t in (("row", T.LongType()), ("start", T.IntegerType()), ("gram", T.StringType()), ("folded", T.StringType()), ("plain", T.StringType())))])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, size = [], 0
            for i, text in enumerate(b.column(2).to_pylist()):
                low = _fold(text)
                for n, lengths in longest.items():
                    slots = lengths[_slots(low, n)]
                    for at in np.flatnonzero(slots).tolist():
                        found.append((i, at, low[at : at + n], low[at : at + slots[at]], text[at : at + slots[at]]))
                        size += int(slots[at])
                    if size > 8_000_000:
                        yield rows(b, found)
                        found, size = [], 0
            if found:
                yield rows(b, found)

    def rows(b: pa.RecordBatch, found: list) -> pa.RecordBatch:
        i, at, gram, low, plain = map(list, zip(*found, strict=True))
        of = pa.array(i, pa.int64())
        return pa.RecordBatch.from_arrays([b.column(0).take(of), b.column(1).take(of), pa.array(at, pa.int32()), pa.array(gram, pa.string()), pa.array(low, pa.string()), pa.array(plain, pa.string())], names=schema.names)

    texts = docs.where("doc_id is not null and text <> ''").select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    begun = texts.mapInArrow(places, schema)
    met = begun.join(known.select("gram", "name", "k", "length"), "gram").where(F.substring("folded", F.lit(1), F.col("length")) == F.col("k"))
    hits = met.select("doc_id", "row", "name", "length", "start", F.substring("plain", F.lit(1), F.col("length")).alias("mention"))
    listed = hits.groupBy("doc_id", "row", "name", "length").agg(F.array_sort(F.collect_list(F.struct("start", "mention"))).alias("hits"))
    # a mention counts if it begins after the last one that counts has ended
    begin = F.struct(F.lit(0).alias("free"), F.array().cast("array<struct<start:int,mention:string>>").alias("kept"))
    step = lambda s, h: F.when(h["start"] >= s["free"], F.struct((h["start"] + F.col("length")).alias("free"), F.concat(s["kept"], F.array(h)).alias("kept"))).otherwise(s)
    near = F.exists(F.sequence(F.lit(1), F.size("hits") - 1), lambda i: F.get("hits", i)["start"] < F.get("hits", i - 1)["start"] + F.col("length"))
    kept = F.when((F.size("hits") > 1) & near, F.aggregate("hits", begin, step, lambda s: s["kept"])).otherwise(F.col("hits"))
    return listed.select("doc_id", "name", "length", F.explode(kept).alias("h")).select("doc_id", "name", "h.mention", "h.start", (F.col("h.start") + F.col("length")).alias("end"))


def alias_classes(pairs: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node of the alias pairs with the smallest node that its chain of aliases reaches, itself included.

    Labels spread along the pairs and are replaced by their labels' labels, so that a chain of n takes about log n rounds;
    it ends when a round lowers none. Each round is a minimum per node over a table no larger than the pairs, written to the shared folder.
    Null ends make no pair; a node paired with itself is its own class. An empty table gives an empty result.
    """
    both = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select(F.explode(F.array(F.struct(F.col(a).alias("node"), F.col(b).alias("other")), F.struct(F.col(b).alias("node"), F.col(a).alias("other"))))).select("col.*").distinct()
    both = scratch.materialize(both, "aliases")
    labels = scratch.materialize(both.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("root")), "alias-labels")
    while True:
        of = labels.select(F.col("node").alias("other"), F.col("root").alias("near"))
        least = both.join(of, "other").groupBy("node").agg(F.min("near").alias("near"))
        lower = labels.join(least, "node").select("node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        # a node's old root takes the lowest label that any of its nodes has found, so a class moves as one
        moved = lower.groupBy("was").agg(F.min("root").alias("best"))
        stepped = lower.join(moved, "was").select("node", "was", F.least("root", "best").alias("root"))
        jump = stepped.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new = scratch.materialize(stepped.join(jump, "root", "left").select("node", F.least("root", F.coalesce("next", "root")).alias("root"), "was"), "alias-labels")
        changed = new.where("root <> was").limit(1).count()
        scratch.drop(labels)
        labels = new.select("node", "root")
        labels._quire_path = new._quire_path
        if not changed:
            return labels


def merged(nodes: DataFrame, edges: DataFrame, aliases: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes and edges of several graphs made one: nodes that are aliases of each other become one.

    ``nodes`` (node, source, kind), ``edges`` (u, v, source, weight), ``aliases`` (a, b). Merged nodes: node (the smallest of its
    names), kind (the most frequent, ties to the smaller; null if none has one), n_names, sources. Merged edges: u, v, weight
    (summed), n_edges, sources. Edges are directed; those within a node stay as loops, as they are evidence too. Sources are sorted and
    distinct: a node's sources are bounded by the number of graphs. Ends that are no node are merged all the same; null ends and null nodes go.
    """
    root = alias_classes(aliases)

    def named(df: DataFrame, column: str) -> DataFrame:
        own = df.where(F.col(column).isNotNull())
        return own.join(root.select(F.col("node").alias(column), F.col("root").alias("_root")), column, "left").withColumn(column + "_to", F.coalesce("_root", column)).drop("_root")

    # counted by what is merged before it meets: a node's rows may be a large part of all
    rows = named(nodes.groupBy("node", "source", "kind").agg(F.count(F.lit(1)).alias("n")), "node")
    votes = rows.where("kind is not null").groupBy("node_to", "kind").agg(F.sum("n").alias("n")).groupBy("node_to").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("kind"))
    names = rows.groupBy("node_to").agg(F.count_distinct("node").alias("n_names"), F.array_sort(F.collect_set("source")).alias("sources"))
    out_nodes = names.join(votes, "node_to", "left").select(F.col("node_to").alias("node"), "kind", "n_names", "sources")
    sums = edges.groupBy("u", "v", "source").agg(F.sum("weight").alias("weight"), F.count(F.lit(1)).alias("n_edges"))
    ends = named(named(sums, "u"), "v")
    out_edges = ends.groupBy(F.col("u_to").alias("u"), F.col("v_to").alias("v")).agg(F.sum("weight").alias("weight"), F.sum("n_edges").alias("n_edges"), F.array_sort(F.collect_set("source")).alias("sources"))
    return out_nodes, out_edges
