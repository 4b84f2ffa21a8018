"""Mixing sources to target weights by weighted fair queueing.

Every document of a source is queued in a shuffled order that depends on its content alone, up to ``epochs`` times over.
A copy's virtual finish time is the source's tokens up to and with it, divided by the source's weight. All copies are
range-sorted by finish time and the prefix within the total budget is taken; a source that runs out leaves its share to
the others by weight, so each gets the water-filled target.

Defined cases: null text has size 0; null source is a source of its own, last in order; fully identical rows share one
decision; documents of size 0 are taken, with size 0, where the queue is taken as far as their place; an empty table gives
an empty result; rows tie by finish time, then source, epoch and shuffle key.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import scratch
from quire.llm import kernels
from quire.llm.arrow import lean, running_total, small

#: Weights by the source's place in code point order, repeating.
WEIGHTS = (1, 2, 3)


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, sig (hash of id, source and text), size in words: one narrow pass over the whole texts."""
    base = docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), F.xxhash64(docs[id_col], docs[source_col], docs[text_col]).alias("sig"), docs[text_col].alias("text"))
    out = T.StructType([*base.drop("text").schema.fields, T.StructField("size", T.LongType())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = kernels.strings(b.column(3))
            n = np.concatenate([np.zeros(0, np.int64), *(kernels.words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], hashes=False)[1] for i, j in kernels.slices(offsets))])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(n.astype(np.int64))], names=["doc_id", "source", "sig", "size"])

    return base.mapInArrow(lean(count), out)


def targets(sizes: DataFrame, epochs: int, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, rank, weight, source_size, total and target of each source, by water-filling in one sorted pass.

    One row a source, so the windows over all sources stay small however many documents there are.
    """
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    everything = Window.orderBy(F.col("source").isNull(), "source")
    s = s.withColumn("rank", F.row_number().over(everything).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") - 1) % len(weights) + 1).cast("int")).cast("double"))
    whole = Window.partitionBy()
    s = s.withColumn("total", F.sum("source_size").over(whole)).withColumn("full_at", epochs * F.col("source_size") / F.col("weight"))
    ahead = Window.orderBy("full_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.orderBy("full_at", "rank").rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - epochs * F.coalesce(F.sum("source_size").over(ahead), F.lit(0))) / F.sum("weight").over(behind)
    s = s.withColumn("level", level)
    # the first source, by the time it is used up, that is not used up at its own level fixes the level of all
    s = s.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "rank", "level"))).over(whole)["level"])
    return s.select("source", "rank", "weight", "source_size", "total", F.least(F.lit(float(epochs)) * F.col("source_size"), F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row for each distinct (doc_id, source, text): sig, m (such rows), size, source_size, target, copies (0 to ``epochs``)."""
    base = scratch.materialize(sized(docs, id_col, text_col, source_col).groupBy("doc_id", "source", "sig", "size").agg(F.count(F.lit(1)).alias("m")), "mix-sizes")
    sources = small(scratch.materialize(targets(base, epochs), "mix-targets"))
    queue = base.join(sources.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(
        "doc_id", "sig", "size", "m", "rank", "weight", "source_size", "total", "target", F.xxhash64(F.lit(seed), "sig").alias("key"), (F.col("size") * F.col("m")).alias("amount")
    )
    queued = running_total(queue, ["rank", "key", "doc_id", "sig"], "amount", "rank", "mix-queue")
    copies = queued.select("*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")).withColumn("finish", (F.col("epoch") * F.col("source_size") + F.col("running")) / F.col("weight")).drop("running")
    taken = running_total(copies, ["finish", "rank", "epoch", "key", "doc_id", "sig"], "amount", None, "mix-taken")
    return taken.groupBy("doc_id", "sig", "size", "m", "source_size", "target").agg(F.sum((F.col("running") <= F.col("total")).cast("int")).cast("int").alias("copies"))


def mixed(docs: DataFrame, epochs: int = 3, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows the mix takes, all their columns, each as often as it is taken."""
    copies = mix(docs, epochs, seed, id_col, text_col, source_col).where("copies > 0").select(F.col("doc_id").alias("_id"), F.col("sig").alias("_sig"), F.col("copies").alias("_copies"))
    # 20 bytes a kept document: sent to every task if they are few enough, else the texts are shuffled
    copies = small(scratch.materialize(copies, "mix-copies"))
    sig = F.xxhash64(docs[id_col], docs[source_col], docs[text_col])
    return docs.join(copies, (sig == F.col("_sig")) & docs[id_col].eqNullSafe(F.col("_id"))).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*[docs[c] for c in docs.columns])
