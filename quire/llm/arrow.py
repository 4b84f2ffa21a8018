"""Small helpers around ``mapInArrow`` used by the operators."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import scratch

Rows = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Rows up to which a checked side may be broadcast (about 24 bytes a row); beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


@functools.cache
def _trim():
    """The C library's call that gives freed memory back, where there is one."""
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


#: What empties the caches that modules keep in a worker for tasks of their own kind.
CACHES: list[Callable[[], None]] = []


def lean(rows: Rows, caches: bool = False) -> Rows:
    """``rows``, after whose end a worker, which later tasks go on using, gives back the memory it no longer needs.

    Caches that earlier tasks have left are emptied first, unless ``caches`` says that the rows are made with them.
    """

    @functools.wraps(rows)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for empty in () if caches else CACHES:
                empty()
            yield from rows(batches)
        finally:
            pa.default_memory_pool().release_unused()
            _trim()(0)

    return run


def batch(columns: dict[str, object], schema: pa.Schema) -> pa.RecordBatch:
    """A record batch in the order of ``schema``."""
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """``df`` marked for broadcast if its counted rows are within the bound, else as it is."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df


#: Keys that :func:`spread` splits at most; a key is hot if it has more than this share of the rows, and at least HOT_ROWS.
HOT_KEYS, HOT_ROWS = 4096, 300


def spread(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", hot_key: str | None = None) -> DataFrame:
    """``left`` joined to ``right`` on the columns ``on``, a hot key's rows of ``left`` dealt to several tasks.

    Keys with more than 1 / HOT_KEYS of the rows are counted first (at most HOT_KEYS of them, broadcast); their rows of
    ``left`` get a salt each, and ``right`` has its rows of such keys once for every salt. ``left`` should be a written table.
    """
    key = hot_key or on[0]
    counts = left.groupBy(key).agg(F.count(F.lit(1)).alias("_c"))
    most = max(HOT_ROWS, left.count() // HOT_KEYS)
    hot = counts.where(F.col("_c") > most).select(F.col(key).alias("_k"), F.ceil(F.col("_c") / most).cast("int").alias("_n"))
    hot = scratch.materialize(hot, "hot-keys")
    if not hot.take(1):
        return left.join(right, on, how)
    salted = left.join(F.broadcast(hot), left[key].eqNullSafe(F.col("_k")), "left")
    salted = salted.withColumn("_salt", F.when(F.col("_n").isNull(), F.lit(0)).otherwise(F.pmod(F.monotonically_increasing_id(), F.col("_n")).cast("int"))).drop("_k", "_n")
    copies = right.join(F.broadcast(hot), right[key].eqNullSafe(F.col("_k")), "left")
    copies = copies.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_n", F.lit(1)) - 1))).drop("_k", "_n")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def partition_id() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId()


def running_total(df: DataFrame, order: list, value: str, group: str | None = None, name: str = "running") -> DataFrame:
    """Inclusive running total of long column ``value`` over the global ``order``, restarted for each ``group``.

    Range partitions are summed on their own, their sums are added up over the few (partition, group) pairs, and each
    row adds its partition's offset: no task holds a whole group. ``order`` must begin with the group. Rows that tie in
    the order get their totals in some order; give a total order where that matters. Adds column ``running``.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    out_schema = T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_local", T.LongType())])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, carry, first = partition_id(), None, 0, True
        for b in batches:
            if not b.num_rows:
                continue
            v = np.asarray(b.column(b.schema.get_field_index(value)).fill_null(0)).astype(np.int64)
            total = np.cumsum(v)
            if group is None:
                total += carry
                carry = int(total[-1])
            else:
                g = b.column(b.schema.get_field_index(group)).to_pylist()
                new = np.array([first or g[0] != last] + [x != y for x, y in zip(g[1:], g[:-1], strict=True)])
                at = np.flatnonzero(new)
                base = np.zeros(len(v), np.int64)
                base[at] = total[at] - v[at]
                base = np.maximum.accumulate(base)
                total = total - base + np.where(np.cumsum(new) == 0, carry, 0)
                carry, last = int(total[-1]), g[-1]
            first = False
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(len(v), part, np.int32)), pa.array(total)], names=[*b.schema.names, "_part", "_local"])

    rows = scratch.materialize(ranged.mapInArrow(lean(local), out_schema), name)
    by = [group] if group else []
    sums = rows.groupBy("_part", *by).agg(F.sum(value).alias("_sum"))
    w = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.withColumn("_offset", F.coalesce(F.sum("_sum").over(w), F.lit(0).cast("long"))).drop("_sum")
    offsets = small(scratch.materialize(offsets, f"{name}-offsets"))
    on = rows["_part"] == offsets["_part"]
    if group:
        on &= rows[group].eqNullSafe(offsets[group])
    return rows.join(offsets, on, "left").select(*[rows[c] for c in df.columns], (rows["_local"] + F.coalesce(offsets["_offset"], F.lit(0))).alias("running"))
