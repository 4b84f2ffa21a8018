"""Interval overlap join by overlap interval partitioning, and sessions of events.

Right intervals are grouped by a logarithmic length class and by the granule of slots they start in; granules of class k are
``width * 2**k`` slots wide. A left interval meets only granules that exist under its key and whose intervals could reach
it, through an equi-join on (key, class, granule), and each pair that meets is then verified. An open interval never ends:
it forms a class of its own. Equal intervals of a key are joined once and counted, so a key with a third of all rows costs
as many rows as it has different intervals of slots, which the calendar bounds and the input does not. All joins shuffle: no
side has a bound.

Defined cases: rows with a null key or start take no part; an end before the start counts as the start; an open flag that
is null counts as not open; repeated rows are rows like any other; empty tables give an empty result; columns that are not
named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slots of a granule of class 0: fewer make a left interval probe more granules, more let it meet more that do not overlap.
WIDTH = 28
#: Class of open intervals.
OPEN = -1

#: Allen relation of the left interval to the right by (left starts, left ends): earlier, equally or later. Fixed values.
RELATIONS = {-1: ("overlaps", "finished_by", "contains"), 0: ("starts", "equals", "started_by"), 1: ("during", "finishes", "overlapped_by")}


def micros(ts: Column) -> Column:
    """Whole microseconds from 1970 to a time as the clock shows it, whatever the session's zone."""
    clock = F.hour(ts) * 3600 + F.minute(ts) * 60
    return (F.unix_date(ts.cast("date")).cast("long") * 86_400 + clock) * 1_000_000 + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")


def _div(c: Column, by: Column) -> Column:
    """Whole division that rounds down, exact for whole numbers."""
    return ((c - F.pmod(c, by)) / by).cast("long")


def _power(k: Column) -> Column:
    """2 to a class; 1 for the class of open intervals."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(k, F.lit(0)))


def sessions(events: DataFrame, key: str, at: str, last: str, gap: int) -> DataFrame:
    """(key, first, until, last): runs of an integer time ``at`` no more than ``gap`` apart; ``last`` holds if it does for an event at ``until``.

    Times of one bucket as wide as the gap never part, so events are first reduced to a row for each key and bucket that has
    some; only these rows, which the calendar bounds, are put in order for each key.
    """
    ends = F.max(F.struct(F.col(at).alias("at"), F.coalesce(F.col(last), F.lit(False)).alias("last")))
    buckets = events.where(F.col(key).isNotNull() & F.col(at).isNotNull()).groupBy(F.col(key).alias("key"), _div(F.col(at), F.lit(gap)).alias("bucket")).agg(F.min(at).alias("first"), ends.alias("end"))
    order = Window.partitionBy("key").orderBy("bucket")
    begins = F.col("first") - F.lag(F.col("end.at")).over(order) > gap
    run = F.sum(F.coalesce(begins, F.lit(True)).cast("int")).over(order)
    return buckets.withColumn("begins", begins).withColumn("run", run).groupBy("key", "run").agg(F.min("first").alias("first"), F.max("end").alias("end")).select("key", "first", F.col("end.at").alias("until"), F.col("end.last").alias("last"))


def slotted(df: DataFrame, key: str, start: str, end: str, is_open: str, slot: int) -> DataFrame:
    """``df`` with columns key, s, e of whole slots, both inclusive; e is null for an open interval. Rows without key or start are left out."""
    e = F.when(~F.coalesce(F.col(is_open), F.lit(False)), _div(F.greatest(start, end), F.lit(slot)))
    return df.where(F.col(key).isNotNull() & F.col(start).isNotNull()).withColumns({"key": F.col(key), "s": _div(F.col(start), F.lit(slot)), "e": e})


def relation(s: Column, e: Column, s2: Column, e2: Column) -> Column:
    """Relation of the interval (s, e) to (s2, e2); a null end is infinite."""
    ends = F.when(e.isNull() & e2.isNull(), 0).when(e.isNull(), 1).when(e2.isNull(), -1).otherwise(F.signum(e - e2))
    starts = F.signum(s - s2)
    out = F.lit(None).cast("string")
    for a, names in RELATIONS.items():
        for b, name in zip((-1, 0, 1), names, strict=True):
            out = F.when((starts == a) & (ends == b), name).otherwise(out)
    return out


def _classed(right: DataFrame, width: int) -> DataFrame:
    """Columns class, granule: floor(log2(slots)), and the granule of that class that the interval starts in."""
    # whole numbers have exact logarithms to base 2 only where they are powers, so the binary digits are counted
    kind = F.when(F.col("e").isNull(), OPEN).otherwise(F.length(F.bin(F.col("e") - F.col("s") + 1)) - 1)
    return right.withColumn("class", kind).withColumn("granule", _div(F.col("s"), width * _power(F.col("class"))))


def overlapping(left: DataFrame, right: DataFrame, width: int = WIDTH) -> DataFrame:
    """Pairs of different intervals (key, s, e) of ``left`` and of ``right`` that share a slot.

    Both have columns key, s, e (:func:`slotted`), each (key, s, e) once; further columns of ``right`` are carried along.
    Adds s2, e2, relation and shared (slots in common, null if both are open).
    """
    classed = _classed(right, width)
    index = classed.groupBy("key").agg(F.collect_set(F.struct("class", "granule")).alias("granules"))

    def reachable(g: Column) -> Column:
        wide = _power(g["class"])
        begins, until = g["granule"] * wide * width, (g["granule"] + 1) * wide * width + 2 * wide - 3
        return (F.col("e").isNull() | (begins <= F.col("e"))) & ((g["class"] == OPEN) | (until >= F.col("s")))

    probes = left.select("key", "s", "e").join(index.hint("merge"), "key").select("key", "s", "e", F.explode(F.filter("granules", reachable)).alias("g")).select("key", "s", "e", "g.class", "g.granule")
    met = probes.join(classed.withColumnsRenamed({"s": "s2", "e": "e2"}).hint("merge"), ["key", "class", "granule"])
    met = met.where((F.col("e").isNull() | (F.col("s2") <= F.col("e"))) & (F.col("e2").isNull() | (F.col("s") <= F.col("e2"))))
    s, e, s2, e2 = map(F.col, ("s", "e", "s2", "e2"))
    shared = F.when(e.isNotNull() | e2.isNotNull(), F.least(e, e2) - F.greatest(s, s2) + 1)  # least passes over nulls
    return met.drop("class", "granule").withColumns({"relation": relation(s, e, s2, e2), "shared": shared})


def relations(left: DataFrame, right: DataFrame, id_col: str, weight: str, width: int = WIDTH) -> DataFrame:
    """For each row of ``left`` and relation: n_pairs, overlap_slots (shared slots, summed; null if both are open) and the sum of ``weight``.

    Both have columns key, s, e (:func:`slotted`). Each row of ``left`` is an interval of its own, also under a repeated id.
    """
    counted = right.groupBy("key", "s", "e").agg(F.count(F.lit(1)).alias("n"), F.sum(weight).alias("w"))
    pairs = overlapping(left.select("key", "s", "e").distinct(), counted, width)
    sums = pairs.groupBy("key", "s", "e", "relation").agg(F.sum("n").alias("n_pairs"), F.sum(F.col("n") * F.col("shared")).alias("overlap_slots"), F.sum("w").alias("weight"))
    # an equi-join on a null end: open intervals get an end that no slot has
    ended = F.coalesce("e", F.lit(-(2**62)).cast("long")).alias("e")
    rows = left.select(F.col(id_col).alias("id"), "key", "s", ended)
    return rows.join(sums.select("key", "s", ended, "relation", "n_pairs", "overlap_slots", "weight").hint("merge"), ["key", "s", "e"]).select(F.col("id").alias(id_col), "relation", "n_pairs", "overlap_slots", "weight")


def session_relations(sales: DataFrame, lines: DataFrame, clicks: DataFrame, gap: int = 15 * 60 * 1_000_000, slot: int = 6 * 3600 * 1_000_000) -> DataFrame:
    """sale_id, relation, n_pairs, overlap_slots, sessions_crc: sales against the click sessions of their clients."""
    seen = clicks.select("client_id", micros(F.col("ts")).alias("at"), (F.col("kind") == "error").alias("error"))
    runs = sessions(seen, "client_id", "at", "error", gap)
    right = slotted(runs.withColumn("crc", F.crc32(F.col("first").cast("string").cast("binary"))), "key", "first", "until", "last", slot)
    shipped = lines.where(F.col("sale_id").isNotNull()).groupBy("sale_id").agg(F.max(micros(F.col("shipped_at"))).alias("shipped"))
    sold = sales.select("sale_id", "client_id", micros(F.col("sold_at")).alias("sold"), (F.col("status") == "open").alias("open"))
    left = slotted(sold.where(F.col("client_id").isNotNull() & F.col("sold").isNotNull()).join(shipped.hint("merge"), "sale_id", "left"), "client_id", "sold", "shipped", "open", slot)
    return relations(left.select("sale_id", "key", "s", "e"), right.select("key", "s", "e", "crc"), "sale_id", "crc").withColumnRenamed("weight", "sessions_crc")


#: The same, plainly: each client's sales against all its sessions. crc32 is built from its polynomial.
SESSION_RELATIONS_SQL = """
WITH RECURSIVE bits(i, k, v) AS (
  SELECT i, 0, i FROM range(256) t(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bits WHERE k < 8
), crc_table AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8
), stepped AS (
  SELECT client_id, ts, coalesce(kind = 'error', false) AS error,
         CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY client_id ORDER BY ts) <= 900000000 THEN 0 ELSE 1 END AS begins
  FROM clicks WHERE client_id IS NOT NULL AND ts IS NOT NULL
), numbered AS (
  SELECT *, sum(begins) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM stepped
), ended AS (
  SELECT *, max(ts) OVER (PARTITION BY client_id, run) AS until FROM numbered
), sessions AS (
  SELECT client_id, epoch_us(min(ts)) AS first, epoch_us(max(ts)) AS until, bool_or(error AND ts = until) AS open
  FROM ended GROUP BY client_id, run
), right_side AS (
  SELECT client_id, first // 21600000000 AS s2, CASE WHEN open THEN NULL ELSE until // 21600000000 END AS e2,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(first AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
           lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc
  FROM sessions, crc_table
), left_side AS (
  SELECT sale_id, client_id, epoch_us(sold_at) // 21600000000 AS s,
         CASE WHEN status = 'open' THEN NULL ELSE greatest(epoch_us(sold_at), coalesce(epoch_us(shipped), epoch_us(sold_at))) // 21600000000 END AS e
  FROM sales LEFT JOIN (SELECT sale_id, max(shipped_at) AS shipped FROM sale_lines GROUP BY sale_id) USING (sale_id)
  WHERE client_id IS NOT NULL AND sold_at IS NOT NULL
), pairs AS (
  SELECT sale_id, s, e, s2, e2, crc,
         CASE WHEN e IS NULL AND e2 IS NULL THEN 0 WHEN e IS NULL THEN 1 WHEN e2 IS NULL THEN -1 ELSE sign(e - e2) END AS ends
  FROM left_side JOIN right_side USING (client_id)
  WHERE (e IS NULL OR s2 <= e) AND (e2 IS NULL OR s <= e2)
)
SELECT sale_id,
       CASE WHEN s < s2 THEN CASE ends WHEN -1 THEN 'overlaps' WHEN 0 THEN 'finished_by' ELSE 'contains' END
            WHEN s = s2 THEN CASE ends WHEN -1 THEN 'starts' WHEN 0 THEN 'equals' ELSE 'started_by' END
            ELSE CASE ends WHEN -1 THEN 'during' WHEN 0 THEN 'finishes' ELSE 'overlapped_by' END END AS relation,
       count(*) AS n_pairs,
       CAST(sum(CASE WHEN e IS NULL AND e2 IS NULL THEN NULL
                     ELSE least(coalesce(e, e2), coalesce(e2, e)) - greatest(s, s2) + 1 END) AS BIGINT) AS overlap_slots,
       CAST(sum(crc) AS BIGINT) AS sessions_crc
FROM pairs GROUP BY 1, 2
"""
