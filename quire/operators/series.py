"""Operators over ordered rows: state of model pools, controllers, metrics, merges of chunks, memory.

Runs that a window can express are windows. Folds (controllers, packing) run over one key's ordered array, so a key's
rows must fit a task; their keys (a model, a document, a conversation) bound them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by ``order``: upsert semantics."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(*keys, *(F.col(f"_last.`{c}`").alias(c) for c in rest))


def failure_streaks(df: DataFrame, key: str, order: list[str], failed: Column) -> DataFrame:
    """Every row with ``streak``: failures on end up to and with it; a success resets."""
    w = Window.partitionBy(key).orderBy(*order)
    marked = df.withColumn("_failed", failed.cast("long"))
    island = marked.withColumn("_island", F.sum(1 - F.col("_failed")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return island.withColumn("streak", F.sum("_failed").over(Window.partitionBy(key, "_island").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_failed", "_island")


def _ordered(order: list[str], value: Column) -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_value")))), lambda x: x["_value"])


def smoothed(df: DataFrame, key: str, order: list[str], value: Column, keep: float = 0.7) -> DataFrame:
    """(key, ema): exponential mean of the ordered values; the first one starts it."""
    values = df.groupBy(key).agg(_ordered(order, value.cast("double")).alias("v"))
    return values.select(key, F.aggregate("v", F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x).otherwise(a * keep + x * (1 - keep))).alias("ema"))


def trend(df: DataFrame, key: str, order: list[str], passed: Column, n: int = 5) -> DataFrame:
    """Every row with ``recent``: the share that passed of the last ``n`` rows up to it; null before there are ``n``."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("recent", F.when(F.count(F.lit(1)).over(w) >= n, F.avg(passed.cast("int")).over(w)))


def all_failed(df: DataFrame, key: str, order: list[str], failed: Column, n: int = 3) -> DataFrame:
    """Every row with ``throttle``: whether it and the n - 1 before it failed."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn("throttle", F.sum(failed.cast("int")).over(w) == n)


def pool_state(df: DataFrame, key: str, order: list[str], success: Column, seconds: Column) -> DataFrame:
    """(key, requests, successes, failures, streak, stability, response_time, admitted) after all of a model's requests.

    After every request eviction is tested first (three failures on end, or five requests and a stability under 0.5),
    then admission (three successes, stability 0.7 or under three requests, mean time up to 30 s).
    """
    rows = df.groupBy(key).agg(_ordered(order, F.struct(success.alias("ok"), seconds.cast("double").alias("s"))).alias("v"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("good"), F.lit(0).alias("streak"), F.lit(None).cast("double").alias("rt"), F.lit(False).alias("admitted"))

    def step(a, x):
        ok = x["ok"]
        n, good = a["n"] + 1, a["good"] + ok.cast("int")
        streak = F.when(ok, 0).otherwise(a["streak"] + 1)
        rt = F.when(ok, F.when(a["rt"].isNull(), x["s"]).otherwise(a["rt"] * 0.7 + x["s"] * 0.3)).otherwise(a["rt"])
        stable = good / n
        evict = (streak >= 3) | ((n >= 5) & (stable < 0.5))
        admit = (good >= 3) & ((stable >= 0.7) | (n < 3)) & (F.coalesce(rt, F.lit(0.0)) <= 30)
        return F.struct(n.alias("n"), good.alias("good"), streak.alias("streak"), rt.alias("rt"), F.when(evict, False).when(admit, True).otherwise(a["admitted"]).alias("admitted"))

    s = rows.select(key, F.aggregate("v", start, step).alias("s"))
    return s.select(key, F.col("s.n").alias("requests"), F.col("s.good").alias("successes"), (F.col("s.n") - F.col("s.good")).alias("failures"), F.col("s.streak").alias("streak"), (F.col("s.good") / F.col("s.n")).alias("stability"), F.col("s.rt").alias("response_time"), F.col("s.admitted").alias("admitted"))


def concurrency(df: DataFrame, key: str, order: list[str], limited: Column, start: int = 5, least: int = 1, most: int = 10, down: int = 2, up: int = 10) -> DataFrame:
    """(key, level): a controller that goes one down after ``down`` rate limits and one up after ``up`` successes on end."""
    rows = df.groupBy(key).agg(_ordered(order, limited).alias("v"))
    zero = F.struct(F.lit(start).alias("level"), F.lit(0).alias("bad"), F.lit(0).alias("good"))

    def step(a, x):
        bad, good = F.when(x, a["bad"] + 1).otherwise(0), F.when(x, 0).otherwise(a["good"] + 1)
        lower, higher = bad >= down, good >= up
        level = F.when(lower, F.greatest(a["level"] - 1, F.lit(least))).when(higher, F.least(a["level"] + 1, F.lit(most))).otherwise(a["level"])
        return F.struct(level.alias("level"), F.when(lower, 0).otherwise(bad).alias("bad"), F.when(higher, 0).otherwise(good).alias("good"))

    return rows.select(key, F.aggregate("v", zero, step)["level"].alias("level"))


def histogram(df: DataFrame, keys: list[str], value: Column, bounds: list[float]) -> DataFrame:
    """(keys, le, n): cumulative counts under each bound, the last one infinite."""
    counts = df.groupBy(*keys).agg(F.count(value).alias("_all"), *(F.count_if(value <= b).alias(f"_{i}") for i, b in enumerate(bounds)))
    cells = F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"_{i}").alias("n")) for i, b in enumerate(bounds)), F.struct(F.lit(float("inf")).alias("le"), F.col("_all").alias("n")))
    return counts.select(*keys, F.inline(cells))


def offsets(df: DataFrame, key: str, order: list[str], length: Column) -> DataFrame:
    """Every row with ``start`` and ``end`` in the key's concatenated text."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("end", F.sum(length).over(w)).withColumn("start", F.col("end") - length)


def merge_short(df: DataFrame, key: str, order: list[str], length: Column, least: int) -> DataFrame:
    """Every row with ``part``: rows shorter than ``least`` belong to the part before, except the first."""
    w = Window.partitionBy(key).orderBy(*order)
    opens = ((length >= least) | (F.row_number().over(w) == 1)).cast("int")
    return df.withColumn("_opens", opens).withColumn("part", F.sum("_opens").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_opens")


def pack(df: DataFrame, key: str, order: list[str], length: Column, most: int, least: int = 0) -> DataFrame:
    """(key, part, first, n, total): rows in order put into parts; one closes when the next would bring it over ``most``
    and it has at least ``least`` already. A single longer row is a part of its own."""
    rows = df.groupBy(key).agg(_ordered(order, length.cast("long")).alias("v"))
    part = "struct<first:bigint,n:bigint,total:bigint>"
    start = F.struct(F.array().cast(f"array<{part}>").alias("done"), F.lit(None).cast(part).alias("open"), F.lit(0).cast("long").alias("i"))

    def cell(first, n, total):
        return F.struct(first.cast("long").alias("first"), n.cast("long").alias("n"), total.cast("long").alias("total"))

    def step(a, x):
        o = a["open"]
        close = o.isNotNull() & (o["total"] >= least) & (o["total"] + x > most)
        fresh = cell(a["i"], F.lit(1), x)
        return F.struct(F.when(close, F.concat(a["done"], F.array(o))).otherwise(a["done"]).alias("done"), F.when(close | o.isNull(), fresh).otherwise(cell(o["first"], o["n"] + 1, o["total"] + x)).alias("open"), (a["i"] + 1).alias("i"))

    folded = rows.select(key, F.aggregate("v", start, step, lambda a: F.when(a["open"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["open"])))).alias("parts"))
    return folded.select(key, F.posexplode("parts")).select(key, F.col("pos").alias("part"), "col.*")


def context(df: DataFrame, key: str, order: list[Column], length: Column, most: int) -> DataFrame:
    """Rows in ``order`` up to the first that would bring a key over ``most``: the rest stops there, it is not skipped."""
    w = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn("used", F.sum(length).over(w)).where(F.col("used") <= most)


def remember(df: DataFrame, key: str, order: list[str], content: Column, importance: Column, chars: int = 4000, items: int = 50) -> DataFrame:
    """(key, position, content, importance): a short-term memory after all rows; over either limit the least important
    item goes, the earliest of equals."""
    rows = df.groupBy(key).agg(_ordered(order, F.struct(importance.cast("double").alias("importance"), F.coalesce(content, F.lit("")).alias("content"))).alias("v"))
    item = "struct<importance:double,position:bigint,content:string>"

    def size(m):
        return F.aggregate(m, F.lit(0), lambda n, x: n + F.length(x["content"]))

    def evict(m, _):
        worst = F.array_min(F.transform(m, lambda x: F.struct(x["importance"], x["position"])))
        return F.when((size(m) > chars) | (F.size(m) > items), F.filter(m, lambda x: x["position"] != worst["position"])).otherwise(m)

    def step(a, x):
        grown = F.concat(a["m"], F.array(F.struct(x["importance"].alias("importance"), a["i"].alias("position"), x["content"].alias("content"))))
        kept = F.aggregate(F.sequence(F.lit(0), F.size(grown)), grown, evict)
        return F.struct(kept.alias("m"), (a["i"] + 1).alias("i"))

    state = F.aggregate("v", F.struct(F.array().cast(f"array<{item}>").alias("m"), F.lit(0).cast("long").alias("i")), step, lambda a: a["m"])
    return rows.select(key, F.inline(state)).select(key, "position", "content", "importance")
