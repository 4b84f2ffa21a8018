"""Choosing and listing: model pools, API sources, extraction engines, work that is left, samples, and roll-ups of verdicts.

Defined cases, unless a function says otherwise: null sort keys come last; ties go to the smaller id; repeated rows are rows
like any other; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import scratch
from quire.functions import rules

_POOL = ("priority", "stability", "response_time")


def pool_order(models: DataFrame, id_col: str = "model_id") -> DataFrame:
    """The models (``in_pool``, priority, stability, response_time) of the pool with their ``place``: priority, most stable, fastest.

    The models are few (a pool's configuration), so one ordered window over all of them is small.
    """
    order = Window.orderBy(F.asc_nulls_last("priority"), F.desc_nulls_last("stability"), F.asc_nulls_last("response_time"), id_col)
    return models.where("in_pool").withColumn("place", F.row_number().over(order))


def usable(models: DataFrame, id_col: str = "model_id", most: int = 5) -> DataFrame:
    """The pool in order; where it is empty, the ``most`` best of the available models by priority, then stability."""
    pool = pool_order(models, id_col)
    order = [F.asc_nulls_last("priority"), F.desc_nulls_last("stability"), F.col(id_col)]
    rest = models.where("available").orderBy(*order).limit(most).withColumn("place", F.row_number().over(Window.orderBy(*order)))
    none = models.agg(F.coalesce(F.bool_or("in_pool"), F.lit(False)).alias("_any")).where("not _any")
    return pool.unionByName(rest.join(F.broadcast(none), how="left_semi", on=F.lit(True)))


def fallback(models: DataFrame, group: str, id_col: str = "model_id") -> DataFrame:
    """(group, fallback): the most stable model that is free and available, of every group that has one."""
    able = models.where("free and available")
    return able.groupBy(group).agg(F.min_by(id_col, F.struct(F.col("stability").isNull(), -F.col("stability"), F.col(id_col))).alias("fallback"))


def next_source(sources: DataFrame, group: str, id_col: str = "source_id") -> DataFrame:
    """(group, source): the first source by priority that is not exhausted; an exhausted shared source takes all shared ones along."""
    spent = F.bool_or(F.col("exhausted") & F.col("shared")).over(Window.partitionBy(group))
    left = sources.withColumn("_spent", F.coalesce(spent, F.lit(False))).where(~F.coalesce("exhausted", F.lit(False)) & ~(F.col("_spent") & F.coalesce("shared", F.lit(False))))
    return left.groupBy(group).agg(F.min_by(id_col, F.struct(F.col("priority").isNull(), "priority", id_col)).alias("source"))


def engines(tasks: DataFrame, key: str) -> DataFrame:
    """(key, engine, runner_up, quality, speed) for tasks (key, content_length, discipline, kb_concepts, extraction_type, complex).

    Engines whose range holds the length are scored by discipline, complex relations and known concepts; ties keep the
    engines' order. Hypergraph tasks, and lengths that no engine takes, have fixed answers. Keys are taken as unique.
    """
    spark = tasks.sparkSession
    rows = [(n, name, low, high, quality, speed, best) for n, (name, low, high, quality, speed, best, hyper) in enumerate(rules.ENGINES) if not hyper]
    known = spark.createDataFrame(rows, "place int, engine string, low long, high long, quality string, speed string, best array<string>")
    fits = (F.col("content_length") >= F.col("low")) & (F.col("high").isNull() | (F.col("content_length") <= F.col("high")))
    excellent = F.col("quality") == "excellent"
    kb = F.coalesce("kb_concepts", F.lit(0))
    score = (
        F.when(F.array_contains("best", F.coalesce("discipline", F.lit(""))), 5).otherwise(0)
        + F.when(F.coalesce("complex", F.lit(False)) & excellent, 2).otherwise(0)
        + F.when((kb > 50) & excellent, 2).when((kb > 20) & F.col("quality").isin("good", "excellent"), 1).otherwise(0)
    )
    plain = tasks.where(F.coalesce("extraction_type", F.lit("")) != "hypergraph")
    tried = plain.join(F.broadcast(known), fits, "left").withColumn("_score", score)  # a table of seven rows at most
    best = tried.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("engine").isNotNull(), F.struct((-F.col("_score")).alias("s"), "place", "engine", "quality", "speed")))).alias("e"))
    first, second = F.get("e", F.lit(0)), F.get("e", F.lit(1))
    none = F.size("e") == 0
    chosen = best.select(
        key,
        F.when(none, "KG-Gen").otherwise(first["engine"]).alias("engine"),
        F.when(none, "LightRAG").otherwise(second["engine"]).alias("runner_up"),
        F.when(none, "basic").otherwise(first["quality"]).alias("quality"),
        F.when(none, "fast").otherwise(first["speed"]).alias("speed"),
    )
    fixed = tasks.where(F.col("extraction_type") == "hypergraph").select(key, F.lit("HypergraphRAG").alias("engine"), F.lit("GraphRAG").alias("runner_up"), F.lit("excellent").alias("quality"), F.lit("medium").alias("speed"))
    return chosen.unionByName(fixed)


def size_strategy(size_class: Column, field: str) -> Column:
    """One setting of the strategy of a size class."""
    fields = ["size", "chunk_strategy", "max_chunks", "parallel_books", "parallel_chunks", "chunk_size", "quality_level", "max_tokens", "temperature", "timeout_multiplier"]
    at, out = fields.index(field), None
    for row in rules.SIZE_STRATEGIES:
        out = F.when(size_class == row[0], row[at]) if out is None else out.when(size_class == row[0], row[at])
    return out


def unprocessed(files: DataFrame, processed: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """The files that are neither processed nor failed. Null keys are never processed."""
    return files.join(processed.select(key), key, "left_anti").join(failed.select(key), key, "left_anti")


def head_middle_tail(items: DataFrame, key: str, ordinal: str, most: int = 5) -> DataFrame:
    """All items of keys with up to twice ``most``, else ``most`` each from the beginning, the middle and the end."""
    w = Window.partitionBy(key)
    numbered = items.withColumn("_i", F.row_number().over(w.orderBy(ordinal)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    middle = F.floor(F.col("_n") / 2) - most // 2
    i = F.col("_i")
    return numbered.where((F.col("_n") <= 2 * most) | (i < most) | ((i >= middle) & (i < middle + most)) | (i >= F.col("_n") - most)).drop("_i", "_n")


def chapter_chunks(chapters: DataFrame, key: str, ordinal: str, title: str, text: str, size: int = 30_000) -> DataFrame:
    """(key, chunk_index, label, content, start, end): chapters whole up to ``size`` characters, longer ones in slices.

    Offsets are code points in the key's chapters put together in order. Empty and null chapters are one empty chunk.
    """
    n = F.coalesce(F.length(text), F.lit(0))
    before = F.coalesce(F.sum(n).over(Window.partitionBy(key).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = F.greatest(F.ceil(n / size), F.lit(1)).cast("int")
    placed = chapters.select(key, F.col(ordinal).alias("_o"), F.col(title).alias("_t"), F.coalesce(F.col(text), F.lit("")).alias("_x"), before.alias("_b"), parts.alias("_p"))
    cut = placed.select("*", F.explode(F.sequence(F.lit(0), F.col("_p") - 1)).alias("_j"))
    content = F.substring(F.col("_x"), F.col("_j") * size + 1, F.lit(size))
    label = F.when(F.col("_p") == 1, F.col("_t")).otherwise(F.concat("_t", F.lit(" - 部分"), (F.col("_j") + 1).cast("string")))
    index = F.row_number().over(Window.partitionBy(key).orderBy("_o", "_j")) - 1
    start = F.col("_b") + F.col("_j") * size
    return cut.select(key, index.alias("chunk_index"), label.alias("label"), content.alias("content"), start.alias("start"), (start + F.length(content)).alias("end"))


def knowledge_totals(entries: DataFrame, kind: str, discipline: str) -> DataFrame:
    """(facet, value, n): all entries, entries of each kind, and of each discipline that is not empty; one pass."""
    facets = F.array(
        F.struct(F.lit("total").alias("facet"), F.lit("").alias("value")),
        F.struct(F.lit("type").alias("facet"), F.col(kind).alias("value")),
        F.struct(F.lit("discipline").alias("facet"), F.col(discipline).alias("value")),
    )
    rows = entries.select(F.inline(facets)).where("facet <> 'discipline' or coalesce(value, '') <> ''")
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


def verdict_totals(assessed: DataFrame) -> DataFrame:
    """One row: books, passed, failed, books of each repair priority, and books with each kind of issue."""
    s, p = F.col("score"), F.count_if
    return assessed.agg(
        F.count(F.lit(1)).alias("books"), p(F.col("passed")).alias("passed"), p(~F.col("passed")).alias("failed"),
        p(s < 50).alias("high"), p((s >= 50) & (s < 70)).alias("medium"), p(s >= 70).alias("low"),
        p(F.col("stats.placeholder_leaves") > 0).alias("placeholder_issues"), p(F.col("stats.merged_chapters") > 0).alias("merged_issues"),
        p(F.col("stats.template_leaves") > 0).alias("template_issues"), p(F.col("stats.empty_chapters") > 0).alias("empty_issues"),
    )


def repair_list(assessed: DataFrame, key: str) -> DataFrame:
    """(key, score, priority) of books that did not pass or score under 80, the most urgent first, better scores first among them."""
    # the verdicts are worked out once: a filter and a sort over them would each copy the whole tree of rules
    verdicts = scratch.materialize(assessed.select(key, "score", "passed"), "verdicts")
    s = F.col("score")
    urgent = F.when(s < 50, 0).when(s < 70, 1).otherwise(2)
    rows = verdicts.where(~F.col("passed") | (s < 80)).select(key, "score", F.element_at(F.array(*map(F.lit, ("HIGH", "MEDIUM", "LOW"))), urgent + 1).alias("priority"), urgent.alias("_u"))
    return rows.orderBy("_u", F.desc("score"), key).drop("_u")
