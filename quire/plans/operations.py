"""Queries of choosing, chunking and roll-ups over the generated tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import rules
from quire.functions import text as X
from quire.operators import quality, selection, structured
from quire.plans.catalog import register
from quire.session import load

_MODELS = "SELECT s_suppkey AS model_id, s_nationkey AS region, s_suppkey % 3 AS priority, round(s_acctbal / 1000) AS stability, s_acctbal AS response_time, s_suppkey % 2 = 0 AS in_pool, s_suppkey % 5 <> 0 AS available, s_suppkey % 4 < 3 AS free FROM supplier"


def _models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers taken as models of a pool."""
    s, k = load(spark, sf_dir, "supplier"), F.col("s_suppkey")
    return s.select(k.alias("model_id"), F.col("s_nationkey").alias("region"), (k % 3).alias("priority"), F.round(F.col("s_acctbal") / 1000).alias("stability"), F.col("s_acctbal").alias("response_time"), (k % 2 == 0).alias("in_pool"), (k % 5 != 0).alias("available"), (k % 4 < 3).alias("free"))


@register("pool_places", f"SELECT model_id, CAST(row_number() OVER (ORDER BY priority, stability DESC, response_time, model_id) AS INTEGER) AS place FROM ({_MODELS}) WHERE in_pool")
def pool_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.pool_order(_models(spark, sf_dir)).select("model_id", "place")


@register("pool_when_empty", f"SELECT model_id, CAST(row_number() OVER (ORDER BY priority, stability DESC, model_id) AS INTEGER) AS place FROM ({_MODELS}) WHERE available QUALIFY place <= 5")
def pool_when_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.usable(_models(spark, sf_dir).withColumn("in_pool", F.lit(False))).select("model_id", "place")


@register("fallback_models", f"SELECT region, model_id AS fallback FROM ({_MODELS}) WHERE free AND available QUALIFY row_number() OVER (PARTITION BY region ORDER BY stability DESC, model_id) = 1")
def fallback_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.fallback(_models(spark, sf_dir), "region")


@register(
    "next_sources",
    "WITH s AS (SELECT c_custkey AS source_id, c_nationkey AS region, c_mktsegment AS priority, c_acctbal < 2000 AS exhausted, c_custkey % 2 = 0 AS shared FROM customer), t AS (SELECT *, bool_or(exhausted AND shared) OVER (PARTITION BY region) AS spent FROM s) "
    "SELECT region, source_id AS source FROM t WHERE NOT exhausted AND NOT (spent AND shared) QUALIFY row_number() OVER (PARTITION BY region ORDER BY priority, source_id) = 1",
)
def next_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer")
    return selection.next_source(c.select(F.col("c_custkey").alias("source_id"), F.col("c_nationkey").alias("region"), F.col("c_mktsegment").alias("priority"), (F.col("c_acctbal") < 2000).alias("exhausted"), (F.col("c_custkey") % 2 == 0).alias("shared")), "region")


_FIELDS = ["政治学", "经济学", "哲学", "科学", "文学", "认知科学", "社会学"]
_ENGINE_ROWS = ", ".join(f"({i}, '{name}', {low}, {high if high is not None else 'NULL'}, '{q}', '{speed}', [{', '.join(repr(b) for b in best)}]::VARCHAR[])" for i, (name, low, high, q, speed, best, hyper) in enumerate(rules.ENGINES) if not hyper)


@register(
    "engine_choices",
    "WITH t AS (SELECT p_partkey AS task, CAST(p_retailprice * 150 AS BIGINT) AS n, " + "[" + ", ".join(f"'{f}'" for f in _FIELDS) + "][p_partkey % 7 + 1] AS d, p_size * 2 AS kb, p_partkey % 11 = 0 AS hyper, p_partkey % 3 = 0 AS complex FROM part), "
    f"e(place, engine, low, high, quality, speed, best) AS (VALUES {_ENGINE_ROWS}), "
    "s AS (SELECT task, e.*, CASE WHEN list_contains(best, d) THEN 5 ELSE 0 END + CASE WHEN complex AND quality = 'excellent' THEN 2 ELSE 0 END + CASE WHEN kb > 50 AND quality = 'excellent' THEN 2 WHEN kb > 20 AND quality IN ('good', 'excellent') THEN 1 ELSE 0 END AS score FROM t JOIN e ON n >= low AND (high IS NULL OR n <= high) WHERE NOT hyper), "
    "r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY score DESC, place) AS k FROM s) "
    "SELECT t.task, CASE WHEN hyper THEN 'HypergraphRAG' ELSE coalesce(a.engine, 'KG-Gen') END AS engine, CASE WHEN hyper THEN 'GraphRAG' WHEN a.engine IS NULL THEN 'LightRAG' ELSE b.engine END AS runner_up, "
    "CASE WHEN hyper THEN 'excellent' ELSE coalesce(a.quality, 'basic') END AS quality, CASE WHEN hyper THEN 'medium' ELSE coalesce(a.speed, 'fast') END AS speed FROM t LEFT JOIN r a ON a.task = t.task AND a.k = 1 LEFT JOIN r b ON b.task = t.task AND b.k = 2",
)
def engine_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts taken as extraction tasks."""
    k = F.col("p_partkey")
    tasks = load(spark, sf_dir, "part").select(
        k.alias("task"), F.round(F.col("p_retailprice") * 150).cast("long").alias("content_length"), F.element_at(F.array(*map(F.lit, _FIELDS)), (k % 7 + 1).cast("int")).alias("discipline"),
        (F.col("p_size") * 2).alias("kb_concepts"), F.when(k % 11 == 0, "hypergraph").otherwise("graph").alias("extraction_type"), (k % 3 == 0).alias("complex"),
    )
    return selection.engines(tasks, "task")


@register("size_strategies", "SELECT doc_id, CASE WHEN n < 30000 THEN 'single' WHEN n < 300000 THEN 'semantic' ELSE 'chapter' END AS chunk_strategy, CASE WHEN n < 30000 THEN 30000 WHEN n < 100000 THEN 25000 WHEN n < 300000 THEN 30000 ELSE 35000 END AS chunk_size FROM (SELECT doc_id, length(coalesce(text, '')) * 20 AS n FROM documents)")
def size_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = X.size_class(F.length(F.coalesce("text", F.lit(""))) * 20)
    return load(spark, sf_dir, "documents").select("doc_id", selection.size_strategy(size, "chunk_strategy").alias("chunk_strategy"), selection.size_strategy(size, "chunk_size").alias("chunk_size"))


@register("unprocessed_parts", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 47) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)")
def unprocessed_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts never returned in large quantities and never sold in the largest."""
    li, p = load(spark, sf_dir, "lineitem").withColumnRenamed("l_partkey", "p_partkey"), load(spark, sf_dir, "part").select("p_partkey")
    return selection.unprocessed(p, li.where("l_returnflag = 'R' AND l_quantity > 47"), li.where("l_quantity > 49"), "p_partkey")


@register(
    "sampled_turns",
    "WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id) AS n FROM events) SELECT user_id, event_id FROM n WHERE n <= 10 OR i < 5 OR (i >= n // 2 - 2 AND i < n // 2 + 3) OR i >= n - 5",
)
def sampled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first, middle and last events of every user."""
    return selection.head_middle_tail(load(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id")


@register(
    "turn_chunks",
    "WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS x FROM conversations), b AS (SELECT *, coalesce(sum(length(x)) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, greatest(CAST(ceil(length(x) / 200) AS INTEGER), 1) AS p FROM t), "
    "c AS (SELECT *, unnest(range(p)) AS j FROM b) SELECT conv_id, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, j) - 1 AS INTEGER) AS chunk_index, CASE WHEN p = 1 THEN role ELSE role || ' - 部分' || (j + 1) END AS label, substr(x, j * 200 + 1, 200) AS content, CAST(b + j * 200 AS BIGINT) AS \"start\", CAST(b + j * 200 + length(substr(x, j * 200 + 1, 200)) AS BIGINT) AS \"end\" FROM c",
)
def turn_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns taken as chapters, cut at 200 characters, with their offsets in the conversation."""
    t = load(spark, sf_dir, "conversations").withColumn("o", F.struct("turn", "role"))
    out = selection.chapter_chunks(t, "conv_id", "o", "role", "text", 200)
    return out.withColumn("start", F.col("start").cast("long")).withColumn("end", F.col("end").cast("long"))


@register("knowledge_totals", "SELECT 'total' AS facet, '' AS value, count(*) AS n FROM documents UNION ALL SELECT 'type', lang, count(*) FROM documents GROUP BY lang UNION ALL SELECT 'discipline', source, count(*) FROM documents WHERE coalesce(source, '') <> '' GROUP BY source")
def knowledge_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.knowledge_totals(load(spark, sf_dir, "documents"), "lang", "source")


#: Conversations taken as books that differ in what the quality rules look at.
_LOGIC = "前提假设：" + "甲" * 50


def _books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One book a conversation: turns are chapters, users' turns concepts, assistants' turns insights, cases and quotes."""
    t = load(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("turn")
    number = F.when(k % 6 == 5, (k * 2 + 1).cast("string")).otherwise(F.lpad((k + 1).cast("string"), 2, "0"))
    logic = F.when(k % 5 == 4, "-").when(k % 5 == 3, "无").otherwise(F.lit(_LOGIC))
    title = F.when((k % 9 == 7) & (F.col("conv_id") % 7 == 0), "本章主要讨论").otherwise(F.col("role"))
    cell = F.struct("turn", "role", "text", number.alias("chapter_number"), title.alias("title"), logic.alias("underlying_logic"))
    b = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(cell)).alias("c"))

    def of(role: str, make):
        return F.transform(F.filter("c", lambda x: x["role"] == role), make)

    whole = F.col("conv_id") % 3 != 0
    return b.select(
        "conv_id",
        F.struct(F.col("conv_id").cast("string").alias("title"), F.lit("x").alias("author"), F.when(whole, "x").otherwise("").alias("author_intro"), F.lit("x").alias("discipline")).alias("metadata"),
        F.struct(*(F.lit("x").alias(f) for f in rules.TIME_FIELDS)).alias("time_background"),
        F.when(F.col("conv_id") % 4 != 0, F.struct(F.lit("x").alias("feminist_perspective"), F.when(whole, "x").otherwise("待补充").alias("postcolonial_perspective"))).alias("critical_analysis"),
        F.transform("c", lambda x: F.struct(x["chapter_number"].alias("chapter_number"), x["title"].alias("title"), x["text"].alias("core_argument"), x["underlying_logic"].alias("underlying_logic"))).alias("chapters"),
        of("user", lambda x: F.struct(x["role"].alias("name"), x["text"].alias("definition"), x["text"].alias("deep_meaning"))).alias("core_concepts"),
        of("assistant", lambda x: F.struct(x["role"].alias("title"), x["text"].alias("description"))).alias("key_insights"),
        of("assistant", lambda x: F.struct(x["role"].alias("name"), x["text"].alias("event_description"))).alias("key_cases"),
        of("system", lambda x: F.struct(x["text"].alias("text"))).alias("key_quotes"),
        F.lit(6).alias("expected_chapters"),
    )


def _hits(words: list[str], x: str) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def _book_sql() -> str:
    """The rules over those books, by counts of turns."""
    turns = (
        "SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS x, CASE WHEN turn % 6 = 5 THEN CAST(turn * 2 + 1 AS VARCHAR) ELSE CASE WHEN turn + 1 < 10 THEN '0' || (turn + 1) ELSE CAST(turn + 1 AS VARCHAR)[1:2] END END AS num, "
        f"CASE WHEN turn % 5 = 4 THEN '-' WHEN turn % 5 = 3 THEN '无' ELSE '{_LOGIC}' END AS logic, CASE WHEN turn % 9 = 7 AND conv_id % 7 = 0 THEN '本章主要讨论' ELSE coalesce(role, '') END AS title FROM conversations"
    )
    merged = "(" + " OR ".join(f"regexp_matches({{x}}, '{p}')" for p in rules.MERGED) + ")"
    hollow = f"({_hits(rules.CHAPTER_PLACEHOLDERS, 'num')} OR {_hits(rules.CHAPTER_PLACEHOLDERS, 'title')} OR {_hits(rules.CHAPTER_PLACEHOLDERS, 'x')})"
    # leaves of a turn: number, title, text, logic; again name and two texts; title and text, name and text; text
    weight = "(CASE role WHEN 'user' THEN 3 WHEN 'assistant' THEN 3 WHEN 'system' THEN 2 ELSE 1 END)"
    leaf = lambda w: f"sum(CAST({_hits(w, 'title')} AS INT) + CAST({_hits(w, 'num')} AS INT) + CAST({_hits(w, 'logic')} AS INT) + {weight} * CAST({_hits(w, 'x')} AS INT) + CASE WHEN role = 'user' OR role = 'assistant' THEN CASE role WHEN 'user' THEN 1 ELSE 2 END * CAST({_hits(w, 'role')} AS INT) ELSE 0 END)"
    counts = f"""SELECT conv_id, count(*) AS ch, count_if({merged.format(x='num')}) + count_if({merged.format(x='title')}) AS merged, count_if({hollow}) AS hollow,
 bool_or(NOT regexp_matches(num, '^[0-9]{{2}}$')) AS bad_number, bool_or(logic = '-') AS no_logic, count_if(length(x) + length(logic) < 50) AS empty, bool_or({_hits(rules.TEMPLATES, 'title')}) AS template_title,
 count_if(role = 'user') AS co, count_if(role = 'user' AND length(x) < 30) AS shallow, count_if(role = 'user' AND (x = '' OR {_hits(rules.PLACEHOLDERS + rules.TEMPLATES, 'x')} OR {_hits(rules.PLACEHOLDERS + rules.TEMPLATES, 'role')})) AS vague,
 count_if(role = 'assistant') AS ins, count_if(role = 'assistant' AND {_hits(rules.TEMPLATES, 'x')}) AS template_ins, count_if(role = 'system') AS qu, count_if(role = 'system' AND length(x) < 10) AS short_qu,
 count_if(logic = '{_LOGIC}') * 1.0 / count(*) AS ratio, {leaf(rules.PLACEHOLDERS)} AS holes, {leaf(rules.TEMPLATES)} AS phrases FROM t GROUP BY conv_id"""
    gap = "SELECT DISTINCT conv_id FROM (SELECT conv_id, n, lead(n) OVER (PARTITION BY conv_id ORDER BY n) AS m FROM (SELECT conv_id, CAST(regexp_extract(num, '[0-9]+') AS INT) AS n FROM t)) WHERE m > n + 1"
    return f"""WITH t AS ({turns}), k AS ({counts}), g AS ({gap}),
 b AS (SELECT *, conv_id % 3 <> 0 AS whole, conv_id % 4 <> 0 AS critical, ch / 6.0 AS cover, holes + CASE WHEN conv_id % 4 <> 0 AND conv_id % 3 = 0 THEN 1 ELSE 0 END AS marks, conv_id IN (SELECT conv_id FROM g) AS gaps FROM k),
 s AS (SELECT *, CAST(bad_number AS INT) + CAST(no_logic AS INT) + CAST(ch >= 5 AND ch < 10 AS INT) + CAST(empty > 0 AND NOT empty > 0.3 * ch AS INT) + CAST(template_title AS INT) + CAST(shallow > 0 AND NOT shallow > 0.3 * co AS INT) + CAST(short_qu > 0 AS INT)
 + CAST(phrases > 0 AND phrases <= 3 AS INT) + CAST(ratio >= 0.5 AND ratio < 0.8 AS INT) + CASE WHEN NOT critical THEN 2 WHEN NOT whole THEN 1 ELSE 0 END + 1 + template_ins AS warned FROM b),
 p AS (SELECT conv_id, CAST(warned AS BIGINT) AS warnings, CAST(greatest(0, 100 - CASE WHEN critical THEN 0 ELSE 20 END - CASE WHEN whole THEN 0 ELSE 15 END - 50 * (merged + hollow) - CASE WHEN cover < 0.5 THEN 30 WHEN cover < 0.8 THEN 15 ELSE 0 END - CASE WHEN ch < 5 THEN 20 WHEN ch < 10 THEN 5 ELSE 0 END
 - CASE WHEN empty > 0.3 * ch THEN 15 ELSE 0 END - CASE WHEN co < 3 THEN 15 ELSE 0 END - CASE WHEN shallow > 0.3 * co THEN 10 ELSE 0 END - 5 * vague - CASE WHEN qu < 1 THEN 10 ELSE 0 END - CASE WHEN ins < 2 THEN 10 ELSE 0 END - CASE WHEN ins < 1 THEN 10 ELSE 0 END
 - 8 * marks - 5 * phrases - CASE WHEN ratio < 0.5 THEN 15 WHEN ratio < 0.8 THEN 5 ELSE 0 END - CASE WHEN NOT critical THEN 10 WHEN NOT whole THEN 5 ELSE 0 END - 2 * warned) AS INTEGER) AS score,
 array_to_string(list_filter([CASE WHEN merged > 0 THEN '章节合并' END, CASE WHEN gaps THEN '章节缺失' END, CASE WHEN empty > 0.3 * ch THEN '空洞章节' END, CASE WHEN marks > 5 THEN '占位符污染' END, CASE WHEN phrases > 3 THEN '模板化内容' END], lambda i: i IS NOT NULL), ',') AS blocking FROM s)
 SELECT conv_id, score, warnings, blocking, blocking = '' AND score >= 70 AS passed FROM p"""


@register("book_verdicts", _book_sql())
def book_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score, warnings, blocking issues and verdict of books that differ in every part of the rules their turns can show."""
    out = quality.assess(_books(spark, sf_dir))
    return out.select("conv_id", "score", F.col("warnings").cast("long").alias("warnings"), F.array_join("blocking", ",").alias("blocking"), "passed")


@register("verdict_totals", f"WITH v AS ({_book_sql()}) SELECT count(*) AS books, count_if(passed) AS passed, count_if(NOT passed) AS failed, count_if(score < 50) AS high, count_if(score >= 50 AND score < 70) AS medium, count_if(score >= 70) AS low FROM v")
def verdict_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.verdict_totals(quality.assess(_books(spark, sf_dir)))
    return out.select(*(F.col(c).cast("long").alias(c) for c in ("books", "passed", "failed", "high", "medium", "low")))


@register(
    "fix_list",
    _book_sql().rsplit(", p AS", 1)[0].rsplit(",\n p AS", 1)[0].rsplit(",\n s AS", 1)[0]
    + """ SELECT conv_id, unnest(list_filter([
 CASE WHEN merged > 0 THEN struct_pack(priority := 'CRITICAL', item := 'merged_chapters') END, CASE WHEN hollow > 0 THEN struct_pack(priority := 'CRITICAL', item := 'placeholder_chapters') END,
 CASE WHEN NOT critical THEN struct_pack(priority := 'CRITICAL', item := 'missing_fields') END, CASE WHEN empty > 0.3 * ch THEN struct_pack(priority := 'HIGH', item := 'empty_chapters') END,
 CASE WHEN marks > 0 THEN struct_pack(priority := 'HIGH', item := 'placeholders') END, CASE WHEN co < 3 THEN struct_pack(priority := 'HIGH', item := 'concepts') END,
 CASE WHEN qu < 1 THEN struct_pack(priority := 'MEDIUM', item := 'quotes') END, CASE WHEN ratio < 0.5 THEN struct_pack(priority := 'MEDIUM', item := 'logic_format') END], lambda x: x IS NOT NULL), recursive := true) FROM b""",
)
def fix_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to repair of each book."""
    return structured.fix_items(quality.assess(_books(spark, sf_dir)), "conv_id").select("conv_id", "priority", "item")


@register("repair_list", f"WITH v AS ({_book_sql()}) SELECT conv_id, score, CASE WHEN score < 50 THEN 'HIGH' WHEN score < 70 THEN 'MEDIUM' ELSE 'LOW' END AS priority FROM v WHERE NOT passed OR score < 80")
def repair_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.repair_list(quality.assess(_books(spark, sf_dir)), "conv_id")
