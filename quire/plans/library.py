"""The library's queries over the generated tables, each with the SQL that must give the same rows where SQL has a form for it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import scratch
from quire.functions import rules
from quire.functions import text as X
from quire.operators import entities, graph, quality, retrieval, series, structured
from quire.plans.catalog import register
from quire.session import load
from quire.sources import books, sinks
from quire.streaming import metrics


def _words(values: list[str]) -> str:
    return "[" + ", ".join("'" + v + "'" for v in values) + "]"


_TOKENS = "list_distinct(list_filter(list_transform(regexp_extract_all({x}, '[a-zA-Z0-9]{{2,}}'), lambda t: lower(t)), lambda t: NOT list_contains(" + _words(rules.STOPWORDS) + ", t)))"


def _tokens_sql(x: str) -> str:
    return _TOKENS.format(x=x)


# -- text ---------------------------------------------------------------------------------------------------------------


@register(
    "script_language",
    "SELECT doc_id, CASE WHEN length(trim(t, E' \\t\\n\\r')) < 10 THEN 'unknown' WHEN len(regexp_extract_all(t, '[一-鿿]')) / length(t) > 0.3 THEN 'zh' WHEN len(regexp_extract_all(t, '[぀-ヿ]')) / length(t) > 0.2 THEN 'ja' ELSE 'en' END AS script FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
)
def script_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", X.script_language("text").alias("script"))


@register(
    "token_estimates",
    "SELECT doc_id, CAST(floor(h * 1.5 + (n - h) * 0.25) AS INTEGER) AS tokens FROM (SELECT doc_id, length(coalesce(text, '')) AS n, len(regexp_extract_all(coalesce(text, ''), '[一-鿿]')) AS h FROM documents)",
)
def token_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", X.token_estimate("text").alias("tokens"))


@register(
    "content_hashes",
    "SELECT doc_id, md5(coalesce(text, '')) AS id, CASE WHEN length(text) < 30000 THEN 'short' WHEN length(text) < 100000 THEN 'medium' WHEN length(text) < 300000 THEN 'long' ELSE 'extra_long' END AS size FROM documents",
)
def content_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", X.content_id("text").alias("id"), X.size_class(F.length("text")).alias("size"))


@register(
    "distinct_contents",
    "SELECT md5(coalesce(text, '')) AS id, max_by(doc_id, doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
)
def distinct_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").select("doc_id", X.content_id("text").alias("id"))
    return series.latest(d, ["id"], ["doc_id"]).join(d.groupBy("id").agg(F.count(F.lit(1)).alias("n")), "id").select("id", "doc_id", "n")


@register(
    "fixed_chunks",
    "SELECT doc_id, i AS chunk, substr(text, i * 1000 + 1, 1000) AS content FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 1000.0) AS BIGINT))) AS i FROM documents WHERE text <> '')",
)
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = load(spark, sf_dir, "documents").where("text <> ''")
    i = F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / 1000).cast("int") - 1))
    return d.select("doc_id", "text", i.alias("i")).select("doc_id", F.col("i").cast("long").alias("chunk"), F.substring("text", F.col("i") * 1000 + 1, F.lit(1000)).alias("content"))


def _clean_sql() -> str:
    """The cleaning patterns in DuckDB's dialect, one inside the other, then the strip."""
    unicode_space = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    out = "coalesce(text, '')"
    for pattern, new in rules.CLEANING:
        pattern = pattern.replace(r"(?U:\s)", unicode_space).replace(r"(?U:\d)", r"\p{Nd}").replace("(?md)", "(?m)").replace("(?imd)", "(?im)").replace(r"[-\s]", r"[-\t-\r ]").replace(r"[\d\s", r"[\d\t-\r ")
        out = f"regexp_replace({out}, '{pattern}', {'chr(10)' if new == chr(10) else 'chr(10) || chr(10)' if new else repr('')}, 'g')"
    strip = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
    return f"SELECT doc_id, regexp_replace({out}, '^{strip}|{strip}$', '', 'g') AS text FROM documents"


@register("clean_text", _clean_sql())
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select("doc_id", X.clean("text").alias("text"))


@register(
    "repeated_lines",
    "WITH l AS (SELECT doc_id, trim(unnest(string_split(coalesce(text, ''), chr(10)))) AS line FROM documents), c AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_lines, CAST(count(*) AS BIGINT) AS n_distinct, CAST(max(n) AS BIGINT) AS most FROM c GROUP BY doc_id",
)
def repeated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line"))
    n = lines.groupBy("doc_id", F.trim("line").alias("line")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("doc_id").agg(F.sum("n").alias("n_lines"), F.count(F.lit(1)).alias("n_distinct"), F.max("n").alias("most"))


# -- conversations: ordered rows ------------------------------------------------------------------------------------------

_TURNS = "SELECT conv_id, turn, role, length(coalesce(text, '')) AS n FROM conversations"


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))


@register("turn_offsets", f"SELECT conv_id, turn, role, CAST(sum(n) OVER w - n AS BIGINT) AS start, CAST(sum(n) OVER w AS BIGINT) AS \"end\" FROM ({_TURNS}) WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, n ROWS UNBOUNDED PRECEDING)")
def turn_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.offsets(_turns(spark, sf_dir), "conv_id", ["turn", "role", "n"], F.col("n")).select("conv_id", "turn", "role", "start", "end")


@register(
    "short_turns_merged",
    f"WITH o AS (SELECT *, CASE WHEN n >= 300 OR row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, n) = 1 THEN 1 ELSE 0 END AS o FROM ({_TURNS})), p AS (SELECT conv_id, n, sum(o) OVER (PARTITION BY conv_id ORDER BY turn, role, n ROWS UNBOUNDED PRECEDING) AS part FROM o) SELECT conv_id, CAST(part AS BIGINT) AS part, CAST(sum(n) AS BIGINT) AS n_chars, count(*) AS n_turns FROM p GROUP BY 1, 2",
)
def short_turns_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = series.merge_short(_turns(spark, sf_dir), "conv_id", ["turn", "role", "n"], F.col("n"), 300)
    return parts.groupBy("conv_id", F.col("part").cast("long").alias("part")).agg(F.sum("n").alias("n_chars"), F.count(F.lit(1)).alias("n_turns"))


@register(
    "packed_turns",
    f"WITH RECURSIVE t AS (SELECT conv_id, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn, n) - 1 AS i FROM ({_TURNS})), f AS (SELECT conv_id, i, CAST(0 AS BIGINT) AS part, CAST(n AS BIGINT) AS total FROM t WHERE i = 0 UNION ALL SELECT t.conv_id, t.i, CASE WHEN f.total + t.n > 2000 THEN f.part + 1 ELSE f.part END, CASE WHEN f.total + t.n > 2000 THEN t.n ELSE f.total + t.n END FROM f JOIN t ON t.conv_id = f.conv_id AND t.i = f.i + 1) SELECT conv_id, part, min(i) AS first, count(*) AS n, max(total) AS total FROM f GROUP BY 1, 2",
)
def packed_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.pack(_turns(spark, sf_dir), "conv_id", ["turn"], F.col("n"), 2000).select("conv_id", F.col("part").cast("long").alias("part"), "first", "n", "total")


@register("recalled_turns", f"SELECT conv_id, turn, role, CAST(used AS BIGINT) AS used FROM (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY n DESC, turn, role ROWS UNBOUNDED PRECEDING) AS used FROM ({_TURNS})) WHERE used <= 1500")
def recalled_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.context(_turns(spark, sf_dir), "conv_id", [F.desc("n"), F.col("turn"), F.col("role")], F.col("n"), 1500).select("conv_id", "turn", "role", "used")


@register("short_term_memory")
def short_term_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    importance = F.when(F.col("role") == "system", 0.9).otherwise(F.least(F.lit(0.8), F.col("n") / 1000))
    return series.remember(_turns(spark, sf_dir), "conv_id", ["turn"], F.col("text"), importance, 4000, 50)


@register("conversation_books")
def conversation_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality engine over conversations taken as books: turns are chapters, long turns concepts."""
    t = _turns(spark, sf_dir)
    cell = F.struct("turn", F.lpad((F.col("turn") + 1).cast("string"), 2, "0").alias("chapter_number"), F.col("role").alias("title"), F.col("text").alias("core_argument"), F.lit("前提假设：无").alias("underlying_logic"))
    b = t.groupBy("conv_id").agg(F.array_sort(F.collect_list(cell)).alias("c"))
    b = b.select("conv_id", F.struct(F.col("conv_id").cast("string").alias("title"), F.lit("x").alias("author"), F.lit("x").alias("author_intro"), F.lit("x").alias("discipline")).alias("metadata"), F.transform("c", lambda x: x.dropFields("turn")).alias("chapters"))
    out = quality.assess(b)
    return out.select("conv_id", "score", F.array_join("issues", ",").alias("issues"), "passed", quality.priority(F.col("score")).alias("priority"))


# -- events: request logs ---------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events").withColumn("failed", F.col("event_type") == "error")


@register(
    "failure_streaks",
    "WITH f AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events), i AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f) SELECT event_id, CAST(sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS streak FROM i",
)
def failure_streaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.failure_streaks(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("failed")).select("event_id", "streak")


@register("pass_trend", "SELECT event_id, CASE WHEN count(*) OVER w >= 5 THEN avg(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER w END AS recent FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 4 PRECEDING)")
def pass_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.trend(_events(spark, sf_dir), "user_id", ["ts", "event_id"], ~F.col("failed")).select("event_id", "recent")


@register("throttled", "SELECT event_id, coalesce(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING) = 3, FALSE) AS throttle FROM events")
def throttled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.all_failed(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("failed")).select("event_id", "throttle")


@register("response_times", "SELECT user_id, round(list_reduce(list(value ORDER BY ts, event_id), lambda a, x: a * 0.7 + x * 0.3), 6) AS ema FROM events GROUP BY 1")
def response_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.smoothed(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("value")).select("user_id", F.round("ema", 6).alias("ema"))


@register("model_pool")
def model_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.pool_state(_events(spark, sf_dir), "user_id", ["ts", "event_id"], ~F.col("failed"), F.col("value"))


@register("concurrency_levels")
def concurrency_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.concurrency(_events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("failed"))


@register("latency_histogram", "WITH b AS (SELECT unnest([" + ", ".join(f"CAST({b} AS DOUBLE)" for b in rules.API_BUCKETS) + ", CAST('inf' AS DOUBLE)]) AS le) SELECT event_type, le, count(*) FILTER (WHERE value <= le) AS n FROM events, b GROUP BY 1, 2")
def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.histogram(load(spark, sf_dir, "events"), ["event_type"], F.col("value"), rules.API_BUCKETS)


@register("hourly_metrics", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS failures, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def hourly_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.windowed_metrics(load(spark, sf_dir, "events")).drop("buckets")


@register("latest_state", "SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max(ts) AS ts FROM events GROUP BY 1")
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.latest(load(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_type", "ts")


# -- graph: parts bought together ---------------------------------------------------------------------------------------------

_EDGES = "e AS (SELECT DISTINCT a.l_partkey AS u, b.l_partkey AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey), n AS (SELECT u AS node, v AS other FROM e UNION ALL SELECT v, u FROM e), d AS (SELECT node, count(*) AS degree FROM n GROUP BY 1)"


def _bought_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    rows = lines.count()
    lines = scratch.spread(lines, rows, "l_orderkey")
    # an order of four lines makes six pairs
    pairs = graph.undirected(lines.withColumnRenamed("l_partkey", "u").join(lines.withColumnRenamed("l_partkey", "v"), "l_orderkey").where("u < v"), rows=3 * rows)
    return scratch.materialize(pairs, "bought-together")  # the operators read edges several times


def _brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("community"))


@register("part_degrees", f"WITH {_EDGES} SELECT p_partkey AS node, coalesce(degree, 0) AS degree FROM part LEFT JOIN d ON node = p_partkey")
def part_degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.degrees(_bought_together(spark, sf_dir), _brands(spark, sf_dir))


@register(
    "part_relevance",
    f"""WITH {_EDGES}, s AS (SELECT DISTINCT l_partkey AS node, l_suppkey AS source FROM lineitem), k AS (SELECT node, count(*) AS k FROM s GROUP BY 1),
    o AS (SELECT u, v, count(*) AS c FROM e JOIN s x ON x.node = u JOIN s y ON y.node = v AND y.source = x.source GROUP BY 1, 2),
    aa AS (SELECT u, v, sum(1 / ln(degree)) AS w FROM e JOIN n x ON x.node = u JOIN n y ON y.node = v AND y.other = x.other JOIN d ON d.node = x.other WHERE degree > 1 GROUP BY 1, 2)
    SELECT e.u AS a, e.v AS b, round(3.0 + 4.0 * coalesce(c / (ku.k + kv.k - c), 0) + 1.5 * coalesce(w, 0) + CASE WHEN pu.p_brand = pv.p_brand THEN 1.0 ELSE 0.0 END, 6) AS total
    FROM e LEFT JOIN o ON o.u = e.u AND o.v = e.v LEFT JOIN aa ON aa.u = e.u AND aa.v = e.v LEFT JOIN k ku ON ku.node = e.u LEFT JOIN k kv ON kv.node = e.v
    LEFT JOIN part pu ON pu.p_partkey = e.u LEFT JOIN part pv ON pv.p_partkey = e.v""",
)
def part_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _bought_together(spark, sf_dir)
    types = _brands(spark, sf_dir).withColumnRenamed("community", "type")
    sources = load(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("node"), F.col("l_suppkey").alias("source"))
    return graph.relevance(e.select(F.col("u").alias("a"), F.col("v").alias("b")), e, types, sources).select("a", "b", F.round("total", 6).alias("total"))


@register("brand_cohesion", f"WITH {_EDGES}, i AS (SELECT x.p_brand AS b, count(*) AS k FROM e JOIN part x ON x.p_partkey = u JOIN part y ON y.p_partkey = v AND y.p_brand = x.p_brand GROUP BY 1) SELECT p_brand AS community, count(*) AS n, coalesce(max(k), 0) AS inside, round(CASE WHEN count(*) < 2 THEN 0 ELSE coalesce(max(k), 0) / (count(*) * (count(*) - 1) / 2) END, 9) AS cohesion FROM part LEFT JOIN i ON b = p_brand GROUP BY 1")
def brand_cohesion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.cohesion(_bought_together(spark, sf_dir), _brands(spark, sf_dir)).withColumn("cohesion", F.round("cohesion", 9))


@register("bridge_parts", f"WITH {_EDGES} SELECT node, count(DISTINCT p_brand) AS communities, least(1.0, count(DISTINCT p_brand) / 5) AS score FROM n JOIN part ON p_partkey = other GROUP BY 1 HAVING count(DISTINCT p_brand) >= 3")
def bridge_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.bridge_nodes(_bought_together(spark, sf_dir), _brands(spark, sf_dir))


@register("top_parts", f"WITH {_EDGES}, r AS (SELECT p_brand AS community, node, row_number() OVER (PARTITION BY p_brand ORDER BY degree DESC, node) AS r FROM d JOIN part ON p_partkey = node) SELECT community, string_agg(CAST(node AS VARCHAR), ',' ORDER BY r) AS labels FROM r WHERE r <= 3 GROUP BY 1")
def top_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = graph.top_members(graph.degrees(_bought_together(spark, sf_dir)), _brands(spark, sf_dir))
    return top.select("community", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@register("near_suppliers", "WITH e AS (SELECT c_custkey AS c, c_nationkey AS x FROM customer), s AS (SELECT s_suppkey AS s, s_nationkey AS x FROM supplier) SELECT s AS seed, count(DISTINCT c) AS n FROM s JOIN e USING (x) GROUP BY 1")
def near_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers two hops from each supplier, by way of its nation."""
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    e = c.select(node("c", "c_custkey").alias("u"), node("n", "c_nationkey").alias("v")).unionByName(s.select(node("s", "s_suppkey").alias("u"), node("n", "s_nationkey").alias("v")))
    reached = graph.reach_counts(s.select(node("s", "s_suppkey").alias("node")), graph.undirected(e), c.select(node("c", "c_custkey").alias("node")))
    return reached.select(F.substring("seed", 2, 20).cast("long").alias("seed"), "n")


@register("part_communities")
def part_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Louvain communities of the parts bought together."""
    return graph.louvain(_bought_together(spark, sf_dir))


@register("part_labels")
def part_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten rounds of label propagation over the parts bought together."""
    return graph.label_communities(_bought_together(spark, sf_dir))


@register("seed_clusters")
def seed_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.seed_communities(_bought_together(spark, sf_dir))


# -- retrieval -------------------------------------------------------------------------------------------------------------------


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("title"), "text")


@register("token_weights", f"WITH p AS (SELECT doc_id, unnest(list_distinct(list_concat({_tokens_sql("coalesce(text, '')")}, {_tokens_sql("coalesce(source, '')")}))) AS token FROM documents) SELECT token, count(*) AS df, round(ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1), 9) AS idf FROM p GROUP BY 1")
def token_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    return retrieval.idf(retrieval.postings(pages), pages).withColumn("idf", F.round("idf", 9))


@register(
    "token_search",
    f"""WITH p AS (SELECT doc_id, unnest(list_distinct(list_concat({_tokens_sql("coalesce(text, '')")}, {_tokens_sql("coalesce(source, '')")}))) AS token FROM documents),
    i AS (SELECT token, ln(((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5) + 1) AS idf FROM p GROUP BY 1),
    q AS (SELECT item_id AS query_id, unnest({_tokens_sql("coalesce(text, '')")}) AS token FROM benchmark),
    m AS (SELECT query_id, doc_id, idf AS s FROM q JOIN i USING (token) JOIN p USING (token) UNION ALL SELECT DISTINCT query_id, doc_id, 2.0 FROM q JOIN documents ON contains(source, token)),
    t AS (SELECT query_id, doc_id AS page_id, round(sum(s), 6) AS score FROM m GROUP BY 1, 2)
    SELECT query_id, CAST(r AS INTEGER) AS rank, page_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, page_id) AS r FROM t) WHERE r <= 20""",
)
def token_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.token_search(_pages(spark, sf_dir), load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text"))


@register(
    "vector_search",
    "WITH v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), p AS (SELECT q.vec_id AS query_id, i.vec_id AS item_id, round(list_dot_product(q.v, i.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(i.v, i.v))), 6) AS score FROM v q, v i WHERE q.vec_id % 20 = 0) SELECT query_id, CAST(r AS INTEGER) AS rank, item_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS r FROM p) WHERE r <= 10",
)
def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return retrieval.vector_search(v, v.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id"))


# -- entities, sources, output --------------------------------------------------------------------------------------------------------


@register("dictionary_mentions")
def dictionary_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = load(spark, sf_dir, "benchmark").select(F.lit("word").alias("type"), F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0))).alias("term"))
    return entities.dictionary_mentions(load(spark, sf_dir, "documents"), terms)


@register("merged_nations", "SELECT upper(trim(c_mktsegment)) AS name, count(*) AS source_count FROM customer GROUP BY 1")
def merged_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_mktsegment").alias("name"), F.lit("segment").alias("type"), F.col("c_name").alias("description"))
    return entities.merge_entities(c).select("name", F.col("source_count").cast("long").alias("source_count"))


@register("vector_leaders")
def vector_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaders among all vectors, whatever their labels."""
    return entities.leaders(load(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), 0.8)


@register("page_texts")
def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return books.page_texts(load(spark, sf_dir, "pages"))


@register("json_documents", "SELECT doc_id, coalesce(source, '') AS source, n_chars FROM documents")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the JSON envelope and the tolerant parser."""
    d = load(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "n_chars")
    got = sinks.envelope(d, "document").select(structured.parsed("json").alias("p"))
    field = lambda f: F.get_json_object("p.document", f"$.data.{f}")
    return got.select(field("doc_id").cast("long").alias("doc_id"), field("source").alias("source"), field("n_chars").cast("long").alias("n_chars"))


@register("brand_mind_maps")
def brand_mind_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"]).alias("names"))
    return p.select("p_brand", sinks.mind_map(F.col("p_brand"), [("parts", F.col("names"), 20)]).alias("map"))


@register("chapter_gaps", "WITH h AS (SELECT DISTINCT l_orderkey, l_partkey % 40 AS n FROM lineitem), g AS (SELECT l_orderkey, n, lead(n) OVER (PARTITION BY l_orderkey ORDER BY n) AS x FROM h) SELECT l_orderkey, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS missing FROM (SELECT l_orderkey, unnest(range(n + 1, x)) AS m FROM g WHERE x > n + 1) GROUP BY 1")
def chapter_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders taken as books whose lines are chapters numbered by their part: numbers missing in between, all of them."""
    lines = load(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 40).alias("n"))
    return quality.chapter_gaps(lines, "l_orderkey", "n", None).select("l_orderkey", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))


@register("turn_gaps", "WITH h AS (SELECT DISTINCT conv_id, turn AS n FROM conversations WHERE role = 'user' OR turn = 0), g AS (SELECT conv_id, n, lead(n) OVER (PARTITION BY conv_id ORDER BY n) AS x FROM h), m AS (SELECT conv_id, unnest(range(n + 1, x)) AS m FROM g WHERE x > n + 1), r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY m) AS r FROM m) SELECT conv_id, string_agg(CAST(m AS VARCHAR), ',' ORDER BY m) AS missing FROM r WHERE r <= 10 GROUP BY 1")
def turn_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten turns of a conversation, between its first and its last user's turn, that are not the user's."""
    turns = load(spark, sf_dir, "conversations").where("role = 'user' OR turn = 0")
    return quality.chapter_gaps(turns, "conv_id", "turn").select("conv_id", F.array_join(F.transform("missing", lambda x: x.cast("string")), ",").alias("missing"))
