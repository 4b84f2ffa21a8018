"""Queries of mention linking and graph merging over the generated tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import linking
from quire.plans.catalog import register
from quire.session import load


@register(
    "linked_mentions",
    """WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z]+ [A-Za-z]+')) AS name FROM benchmark),
 h AS (SELECT doc_id, name, string_split(lower(text), lower(name)) AS g FROM documents JOIN n ON contains(lower(text), lower(name))),
 u AS (SELECT doc_id, name, length(name) AS l, len(g) AS m, unnest(g) AS gap, unnest(range(len(g))) AS i FROM h),
 s AS (SELECT *, sum(length(gap)) OVER (PARTITION BY doc_id, name ORDER BY i) + i * l AS begin FROM u)
 SELECT doc_id, name, CAST(begin AS INTEGER) AS "start", CAST(begin + l AS INTEGER) AS "end" FROM s WHERE i + 1 < m""",
)
def linked_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where pairs of words of the benchmark occur in all documents."""
    pairs = F.explode(F.regexp_extract_all("text", F.lit("[A-Za-z]+ [A-Za-z]+"), F.lit(0)))
    names = load(spark, sf_dir, "benchmark").select(pairs.alias("name"))
    return linking.mentions(load(spark, sf_dir, "documents").select("doc_id", "text"), names).drop("mention")


def _parts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Clients and items as nodes, what was bought as edges, and clients with one master or one address as aliases."""
    clients = load(spark, sf_dir, "clients").where("client_id is not null").withColumn("node", F.concat(F.lit("c"), F.col("client_id").cast("string")))
    items = load(spark, sf_dir, "items").where("item_id is not null").select(F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("node"), F.lit("items").alias("source"), F.col("kind"))
    nodes = clients.select("node", "source", F.col("segment").alias("kind")).unionByName(items)
    sold = load(spark, sf_dir, "sales").select("sale_id", F.concat(F.lit("c"), F.col("client_id").cast("string")).alias("u"), F.col("status").alias("source"))
    lines = load(spark, sf_dir, "sale_lines").select("sale_id", F.concat(F.lit("i"), F.col("item_id").cast("string")).alias("v"), F.col("quantity").cast("long").alias("weight"))
    edges = lines.join(sold, "sale_id").where("u is not null and v is not null").select("u", "v", "source", "weight")
    masters = clients.select(F.col("node").alias("a"), F.concat(F.lit("c"), F.col("master_id").cast("string")).alias("b"))
    addressed = clients.where("email is not null").select(F.lower("email").alias("e"), "node")
    same = addressed.join(addressed.groupBy("e").agg(F.min("node").alias("b")), "e").select(F.col("node").alias("a"), "b")
    return nodes, edges, masters.unionByName(same)


_PARTS_SQL = """WITH RECURSIVE c AS (SELECT 'c' || client_id AS node, * FROM clients WHERE client_id IS NOT NULL),
 pairs AS (SELECT node AS a, 'c' || master_id AS b FROM c UNION ALL SELECT c.node, e.b FROM c JOIN (SELECT lower(email) AS e, min(node) AS b FROM c WHERE email IS NOT NULL GROUP BY 1) e ON lower(c.email) = e.e),
 p AS (SELECT DISTINCT a AS node, b AS other FROM pairs WHERE b IS NOT NULL UNION SELECT DISTINCT b, a FROM pairs WHERE b IS NOT NULL),
 r AS (SELECT node, node AS seen FROM p UNION SELECT r.node, p.other FROM r JOIN p ON p.node = r.seen),
 root AS (SELECT node, min(seen) AS root FROM r GROUP BY 1)"""


@register(
    "merged_nodes",
    f"""{_PARTS_SQL}, n AS (SELECT node, source, segment AS kind FROM c UNION ALL SELECT 'i' || item_id, 'items', kind FROM items WHERE item_id IS NOT NULL),
 m AS (SELECT coalesce(root, node) AS node, n.node AS name, source, kind FROM n LEFT JOIN root USING (node)),
 v AS (SELECT node, kind, count(*) AS k FROM m WHERE kind IS NOT NULL GROUP BY node, kind),
 w AS (SELECT node, kind FROM v QUALIFY row_number() OVER (PARTITION BY node ORDER BY k DESC, kind) = 1)
 SELECT m.node, max(w.kind) AS kind, count(DISTINCT name) AS n_names, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM m LEFT JOIN w ON w.node = m.node GROUP BY 1""",
)
def merged_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients and items after the merge: what they are, how many names they go by, where they are from."""
    nodes, _ = linking.merged(*_parts(spark, sf_dir))
    return nodes.withColumn("sources", F.array_join("sources", ","))


@register(
    "merged_edges",
    f"""{_PARTS_SQL}, e AS (SELECT 'c' || s.client_id AS u, 'i' || l.item_id AS v, s.status AS source, l.quantity AS weight FROM sale_lines l JOIN sales s USING (sale_id) WHERE s.client_id IS NOT NULL AND l.item_id IS NOT NULL)
 SELECT coalesce(root, u) AS u, v, CAST(sum(weight) AS BIGINT) AS weight, count(*) AS n_edges, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM e LEFT JOIN root ON root.node = e.u GROUP BY 1, 2""",
)
def merged_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What clients bought, clients merged: quantities, lines and the states of their sales."""
    _, edges = linking.merged(*_parts(spark, sf_dir))
    return edges.withColumn("sources", F.array_join("sources", ","))
