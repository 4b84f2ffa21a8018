"""Vector search by blocks against the plain cosine of all pairs, for its ties and odd vectors too."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quire.operators import retrieval
from quire.operators.retrieval import _top, cosine
from tests.cost import shuffled


def plain(items, queries, k):
    pairs = items.select("item_id", F.col("vector").alias("v")).crossJoin(queries.select("query_id", F.col("vector").alias("q")))
    scored = pairs.select("query_id", "item_id", F.round(cosine(F.col("v"), F.col("q")), 6).alias("score")).where("score is not null")
    return _top(scored, "query_id", [F.desc("score"), F.col("item_id")], k).select("query_id", "rank", "item_id", "score")


def test_equals_the_plain_search(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK", 16)
    r = random.Random(6)
    rows = [[r.choice([-1.0, 0.0, 0.5, 1.0, 2.0]) for _ in range(4)] for _ in range(120)] + [[r.gauss(0, 1) for _ in range(4)] for _ in range(60)] + [[1.0, 2.0, 3.0, 4.0]] * 40
    rows += [None, [], [0.0] * 4, [1.0, None, 0.0, 0.0], [float("nan"), 1.0, 0.0, 0.0], [float("inf"), 1.0, 0.0, 0.0], [1e-300] * 4, [1.0, 2.0], [2.0, 4.0]]
    r.shuffle(rows)
    items = spark.createDataFrame(list(enumerate(rows)), "item_id long, vector array<double>").repartition(3)
    queries = items.where("item_id % 4 = 0 OR vector IS NULL OR size(vector) = 2").withColumnRenamed("item_id", "query_id")
    for k in (1, 7):
        got, want = (sorted(map(str, d.collect())) for d in (retrieval.vector_search(items, queries, k), plain(items, queries, k)))
        assert got == want
    assert retrieval.vector_search(items.limit(0), queries).collect() == []


def test_few_rows_leave_a_block(spark):
    items = spark.range(4000).select(F.col("id").alias("item_id"), F.array(*(F.sin(F.col("id") * k) for k in range(1, 9))).alias("vector")).repartition(4)
    queries = items.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    plan = retrieval.vector_search(items, queries)._jdf.queryExecution().toString()
    assert "MapInArrow" in plan and "aggregate(zip_with" not in plan  # no row, and no lambda, for each pair
    assert shuffled(spark, lambda: retrieval.vector_search(items, queries).count()) <= 4000 * 3 + 200 * 10 * 8
