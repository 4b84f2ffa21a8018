"""Lexical, vector and fused search. Queries are a table, searched together; each gets its own top k."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import scratch
from quire.functions import rules
from quire.functions.text import tokens


def _top(df: DataFrame, key: str, order: list[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(name) <= k)


def postings(pages: DataFrame) -> DataFrame:
    """(token, page_id) of pages (page_id, title, text): the distinct tokens of title and text."""
    return pages.select("page_id", F.explode(F.array_union(tokens("text"), tokens("title"))).alias("token"))


def idf(posted: DataFrame, pages: DataFrame) -> DataFrame:
    """(token, df, idf) of postings; all pages count, those without tokens too."""
    d = posted.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    n = pages.agg(F.count(F.lit(1)).alias("n_pages"))
    d = d.crossJoin(F.broadcast(n))  # n is one row
    return d.select("token", "df", F.log((F.col("n_pages") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1).alias("idf"))


#: Tokens of all queries together that every task may hold; more are joined by a shuffle.
ASKED = 100_000


def _title_token(title: str) -> Column:
    """A token that no text has: it begins with a space."""
    return F.concat(F.lit(" "), F.col(title))


def token_search(pages: DataFrame, queries: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, page_id, score) for queries (query_id, text): summed idf of shared tokens, and a bonus where the
    title has a query token as a substring. Ties go to the smaller page.

    Titles are postings too, by a token of their own; title matches run over distinct titles, not over pages. Postings are filtered
    by what is asked for and written, and dealt out by page, so that a page's scores are summed where they are made; how many tasks
    share them follows the number of sums, which the frequencies of the tokens give.
    """
    spark = pages.sparkSession
    wanted = queries.select("query_id", F.explode(tokens("text")).alias("token"))
    titles = pages.where("title is not null").select("title").distinct()
    hit = titles.join(wanted, F.col("title").contains(F.col("token"))).select("query_id", "title").distinct()
    asks = wanted.withColumn("bonus", F.lit(None).cast("double")).unionByName(hit.select("query_id", _title_token("title").alias("token"), F.lit(rules.TITLE_BONUS).cast("double").alias("bonus")))
    asks = scratch.materialize(asks, "search-asks")
    named = F.when(F.col("title").isNotNull(), F.array(_title_token("title"))).otherwise(F.array().cast("array<string>"))
    both = pages.select("page_id", F.explode(F.concat(F.array_union(tokens("text"), tokens("title")), named)).alias("token"))
    posted = scratch.materialize(both.join(asks.select("token").distinct(), "token", "left_semi"), "search-postings")
    asked = asks.join(idf(posted, pages), "token").select("token", "query_id", F.coalesce("bonus", "idf").alias("score"), "df")
    asked = scratch.materialize(asked, "search-weights")
    n, rows = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("df"), F.lit(0))).first()
    asked, shares = asked.drop("df"), scratch.partitions(spark, rows)
    if n <= ASKED:
        scored = posted.repartition(shares, "page_id").join(F.broadcast(asked), "token")
    else:
        scored = posted.join(asked, "token").repartition(shares, "page_id")
    total = scored.groupBy("query_id", "page_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return _top(total, "query_id", [F.desc("score"), F.col("page_id")], k).select("query_id", "rank", "page_id", "score")


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in double precision; null where one has no length."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm)


#: Vectors in a block; blocks of items are compared with blocks of queries, so a task holds two of them and their scores.
BLOCK = 2048


def _rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero as Spark rounds; values near a half by their decimal digits."""
    out = np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0
    for i in np.flatnonzero(np.abs(np.abs(x) * 1e6 % 1 - 0.5) < 1e-4):
        out[i] = float(Decimal(repr(float(x[i]))).quantize(Decimal("0.000001"), ROUND_HALF_UP))
    return out


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of rows, summed in the order of their components, as :func:`cosine` does."""
    total = np.zeros(len(a))
    for d in range(a.shape[1]):
        total += a[:, d] * b[:, d]
    return total


def _blocks(df: DataFrame, key: str, name: str) -> DataFrame:
    """(d, ids, data, n): vectors of equal length, without null components, packed by BLOCK. Others have no score."""
    whole = df.where(F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull()) & (F.size("vector") > 0))
    rows = whole.select(F.col(key).alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    schema = T.StructType([T.StructField("d", T.IntegerType()), T.StructField("ids", T.ArrayType(rows.schema["id"].dataType)), T.StructField("data", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = np.asarray(pc.list_value_length(b.column(1)))
            for d in np.unique(sizes):
                same = b.filter(pa.array(sizes == d))
                for at in range(0, len(same), BLOCK):
                    part = same.slice(at, BLOCK)
                    part = part.take(pc.sort_indices(part.column(0), null_placement="at_start"))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(d)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), part.column(0)), pa.array([np.asarray(part.column(1).flatten(), np.float64).tobytes()], pa.binary())], names=["d", "ids", "data"]
                    )

    return scratch.materialize(rows.mapInArrow(pack, schema), name)


def _best(q: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, places, scores) of the ``k`` best of the vectors ``v`` for each of ``q``: exact cosines, rounded, ties to the earlier place.

    A product of matrices says which can be among them; it differs from the exact sums by far less than the margin.
    """
    with np.errstate(all="ignore"):
        nq, nv = np.sqrt(_dot(q, q)), np.sqrt(_dot(v, v))
        near = (q @ v.T) / (nq[:, None] * nv)
        odd = ~np.isfinite(near)
        near[odd] = np.inf  # looked at exactly
        for i in range(len(q)):
            row = near[i]
            at = np.arange(len(v))
            if len(v) > k:
                at = np.flatnonzero(row >= np.partition(row[~odd[i]], -k)[-k] - 2e-6) if (~odd[i]).sum() > k else at
            norm = nq[i] * nv[at]
            at, norm = at[~(norm <= 0)], norm[~(norm <= 0)]
            score = _dot(np.broadcast_to(q[i], (len(at), q.shape[1])), v[at]) / norm
            finite = np.isfinite(score)
            score[finite] = _rounded(score[finite])
            # as Spark orders: not a number before all numbers
            first = np.lexsort((at, -score, ~np.isnan(score)))[:k]
            yield i, at[first], score[first]


def vector_search(items: DataFrame, queries: DataFrame, k: int = 10, least: float | None = None, where: Column | None = None) -> DataFrame:
    """(query_id, rank, item_id, score): the ``k`` items (item_id, vector) nearest by cosine to each query (query_id, vector).

    ``where`` filters items before the search; ``least`` drops results under that score after the cut to ``k``. A stated
    query set is compared with all items, block by block; of each pair of blocks only the best ``k`` per query are shuffled.
    """
    if where is not None:
        items = items.where(where)
    asked = _blocks(queries, "query_id", "query-blocks").select("d", F.col("ids").alias("query_ids"), F.col("data").alias("q"))
    pairs = _blocks(items, "item_id", "item-blocks").join(asked, "d").select("d", "ids", "data", "query_ids", "q")
    kinds = [queries.schema["query_id"].dataType, items.schema["item_id"].dataType]
    schema = T.StructType([T.StructField("query_id", kinds[0]), T.StructField("item_id", kinds[1]), T.StructField("score", T.DoubleType())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                d, ids, query_ids = b.column(0)[r].as_py(), b.column(1)[r].values, b.column(3)[r].values
                q, v = (np.frombuffer(b.column(c)[r].as_buffer(), np.float64).reshape(-1, d) for c in (4, 2))
                found = list(_best(q, v, k))
                who = np.repeat([i for i, _, _ in found], [len(at) for _, at, _ in found])
                at, score = (np.concatenate([f[j] for f in found]) for j in (1, 2))
                yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(who, pa.int64())), ids.take(pa.array(at, pa.int64())), pa.array(score)], names=["query_id", "item_id", "score"])

    out = _top(pairs.mapInArrow(compare, schema), "query_id", [F.desc("score"), F.col("item_id")], k)
    return (out if least is None else out.where(F.col("score") >= least)).select("query_id", "rank", "item_id", "score")


def with_backfill(first: DataFrame, second: DataFrame, k: int, score: float = 0.5) -> DataFrame:
    """(query_id, rank, item_id, score): the first results, then those of the second not among them, at a fixed score."""
    fill = second.join(first.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti").withColumn("score", F.lit(score))
    both = first.withColumn("_src", F.lit(0)).unionByName(fill.withColumn("_src", F.lit(1))).withColumnRenamed("rank", "_r")
    return _top(both, "query_id", [F.col("_src"), F.col("_r"), F.col("item_id")], k).select("query_id", "rank", "item_id", "score")


def fused(token_hits: DataFrame, graph_scores: DataFrame, k: int = 20) -> DataFrame:
    """(query_id, rank, item_id, score): token score plus the weighted graph score (query_id, item_id, score)."""
    graph = graph_scores.select("query_id", "item_id", (F.col("score") * rules.GRAPH_WEIGHT).alias("score"))
    total = token_hits.select("query_id", "item_id", "score").unionByName(graph).groupBy("query_id", "item_id").agg(F.round(F.sum("score"), 6).alias("score"))
    return _top(total, "query_id", [F.desc("score"), F.col("item_id")], k).select("query_id", "rank", "item_id", "score")
