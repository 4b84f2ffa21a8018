"""Approximate nearest neighbours by learned partitions.

A bounded sample's neighbour graph is cut into equal parts by recursive bisection; a small network learns to tell a
vector's part and deals every row to its most probable one. Tables beyond what so many parts can hold are cut finer by
the same network: a row's cell is its most probable part, the next probable, and so on for as many places as the number of
rows asks for, so that cells keep their size however large the table is. A query goes to its few most probable cells, as
many as reach the wanted recall on the sample, and their rows are ranked by exact distance. Cells larger than a block are
searched in blocks, so no task holds a cell or a query set of unknown size.

Equal vectors are searched once: of each, the smallest ids are kept, one more than the neighbours asked for, which no
query's answer can go beyond.

Defined cases: vectors that are null, zero, hold null or non-finite components, or differ in length from most of the
sample take no part; a row's own id is never its neighbour; fully repeated rows count once; distances that tie are
ordered by id; queries with fewer neighbours than asked for in their parts are searched in all parts; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire import scratch
from quire.llm.arrow import lean, small, spread

#: Rows the partitions are learned from, at most about; rows a cell should have, parts of the network at most; rows and
#: queries of a block; cells that each further place of a cell's name makes of one, about; cells a query visits at most.
SAMPLE, PART_ROWS, MAX_PARTS, BLOCK_ROWS, FANOUT, MAX_PROBES = 6_000, 800, 256, 8192, 8, 256
#: Neighbours in the sample's graph; share of them that the probed parts must hold.
GRAPH_K, RECALL = 10, 0.95


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """The k nearest others of each row by Euclidean distance, in blocks."""
    k = min(k, len(x) - 1)
    norm, out = (x * x).sum(1), np.zeros((len(x), k), np.int64)
    for lo in range(0, len(x), 1024):
        d = norm[None, :] - 2 * x[lo : lo + 1024] @ x.T
        d[np.arange(len(d)), np.arange(lo, lo + len(d))] = np.inf
        out[lo : lo + 1024] = np.argpartition(d, k - 1, axis=1)[:, :k] if k else 0
    return out


def bisect(graph: np.ndarray, depth: int, seed: int = 1) -> np.ndarray:
    """Equal parts 0 .. 2**depth - 1 of a graph's vertices, few edges between them.

    Each half-split orders the vertices by the second eigenvector of their subgraph, found by power iteration, and cuts
    at the median; a few passes then swap pairs of vertices that both have more neighbours on the other side.
    """
    rng, n = np.random.default_rng(seed), len(graph)
    part = np.zeros(n, np.int64)
    a = np.repeat(np.arange(n), graph.shape[1])
    b = graph.ravel()
    a, b = np.concatenate([a, b]), np.concatenate([b, a])
    for level in range(depth):
        for p in range(1 << level):
            own = np.flatnonzero(part == p)
            if len(own) < 2:
                part[own] = 2 * p + (1 << 40)
                continue
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            inside = (place[a] >= 0) & (place[b] >= 0)
            u, v = place[a[inside]], place[b[inside]]
            degree = np.bincount(u, minlength=len(own)) + 1e-9
            y = rng.normal(size=len(own))
            for _ in range(60):
                y = y - (y * degree).sum() / degree.sum()
                y = 0.5 * y + 0.5 * np.bincount(u, y[v], len(own)) / degree
                y /= np.linalg.norm(y) + 1e-30
            side = np.zeros(len(own), np.int64)
            side[np.argsort(y, kind="stable")[len(own) // 2 :]] = 1
            for _ in range(4):
                across = np.bincount(u, side[u] != side[v], len(own))
                gain = 2 * across - np.bincount(u, minlength=len(own))
                left = np.flatnonzero((side == 0) & (gain > 0))
                right = np.flatnonzero((side == 1) & (gain > 0))
                m = min(len(left), len(right)) // 2
                if not m:
                    break
                side[left[np.argsort(-gain[left], kind="stable")[:m]]] = 1
                side[right[np.argsort(-gain[right], kind="stable")[:m]]] = 0
            part[own] = 2 * p + side + (1 << 40)
        part -= 1 << 40
    return part


class Router:
    """A network of one hidden layer from vectors to parts, and how many cells a query must visit.

    A cell is named by its ``places`` most probable parts in order; with one place cells are parts.
    """

    def __init__(self, x: np.ndarray, k: int = GRAPH_K, n_parts: int = 16, recall: float = RECALL, seed: int = 2, places: int = 1):
        rng = np.random.default_rng(seed)
        depth = max(0, n_parts.bit_length() - 1)
        while depth and len(x) < 4 << depth:
            depth -= 1
        self.parts = 1 << depth
        self.centre, self.scale = x.mean(0), max(float(x.std()), 1e-12)
        d, h = x.shape[1], 128
        self.w1, self.b1 = rng.normal(size=(d, h)) / np.sqrt(d), np.zeros(h)
        self.w2, self.b2 = rng.normal(size=(h, self.parts)) / np.sqrt(h), np.zeros(self.parts)
        self.probes, self.places = 1, max(1, min(places, self.parts - 1))
        if self.parts == 1:
            return
        graph = neighbour_graph(x, k)
        part = bisect(graph, depth)
        self._train(x, part, rng)
        # probes: the fewest cells that hold the wanted share of the sample's own neighbours
        tried = rng.permutation(len(x))[:1000]
        dealt = self.cells(x)[:, 0]
        visited = self.cells(x[tried], min(MAX_PROBES, self.parts if self.places == 1 else MAX_PROBES))
        hit = visited[:, None, :] == dealt[graph[tried]][:, :, None]
        need = np.sort(np.where(hit.any(2), hit.argmax(2), visited.shape[1] - 1).ravel())
        self.probes = int(need[min(len(need) - 1, int(np.ceil(recall * len(need))))]) + 1

    def cells(self, x: np.ndarray, probes: int = 1) -> np.ndarray:
        """The ``probes`` most probable cells of each vector, best first (-1 where there are fewer).

        Places are filled one by one from the parts not yet named, each with its probability among those; only the best
        names go on to the next place.
        """
        z = self.logits(x)
        order = np.argsort(-z, 1, kind="stable")
        if self.places == 1 or probes == 1:
            top = order[:, : probes if self.places == 1 else self.places]
            return top if self.places == 1 else (top * self.parts ** np.arange(self.places - 1, -1, -1)).sum(1, keepdims=True)
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        width = min(self.parts, max(8, probes))
        out = np.full((len(x), probes), -1, np.int64)
        for row in range(len(x)):
            parts = order[row, :width]
            share = np.maximum(p[row, parts], 1e-30)
            names, used, left, score = np.zeros(1, np.int64), np.zeros((1, width), bool), np.ones(1), np.zeros(1)
            for _ in range(self.places):
                step = score[:, None] + np.log(share)[None, :] - np.log(np.maximum(left, 1e-30))[:, None]
                step[used] = -np.inf
                best = np.argsort(-step, None, kind="stable")[: 2 * probes]
                best = best[np.isfinite(step.ravel()[best])]
                a, b = np.divmod(best, width)
                score, names, left = step[a, b], names[a] * self.parts + parts[b], left[a] - share[b]
                used = used[a].copy()
                used[np.arange(len(a)), b] = True
            out[row, : min(probes, len(names))] = names[:probes]
        return out

    def _train(self, x: np.ndarray, part: np.ndarray, rng: np.random.Generator, epochs: int = 12, rate: float = 0.003) -> None:
        z = (x - self.centre) / self.scale
        weights = [self.w1, self.b1, self.w2, self.b2]
        state = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(z))
            for lo in range(0, len(z), 256):
                own = order[lo : lo + 256]
                hidden = np.maximum(z[own] @ self.w1 + self.b1, 0)
                logits = hidden @ self.w2 + self.b2
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(own)), part[own]] -= 1
                p /= len(own)
                back = (p @ self.w2.T) * (hidden > 0)
                step += 1
                for w, g, (m, v) in zip(weights, (z[own].T @ back, back.sum(0), hidden.T @ p, p.sum(0)), state, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.centre) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def packed(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (the vector as 64-bit floats) of the rows that take part, whatever their length."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(1)
            off = np.asarray(col.offsets)
            values = col.values
            ok = np.asarray(values.is_valid()) if values.null_count else np.ones(len(values), bool)
            x = np.asarray(values.fill_null(0.0) if values.null_count else values, np.float64)
            bad = np.concatenate([[0], np.cumsum(~(ok & np.isfinite(x)))])
            some = np.concatenate([[0], np.cumsum(x != 0)])
            good = (bad[off[1:]] == bad[off[:-1]]) & (some[off[1:]] > some[off[:-1]]) & np.asarray(col.is_valid())
            x = x + 0.0  # -0.0 and 0.0 are one value
            ids = b.column(0).cast(pa.int64())
            good &= np.asarray(ids.is_valid())
            keep = np.flatnonzero(good)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep)), pa.array([x[off[i] : off[i + 1]].tobytes() for i in keep.tolist()], pa.binary())], names=["vec_id", "v"])

    return rows.select(rows[id_col], rows[vector_col].cast("array<double>")).mapInArrow(lean(pack), "vec_id long, v binary")


def fit(rows: DataFrame, n_rows: int, sample: int = SAMPLE) -> Router | None:
    """A router from a hash sample of about ``sample`` packed rows; None where there are no rows."""
    share = min(1.0, sample / max(1, n_rows))
    got = rows.where((F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(1_000_000)) / 1e6) < share).select("v").collect() or rows.select("v").take(1)
    if not got:
        return None
    lengths, counts = np.unique([len(r[0]) for r in got], return_counts=True)
    size = lengths[counts.argmax()]
    x = np.unique(np.stack([np.frombuffer(bytes(r[0])) for r in got if len(r[0]) == size]), axis=0)
    wanted = max(1, n_rows / PART_ROWS)
    places = 1 + max(0, int(np.ceil(np.log(wanted / MAX_PARTS) / np.log(FANOUT))))
    return Router(x, n_parts=int(np.clip(2 ** round(np.log2(wanted)), 1, MAX_PARTS)), places=places)


def _nearest(q: np.ndarray, x: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each query, all rows that may be among its k nearest, and their exact distances."""
    norm_q, norm_x = (q * q).sum(1), (x * x).sum(1)
    d = norm_q[:, None] + norm_x[None, :] - 2 * q @ x.T
    slack = 1e-9 * (norm_q.max() + norm_x.max())
    kth = np.partition(d, k - 1, axis=1)[:, k - 1] if len(x) > k else np.full(len(q), np.inf)
    for i in range(len(q)):
        at = np.flatnonzero(d[i] <= kth[i] + slack)
        yield at, np.sqrt(((x[at] - q[i]) ** 2).sum(1))


def search(rows: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, router: Router | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` nearest found; ``is_query`` is a condition on the id column."""
    spark = rows.sparkSession
    chosen = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), is_query.alias("is_query"))
    base = scratch.materialize(packed(chosen, "vec_id", "embedding").withColumn("h", F.md5("v")), "vectors")
    n_rows = base.count()
    router = router or fit(base, n_rows, sample)
    out_schema = "query_id long, rank int, vec_id long, score double"
    if router is None:
        return spark.createDataFrame([], out_schema)
    base = base.where(F.length("v") == 8 * len(router.centre))
    asked = chosen.where("is_query").select("vec_id").distinct()
    queries = scratch.materialize(base.join(asked, "vec_id").distinct(), "vector-queries")
    # of equal vectors the smallest k + 1 ids: an answer needs k of them and may have to leave out its own
    kept = base.withColumn("_r", F.dense_rank().over(Window.partitionBy("h", "v").orderBy("vec_id"))).where(F.col("_r") <= k + 1)
    index = scratch.materialize(_deal(kept.groupBy("h", "v").agg(F.sort_array(F.collect_set("vec_id")).alias("ids")), router, 1, "h string, v binary, ids array<long>"), "vector-index")
    distinct = queries.select("h", "v").distinct()
    found = scratch.materialize(_probe(index, _deal(distinct, router, router.probes, "h string, v binary"), k), "vector-found")
    if router.parts > 1:
        # queries whose cells gave too few neighbours are searched everywhere, as if all rows were in one cell
        counts = found.groupBy("h").count()
        short = scratch.materialize(distinct.join(counts, "h", "left").where(F.coalesce("count", F.lit(0)) < min(k + 1, n_rows)).select("h", "v"), "vector-short")
        if short.take(1):
            whole = F.lit(0).cast("long").alias("part")
            again = _probe(index.select("h", "v", "ids", whole), short.select("h", "v", whole), k)
            found = found.join(short.select("h"), "h", "left_anti").unionByName(scratch.materialize(again, "vector-again"))
    # many queries can have one vector
    pairs = spread(queries.select("h", F.col("vec_id").alias("query_id")), found, ["h"]).where("query_id <> vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "h").orderBy("score", "vec_id"))).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _deal(rows: DataFrame, router: Router, probes: int, schema: str) -> DataFrame:
    """Each row once for every one of its ``probes`` most probable cells; column ``part``, the cell, follows."""
    shared = rows.sparkSession.sparkContext.broadcast(router)  # fixed size: dimension x 128 + 128 x MAX_PARTS weights

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            at = b.schema.get_field_index("v")
            best = r.cells(np.stack([np.frombuffer(x) for x in b.column(at).to_pylist()]), probes)
            row, rank = np.nonzero(best >= 0)
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in b.columns), pa.array(best[row, rank].astype(np.int64))], names=[*b.schema.names, "part"])

    return rows.mapInArrow(lean(deal), f"{schema}, part long")


def _probe(index: DataFrame, routed: DataFrame, k: int) -> DataFrame:
    """h, vec_id, score: the k + 1 nearest ids of each query among the rows of the cells it is routed to."""
    routed = scratch.materialize(routed, "vector-routed")
    # rows and queries of a part are cut into blocks; each block of rows meets each block of queries once
    sizes = index.groupBy("part").agg(F.count(F.lit(1)).alias("_n")).join(routed.groupBy("part").agg(F.count(F.lit(1)).alias("_q")), "part")
    blocks = small(scratch.materialize(sizes.select("part", F.ceil(F.col("_n") / BLOCK_ROWS).cast("int").alias("row_blocks"), F.ceil(F.col("_q") / BLOCK_ROWS).cast("int").alias("query_blocks")), "vector-blocks"))
    rows = index.join(blocks, "part").select("part", F.pmod(F.hash("h"), F.col("row_blocks")).alias("rb"), F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"), F.lit(1).alias("kind"), "h", "v", "ids")
    asks = routed.join(blocks, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("row_blocks") - 1)).alias("rb"), F.pmod(F.hash("h"), F.col("query_blocks")).alias("qb"), F.lit(0).alias("kind"), "h", "v", F.array().cast("array<long>").alias("ids"))
    met = asks.unionByName(rows).repartition("part", "rb", "qb").sortWithinPartitions("part", "rb", "qb", "kind")

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, q_h, q_v, q, best = None, [], [], None, []

        def result() -> pa.RecordBatch:
            h, ids, score = [], [], []
            for name, found in zip(q_h, best, strict=True):
                for d, i in sorted(found)[: k + 1]:
                    h.append(name)
                    ids.append(i)
                    score.append(d)
            return pa.RecordBatch.from_arrays([pa.array(h, pa.string()), pa.array(ids, pa.int64()), pa.array(score, pa.float64())], names=["h", "vec_id", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([np.asarray(b.column(i)) for i in range(4)], 1)
            cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                here = tuple(keys[lo, :3].tolist())
                if here != key:
                    if best:
                        yield result()
                    key, q_h, q_v, q, best = here, [], [], None, []
                vectors = [np.frombuffer(x) for x in b.column(5).slice(lo, hi - lo).to_pylist()]
                if keys[lo, 3] == 0:
                    q_h += b.column(4).slice(lo, hi - lo).to_pylist()
                    q_v += vectors
                    best += [[] for _ in vectors]
                elif q_v:
                    q = np.stack(q_v) if q is None else q
                    x, ids = np.stack(vectors), b.column(6).slice(lo, hi - lo).to_pylist()
                    for step in range(0, len(q), 512):
                        for i, (at, d) in enumerate(_nearest(q[step : step + 512], x, k + 1)):
                            own = best[step + i]
                            own += [(s, v) for j, s in zip(at.tolist(), d.tolist(), strict=True) for v in ids[j]]
                            best[step + i] = sorted(own)[: k + 1]
        if best:
            yield result()

    near = met.mapInArrow(lean(rank), "h string, vec_id long, score double")
    return near.withColumn("_r", F.row_number().over(Window.partitionBy("h").orderBy("score", "vec_id"))).where(F.col("_r") <= k + 1).drop("_r")
