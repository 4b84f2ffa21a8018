from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import vectors


def brute(rows, k, dim):
    ok = [(i, tuple(v)) for i, v in rows if i is not None and v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    ok = sorted(set(ok))
    out = {}
    for i, v in ok:
        if i % 4 == 0:
            near = sorted((float(np.sqrt(((np.array(v) - np.array(w)) ** 2).sum())), j) for j, w in ok if j != i)[:k]
            out[i] = near
    return out


def test_awkward_rows_are_exact(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(60)]  # many equal vectors
    rows += [(900, None), (904, [0.0] * 6), (908, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (912, [float("nan")] * 6), (916, [1.0]), (8, rows[8][1]), (None, rows[5][1])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, h string, part int")
    got = {}
    for r in vectors.search(df, F.col("vec_id") % 4 == 0, k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    assert got == brute(rows, 5, 6)


def test_few_and_no_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (4, [0.0, 1.0]), (5, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in vectors.search(df, F.col("vec_id") % 4 == 0).orderBy("query_id", "rank").collect()]
    assert [(q, k, v) for q, k, v, _ in got] == [(0, 1, 4), (0, 2, 5), (4, 1, 5), (4, 2, 0)]
    assert vectors.search(df.limit(0), F.col("vec_id") % 4 == 0).collect() == []


@pytest.mark.parametrize(("parts", "part_rows"), [(256, 800), (8, 20)])
def test_recall_against_brute_force(spark, monkeypatch, parts, part_rows):
    """Also where the table is far beyond what the network's parts can hold, and cells have several places."""
    monkeypatch.setattr(vectors, "MAX_PARTS", parts)
    monkeypatch.setattr(vectors, "PART_ROWS", part_rows)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.orderBy("vec_id").collect()
    x, ids = np.stack([r.embedding for r in rows]).astype(float), [r.vec_id for r in rows]
    hit = total = 0
    found = {}
    for r in vectors.search(table, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    for k, i in enumerate(ids):
        if i % 100 == 0:
            d = ((x - x[k]) ** 2).sum(1)
            d[k] = np.inf
            best = {ids[j] for j in np.argsort(d)[:10]}
            hit += len(best & found[i])
            total += 10
    assert hit / total >= 0.9


def test_cells_keep_their_size():
    rng = np.random.default_rng(5)
    router = vectors.Router(rng.normal(size=(600, 8)), n_parts=8, places=3)
    x = rng.normal(size=(5000, 8))
    cells, visits = router.cells(x)[:, 0], router.cells(x[:50], 20)
    assert np.bincount(np.unique(cells, return_inverse=True)[1]).max() < len(x) / 16
    assert (visits[:, 0] == cells[:50]).all()
    assert all(len(set(v.tolist())) == 20 for v in visits)


def test_parts_are_balanced():
    x = np.random.default_rng(3).normal(size=(1024, 8))
    part = vectors.bisect(vectors.neighbour_graph(x, 10), 3)
    assert np.bincount(part).tolist() == [128] * 8
