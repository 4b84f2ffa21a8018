"""Token search against a plain version; tasks that follow the sums, and few shuffled rows."""

from __future__ import annotations

import math
import random

from quire import scratch
from quire.operators import retrieval
from tests.cost import shuffled

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "books", "reader"]


def made():
    r = random.Random(5)
    pages = [(i, r.choice([None, "Alphabet", "omega books", "beta"]), r.choice([None, ""]) if i % 17 == 0 else " ".join(r.choices(WORDS, k=r.randint(1, 6)))) for i in range(150)]
    asked = [(i, " ".join(r.sample(WORDS, 3))) for i in range(30)] + [(30, None), (31, "nowhere"), (32, "alpha")]
    return pages, asked


def plain(pages, asked, k):
    has = {i: set((t or "").lower().split()) | set((n or "").lower().split()) for i, n, t in pages}
    idf = {w: math.log((len(pages) - df + 0.5) / (df + 0.5) + 1) for w in {w for x in has.values() for w in x} for df in [sum(w in x for x in has.values())]}
    out = []
    for q, text in asked:
        words = set((text or "").split())
        scores = {i: sum(idf[w] for w in words & has[i]) + (2.0 if n and any(w in n for w in words) else 0.0) for i, n, _ in pages}
        best = sorted((-round(s, 6), i) for i, s in scores.items() if s)[:k]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    return out


def test_token_search(spark, monkeypatch):
    pages, asked = made()
    tables = spark.createDataFrame(pages, "page_id long, title string, text string"), spark.createDataFrame(asked, "query_id long, text string")

    def found():
        return sorted((r.query_id, r.rank, r.page_id, round(r.score, 5)) for r in retrieval.token_search(*tables, k=5).collect())

    want = [(q, rank, i, round(s, 5)) for q, rank, i, s in plain(pages, asked, 5)]
    assert found() == want
    monkeypatch.setattr(scratch, "TASK_ROWS", 100)
    assert found() == want
    monkeypatch.setattr(retrieval, "ASKED", 0)
    assert found() == want


def test_pairs_are_not_shuffled(spark):
    pages = spark.createDataFrame([(i, "t", "alpha beta gamma") for i in range(300)], "page_id long, title string, text string").coalesce(1)
    asked = spark.createDataFrame([(i, "alpha beta gamma") for i in range(100)], "query_id long, text string")
    rows = shuffled(spark, lambda: retrieval.token_search(pages, asked, k=2).collect())
    assert rows < 300 * 100 / 4  # the pairs of queries and pages are 30,000
