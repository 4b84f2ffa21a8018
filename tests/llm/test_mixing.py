from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import functions as F

from quire.llm import mixing
from tests.llm import edge


def plain_targets(sizes: dict, epochs: int = 3) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, target, free = float(sum(sizes.values())), {}, set(order)
    while free:
        rest, share = total - sum(target.values()), sum(weight[s] for s in free)
        over = [s for s in free if rest * weight[s] / share > epochs * sizes[s]]
        if not over:
            return target | {s: rest * weight[s] / share for s in free}
        for s in over:
            target[s] = float(epochs * sizes[s])
            free.remove(s)
    return target


def words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def check(docs):
    rows = docs.collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r.source] += words(r.text)
    want = plain_targets(sizes)
    got = mixing.mix(docs).collect()
    assert sum(g.m for g in got) == len(rows)
    by_text = {(r.doc_id, r.source): words(r.text) for r in rows}
    assert all(0 <= g.copies <= 3 and g["size"] in by_text.values() for g in got)
    for g in got:
        assert abs(g.target - min((abs(t - g.target), t) for t in want.values())[1]) < 1e-6 * max(1, g.target)
    taken = defaultdict(int)
    target = {}
    largest = max(sizes.values(), default=0) and max(words(r.text) for r in rows)
    for g in got:
        taken[g.source_size, g.target] += g["size"] * g.copies * g.m
        target[g.source_size, g.target] = g.target
    for k, t in target.items():
        assert abs(taken[k] - t) <= 2 * largest + 1
    return got


def test_targets_and_totals(spark):
    check(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_awkward_rows(spark):
    got = check(edge.table(spark))
    assert sorted(x.m for x in got)[-1] == 2  # the repeated row shares one decision
    assert mixing.mix(edge.empty(spark)).collect() == []


def test_reruns_agree_and_rows_come_back_as_often_as_taken(spark):
    docs = edge.table(spark)
    a, b = (sorted(map(str, mixing.mix(docs.repartition(n)).collect())) for n in (1, 5))
    assert a == b
    rows = mixing.mixed(docs).collect()
    copies = sum(r.copies * r.m for r in mixing.mix(docs).collect())
    assert len(rows) == copies
    assert mixing.mixed(docs).columns == docs.columns


def test_copies_are_those_of_a_sorted_list(spark):
    """Which copies are taken, against fair queueing over plain lists."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = mixing.mix(docs).withColumn("key", F.xxhash64(F.lit(17), "sig")).collect()
    by = {(r.doc_id, r.source) for r in docs.collect()}
    source = {i: s for i, s in by}
    order = sorted({s for _, s in by}, key=lambda s: (s is None, s or ""))
    copies = []
    for rank, s in enumerate(order):
        own, at = sorted((g for g in got if source[g.doc_id] == s), key=lambda g: (g.key, g.doc_id, g.sig)), 0
        total = sum(g["size"] * g.m for g in own)
        for g in own:
            at += g["size"] * g.m
            copies += [((e * total + at) / (1 + rank % 3), rank, e, g.key, g.doc_id, g.sig, g["size"] * g.m) for e in range(3)]
    budget, taken, spent = sum(g["size"] * g.m for g in got), defaultdict(int), 0
    for c in sorted(copies):
        spent += c[6]
        taken[c[4], c[5]] += spent <= budget
    assert {(g.doc_id, g.sig): g.copies for g in got} == dict(taken)
