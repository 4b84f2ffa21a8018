"""The pipeline's stages against plain versions on the smallest tables."""

from __future__ import annotations

import re
import zlib

import corpus_pipeline as p
from tests.llm import edge
from tests.llm.test_decontaminate import brute as overlaps
from tests.llm.test_jaccard import brute as near

DIR = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = docs.collect()
    one = p.identify_language(spark, docs, DIR).cache()
    assert one.columns == docs.columns
    kept = {r.doc_id for r in one.collect()}
    assert kept == {r.doc_id for r in rows if re.search(r"[^\W\d_]", r.text or "")}
    two = p.drop_near_copies(spark, one, DIR).cache()
    a = [r for r in rows if r.doc_id in kept]
    want = {c for _, _, c in near([r.doc_id for r in a], [r.text for r in a], p.SHINGLE, p.SIMILARITY)}
    assert {r.doc_id for r in two.collect()} == want
    three = p.drop_benchmark(spark, two, DIR).cache()
    bench = spark.read.parquet(f"{DIR}/benchmark.parquet").collect()
    want = {r.doc_id for r in two.collect() if not any(overlaps(r.text, b.text) for b in bench)}
    assert {r.doc_id for r in three.collect()} == want
    four = p.mix_sources(spark, three, DIR).cache()
    assert four.columns == docs.columns
    assert {r.doc_id for r in four.collect()} <= want
    five = p.write_tokens(spark, four, DIR).collect()
    assert sorted(r.doc_id for r in five) == sorted(r.doc_id for r in four.collect())
    assert sorted(map(tuple, five)) == sorted(map(tuple, p.run(spark, DIR).collect()))


def test_stages_take_awkward_rows(spark):
    docs = edge.table(spark)
    ids = {}
    for name, stage in p.STAGES:
        out = stage(spark, docs, DIR)
        assert stage(spark, edge.empty(spark), DIR).count() == 0
        rows = out.collect()
        ids[name] = sorted((r.doc_id for r in rows), key=str)
        if name != "tokens":
            assert out.columns == docs.columns
    # null, empty, letterless texts go, and what is in no language learned here; the repeated row keeps both its copies
    learned = [r[0] for r in edge.ROWS if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 and re.search(r"[^\W\d_]", r[1] or "")]
    assert {2, 3, 4, 8}.isdisjoint(ids["language"]) and set(learned) <= set(ids["language"])
    assert ids["language"].count(6) in (0, 2)
    # 6, twice, has the words of 1; texts without words stay
    assert ids["near_copies"] == sorted([1, 2, 3, 4, 5, None, 8, 9, 10], key=str)
    assert ids["benchmark"] == sorted((r[0] for r in edge.ROWS), key=str)
    assert set(ids["mix"]) <= {r[0] for r in edge.ROWS} and max(map(ids["mix"].count, set(ids["mix"]) - {6})) <= 3
    assert ids["mix"].count(6) % 2 == 0
    assert ids["tokens"] == sorted((r[0] for r in edge.ROWS), key=str)
