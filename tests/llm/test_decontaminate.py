from __future__ import annotations

import itertools
import random

import pyarrow as pa

from quire.llm import decontaminate as d
from quire.llm import kernels
from tests.llm import edge


def brute(text, item, shortest=1):
    a, b = (text or "").lower().split(), (item or "").lower().split()
    if len(b) < shortest:
        return False
    n = min(d.WINDOW, len(b))
    need = d.WINDOW - d.SUBSTITUTIONS if n == d.WINDOW else n - d.allowed(n)
    return any(sum(a[i + k] == b[j + k] for k in range(n)) >= need for i in range(len(a) - n + 1) for j in range(len(b) - n + 1))


def test_masks_find_every_window():
    for misses in itertools.combinations(range(d.WINDOW), d.SUBSTITUTIONS):
        assert any(not any(o + i in misses for i in m) for m in d.masks() for o in range(d.WINDOW - m[-1]))


def test_masks_of_short_items_find_every_item():
    for n in range(8, d.WINDOW):
        for misses in itertools.combinations(range(n), d.allowed(n)):
            assert any(not any(o + i in misses for i in m) for m in d.masks(n, d.allowed(n)) for o in range(n - m[-1]))


def test_a_passage_repeated_thousands_of_times(monkeypatch):
    monkeypatch.setattr(d, "HITS", 1 << 16)
    item = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    text = " ".join([item] * 3000 + ["end"])
    p = d.Passages([(k, item) for k in range(5)] + [(9, "six seven eight nine")])
    data, offsets = kernels.strings(pa.array([text, "nothing here", item.replace("five", "zz")], pa.large_string()))
    got = p.overlaps(data, offsets)
    assert [(t, i) for t, i, *_ in got] == [(0, k) for k in range(6)] + [(2, k) for k in range(6)]
    assert [x[2:] for x in got if x[0] == 2] == [(0, 0, 14, 13)] * 5 + [(5, 0, 4, 4)]


def sample(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(30)]
    items = [(k, " ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 6, 8, 10, 12, 13, 14, 20, 40])))) for k in range(20)]
    docs = []
    for k in range(150):
        w = [r.choice(words) for _ in range(r.randint(0, 40))]
        it = r.choice(items)[1].split()
        w[len(w) // 2 : len(w) // 2] = [x if r.random() > r.choice([0, 0.1, 0.3]) else "zz" for x in it[r.randint(0, max(0, len(it) - 8)) :]]
        docs.append((k, " ".join(w)))
    return docs, items


def test_overlaps_are_those_of_brute_force(spark):
    docs, items = sample(4)
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([*items, (99, None), (98, "")], "item_id long, text string")
    want = {(i, k) for i, t in docs for k, x in items if brute(t, x)}
    assert {(r.doc_id, r.item_id) for r in d.overlaps(df, bench).collect()} == want
    blocks = d.overlaps(df, bench, block_words=50).collect()  # a benchmark beyond one block
    assert {(r.doc_id, r.item_id) for r in blocks} == want
    assert any(len(dict(items)[k].split()) < 4 for _, k in want)
    for shortest in (1, 4):
        bad = {i for i, t in docs for _, x in items if brute(t, x, shortest)}
        assert {r.doc_id for r in d.clean(df, bench, shortest=shortest).collect()} == {i for i, _ in docs} - bad


def test_awkward_rows(spark):
    bench = spark.createDataFrame([(1, "a QUIET house by the river was sold in the spring."), (2, None)], "item_id long, text string")
    got = d.overlaps(edge.table(spark), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.n_equal) for r in got) == [(1, 1, 11), (6, 1, 11), (6, 1, 11)]
    kept = d.clean(edge.table(spark), bench)
    assert kept.columns == edge.table(spark).columns
    assert kept.count() == len(edge.ROWS) - 3
    assert d.overlaps(edge.empty(spark), bench).collect() == []
    assert d.overlaps(edge.table(spark), bench.limit(0)).collect() == []
    assert d.clean(edge.table(spark), bench.limit(0)).count() == len(edge.ROWS)
