from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest

from quire.llm import arrow, jaccard
from quire.llm.components import components
from tests.llm import edge

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(rows, n):
    out = []
    for text in rows:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
        out.append(frozenset(tuple(w[j : j + n]) for j in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def brute(ids, texts, n, share):
    sets, root = sets_of(texts, n), list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= share * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = defaultdict(lambda: None)
    for k, i in enumerate(ids):
        r = find(k)
        if i is not None and (least[r] is None or i < least[r]):
            least[r] = i
    return sorted((i, len(s), i if not s else least[find(k)] if least[find(k)] is not None else i) for k, (i, s) in enumerate(zip(ids, sets, strict=True)) if i is not None)


@pytest.mark.parametrize(("n", "share"), [(3, 90), (5, 80), (2, 70)])
def test_near_copies(spark, n, share):
    r = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size in (1, 2, 3, 5, 8, 12, 20, 40, 95, 120, 150, 175, 200, 400):
        base = [r.choice(vocabulary) for _ in range(size)]
        for _ in range(14):
            copy = [w if r.random() > r.choice([0, 0.002, 0.01, 0.03]) else "zz%d" % r.randrange(5) for w in base]
            texts.append(" ".join(copy).upper() if r.random() < 0.2 else " ".join(copy))
    texts += [None, "", "  ", *texts[:5]]
    ids = list(range(len(texts)))
    r.shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(df, n, share).collect())
    assert got == brute(ids, texts, n, share)


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.collect()
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(docs, 3, 90).collect())
    assert got == brute([r.doc_id for r in rows], [r.text for r in rows], 3, 90)


def test_awkward_rows(spark):
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(edge.table(spark), 3, 90).collect() if x.doc_id is not None)
    assert got == brute([r[0] for r in edge.ROWS], [r[1] for r in edge.ROWS], 3, 90)
    assert jaccard.jaccard_components(edge.empty(spark), 3, 90).collect() == []
    kept = jaccard.one_of_each(edge.table(spark), 3, 90)
    assert kept.columns == edge.table(spark).columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, [1, 2, 3, 4, 5, None, 8, 9, 10]))
    assert jaccard.one_of_each(edge.empty(spark)).collect() == []


def test_sketches_never_exceed_the_difference():
    rng = np.random.default_rng(5)
    for _ in range(50):
        a = np.unique(rng.integers(0, 1 << 62, 300, dtype=np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.1], rng.integers(0, 1 << 62, 20, dtype=np.uint64)]))
        bits = sum(bin(int(x) & (2**64 - 1)).count("1") for x in jaccard.sketch(a) ^ jaccard.sketch(b))
        assert bits <= len(np.setxor1d(a, b))


@pytest.mark.parametrize("share", [55, 70, 80, 90])
def test_linked_sets_share_a_signature_in_every_family(share):
    rng, cuts, tried = np.random.default_rng(6), jaccard.Cuts(share), 0
    for size in [*range(1, 60), *range(94, 176, 9), 1000]:
        for _ in range(8):
            a = np.unique(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
            most = max(1, size * (100 - share) // 100)
            drop = rng.integers(0, most + 1)
            b = np.unique(np.concatenate([a[rng.permutation(len(a))[drop:]], rng.integers(0, 1 << 63, rng.integers(0, most + 1), dtype=np.uint64)]))
            both = len(np.intersect1d(a, b))
            if len(b) and both * (100 + share) >= share * (len(a) + len(b)) and not np.array_equal(a, b):
                tried += 1
                for family in range(3):
                    assert len(np.intersect1d(jaccard.signatures(a, cuts, family), jaccard.signatures(b, cuts, family)))
    assert tried > 100


@pytest.mark.parametrize("share", range(51, 101))
def test_fragments_of_every_size_class(share):
    cuts = jaccard.Cuts(share)
    for c in range(cuts.size_class(20_000) + 1):
        m = cuts.fragments(c)
        assert m == 0 or cuts.differ(cuts.upper(c)) < m <= 64 * (cuts.lower[c] + cuts.upper(c))


def test_strangers_that_share_a_phrase_do_not_meet():
    rng, cuts = np.random.default_rng(7), jaccard.Cuts(80)
    tiny = [np.unique(rng.integers(0, 1 << 63, 6, dtype=np.uint64)) for _ in range(4000)]
    sigs = np.concatenate([jaccard.signatures(s, cuts) for s in tiny])
    assert len(np.unique(sigs)) == len(sigs)


def test_signatures_are_few():
    rng = np.random.default_rng(9)
    for share, most in ((80, 0.45), (90, 0.2)):
        s = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)) for n in range(200, 2000, 37)]
        cuts = jaccard.Cuts(share)
        assert sum(len(jaccard.signatures(x, cuts)) for x in s) <= most * sum(map(len, s))


@pytest.mark.parametrize(("most", "words"), [(5, 40), (1 << 14, 40)])
def test_common_phrase_with_few_copies(spark, monkeypatch, most, words):
    """Short texts around one phrase: buckets of the phrase are split or compared in blocks, and no copy among them is lost."""
    monkeypatch.setattr(jaccard, "BUCKET_OUT", most)
    monkeypatch.setattr(jaccard, "BLOCK_WORDS", words)
    r = random.Random(4)
    phrase = "all rights are reserved by the owner of this small text".split()
    texts = []
    for _ in range(150):
        own = [f"x{r.randrange(5000)}" for _ in range(r.randrange(2, 8))]
        texts.append(" ".join(phrase + own))
        if r.random() < 0.2:
            texts.append(" ".join(phrase + own[:-1]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((x.doc_id, x.n_shingles, x.component_id) for x in jaccard.jaccard_components(df, 3, 80).collect())
    assert got == brute(range(len(texts)), texts, 3, 80)


def test_spread_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(arrow, "HOT_ROWS", 5)
    rows = [(k, i) for k, n in ((1, 50), (2, 3), (None, 20), (3, 9)) for i in range(n)]
    left = spark.createDataFrame(rows, "k long, i int")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (4, "c"), (1, "d")], "k long, v string")
    for how in ("inner", "left"):
        got = sorted(map(str, arrow.spread(left, right, ["k"], how).collect()))
        assert got == sorted(map(str, left.join(right, ["k"], how).collect()))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {i: 1 for i in range(1, 61)} | {100: 100, 101: 100}
    assert components(links.limit(0)).collect() == []
