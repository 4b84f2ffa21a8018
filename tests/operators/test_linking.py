"""Mentions against the plain search of each name; alias classes and merged graphs against union-find and plain sums."""

from __future__ import annotations

import random
import re
from collections import Counter

from quire.operators import linking
from tests.cost import shuffled

WORDS = ["aa", "aaa", "AaA", "ab", "(a.b)", "é", "É", "字词", "字", "Ωσ", "ΣΩΣ", "ς", "straße", "STRASSE", "🙂a", "a\\Eb", "x", " "]


def plain_mentions(docs, names):
    out = []
    for d, text in docs:
        for n in {n for n in names if n}:
            out += [(d, n, m.group(), m.start(), m.end()) for m in re.finditer(re.escape(n), text or "", re.I)]
    return sorted(out)


def test_mentions(spark):
    r = random.Random(5)
    docs = [(1, None), (2, ""), (3, "a"), (4, "aaaaaaa"), (5, "ab" * 5000)] + [(10 + i, "".join(r.choice(WORDS) + r.choice(["", " "]) for _ in range(n))) for i, n in enumerate((3, 10, 40, 200, 1000))]
    names = ["aa", "aa", "a", "aaaaaaaa", "ababab", "AB", "(A.B)", "É", "字词", "ωσ", "σω", "strasse", "🙂A", "a\\eb", "nowhere at all", "", None, "\\Q", "x a"]
    got = linking.mentions(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(n,) for n in names], "name string"))
    assert sorted(map(tuple, got.collect())) == plain_mentions(docs, names)


def test_no_names(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    names = spark.createDataFrame([("",), (None,)], "name string")
    assert linking.mentions(docs, names).collect() == []
    assert linking.mentions(docs.limit(0), spark.createDataFrame([("a",)], "name string")).collect() == []


def plain_classes(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        if a is not None and b is not None:
            ra, rb = sorted((find(a), find(b)))
            up[rb] = ra
    return {x: find(x) for x in up}


def test_alias_classes(spark):
    r = random.Random(3)
    chain = [(k, k + 1) for k in range(1000, 1060)]
    star = [(5000, k) for k in range(5001, 5200)]
    loose = [(r.randrange(200), r.randrange(200)) for _ in range(120)]
    pairs = chain + star + loose + loose[:9] + [(7000, 7000), (None, 3), (8000, None)]
    r.shuffle(pairs)
    got = linking.alias_classes(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(got) == len({g.node for g in got}) and {g.node: g.root for g in got} == plain_classes(pairs)
    assert linking.alias_classes(spark.createDataFrame([], "a long, b long")).collect() == []


def test_merged(spark):
    nodes = [("b", "one", "x"), ("c", "two", "y"), ("c", "one", "y"), ("a", "two", None), ("z", None, None), (None, "one", "x"), ("q", "one", "k"), ("q", "one", "j")]
    edges = [("b", "z", "one", 2), ("c", "z", "two", 3), ("c", "b", "one", 1), ("z", "a", "one", None), (None, "a", "one", 9), ("far", "q", "one", 4), ("far", "q", "one", 4)]
    aliases = [("b", "c"), ("c", "a"), ("a", "d"), ("z", None)]
    n, e = linking.merged(spark.createDataFrame(nodes, "node string, source string, kind string"), spark.createDataFrame(edges, "u string, v string, source string, weight long"), spark.createDataFrame(aliases, "a string, b string"))
    assert sorted(tuple(x) for x in n.collect()) == [("a", "y", 3, ["one", "two"]), ("q", "j", 1, ["one"]), ("z", None, 1, [])]
    got = {(x.u, x.v): (x.weight, x.n_edges, x.sources) for x in e.collect()}
    assert got == {("a", "z"): (5, 2, ["one", "two"]), ("a", "a"): (1, 1, ["one"]), ("z", "a"): (None, 1, ["one"]), ("far", "q"): (8, 2, ["one"])}
    # nothing is lost: every edge with ends is counted once
    assert sum(v[1] for v in got.values()) == sum(Counter((u, v) for u, v, _, _ in edges if u and v).values())


def test_only_places_of_names_become_rows(spark):
    docs = spark.range(50).selectExpr("id AS doc_id", "concat_ws(' ', transform(sequence(1, 400), i -> concat(i * 37 + id, 'q')), 'The Name') AS text")
    names = spark.createDataFrame([("the name",), ("another name",)], "name string")
    found = []
    assert shuffled(spark, lambda: found.extend(linking.mentions(docs, names).collect())) < 500  # not every run of characters
    assert len(found) == 50 and {r.mention for r in found} == {"The Name"}
