"""Chunks, outlines and memory against plain versions."""

from __future__ import annotations

import math
import random
import re

import pytest

from quire.operators import chunking, memory
from tests.cost import shuffled

PATTERNS = [r"\n#{1,3}\s+", r"\n第 [一二三四五六七八九十\d]+[章节]", r"\nChapter\s+\d+", r"\nPART\s+[IVX\d]+"]


def plain_chunks(text, size, overlap):
    out, at = [], 0
    while at < len(text):
        end = min(at + size, len(text))
        if end < len(text):
            low, best = max(at, end - 2 * overlap), None
            region = text[low : min(end + overlap, len(text))]
            for p in PATTERNS:
                cuts = [low + m.start() for m in re.finditer(p, region, re.I) if low + m.start() > at + size // 2]
                best = cuts[-1] if cuts else best
            end = best or end
        start = max(0, at - overlap)
        out.append((len(out), start, end, text[start:end]))
        at = end
    return out


WORDS = ["word ", "字", "\n", "\n# ", "\n## a", "\n###  ", "\n#\n# b", "\n第 三章", "\n第 １2节", "\nchapter 7", "\nCHAPTER\n9", "\npart iv", "\nPart  X", "\n#### no", "é", "🙂"]


@pytest.mark.parametrize(("size", "overlap"), [(20, 10), (50, 7), (31, 0), (64, 40)])
def test_chunks(spark, size, overlap):
    r = random.Random(size)
    texts = [None, "", "x" * size, "x" * (size + 1), "x" * (size * 9 + 3)] + ["".join(r.choice(WORDS) for _ in range(n)) for n in (1, 5, 20, 60, 60, 200, 200, 2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", chunking.overlapping_chunks("text", size, overlap).alias("c")).orderBy("i").collect()
    for i, found in rows:
        assert [tuple(x) for x in found] == plain_chunks(texts[i] or "", size, overlap), i


def plain_outline(text):
    """A walk with a stack: (ordinal, level, title, parent, path, body)."""
    out, stack, fence, body = [], [], False, ""
    head = (0, 0, "", None, [])
    for line in re.split(r"(?<=\n)", text):
        fence ^= line.startswith("```")
        m = None if fence else re.match(r"(#{1,6})[ \t]", line)
        if m:
            out.append((*head, body))
            level, title = len(m[1]), re.sub(r"[ \t]+#+[ \t]*$", "", re.match(r"#{1,6}[ \t]+([^\n]*)", line)[1]).strip()
            while stack and stack[-1][1] >= level:
                stack.pop()
            head = (len(out), level, title, stack[-1][0] if stack else None, [t for _, _, t in stack] + [title])
            stack.append((len(out), level, title))
            body = ""
        else:
            body += line
    return [*out, (*head, body)]


def test_outlines(spark):
    r = random.Random(2)
    lines = ["# a", "## b ##", "### c", "###### f", "##### e", "#### d", "text", "", "#no", "####### no", "```", "\x00# x", "#\ttab "]
    texts = [None, "", "# a", "x", "```\n# no\n```\n# yes", "\n# late", "# a\n## b\n# c\n### d\n## e\n###### f\n### g"] + ["\n".join(r.choice(lines) for _ in range(n)) for n in (3, 10, 50, 300)] + ["\n".join(f"{'#' * r.randint(1, 6)} h{k}" for k in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = {}
    for x in chunking.outline(chunking.sections(docs, "k"), "k").orderBy("k", "ordinal").collect():
        got.setdefault(x.k, []).append((x.ordinal, x.level, x.title, x.parent, x.path, x.body))
    assert got == {k: plain_outline(t) for k, t in enumerate(texts) if t}


def plain_search(items, searches, k):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    said = {i: split(t) for i, t in items}
    mean, out = sum(map(len, said.values())) / len(said), []
    for s, phrases in searches:
        hits = []
        for p in phrases:
            w = split(p)
            if w:
                match = lambda x, j, w=w, p=p: x.startswith(w[j]) if p.strip().endswith("*") and j == len(w) - 1 else x == w[j]
                hits.append({i: n for i, t in said.items() if (n := sum(all(match(t[a + j], j) for j in range(len(w))) for a in range(len(t) - len(w) + 1)))})
        found = []
        for i in set.intersection(*map(set, hits)) if hits else []:
            weight = lambda h: max(math.log((len(said) - len(h) + 0.5) / (len(h) + 0.5)), 1e-6)
            found.append((-round(sum(weight(h) * h[i] * 2.2 / (h[i] + 1.2 * (0.25 + 0.75 * len(said[i]) / mean)) for h in hits), 6), i))
        out += [(s, n, i, -score) for n, (score, i) in enumerate(sorted(found)[:k], 1)]
    return out


def test_memory_search(spark):
    r = random.Random(4)
    pool = ["Alpha", "beta", "gamma-ray", "alp", "alphabet", "中文", "x1", "!"]
    items = [(i, " ".join(r.choice(pool) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(60, None), (61, "alpha alpha alpha")]
    searches = [(1, ["alpha"]), (2, ["alpha beta", "gamma ray"]), (3, ["alp*"]), (4, ["alpha alpha*", "中文"]), (5, []), (6, ["!"]), (7, ["none of these"]), (8, ["alpha alpha"]), (9, ["beta", "beta"]), (10, ["!", "x1 al*"])]
    rows = memory.search(spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(searches, "search_id int, phrases array<string>"), 7)
    got = sorted(tuple(x) for x in rows.collect())
    want = plain_search(items, searches, 7)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(got, want, strict=True))


def test_memory_search_shuffles_what_is_asked_for(spark):
    items = spark.range(400).selectExpr("id AS item_id", "concat_ws(' ', transform(sequence(1, 100), i -> concat('w', i * 7 + id % 5)), 'found', 'it') AS text")
    searches = spark.createDataFrame([(s, ["found it", "fou*"]) for s in range(20)], "search_id int, phrases array<string>")
    assert shuffled(spark, lambda: memory.search(items, searches).collect()) < 40_000  # a prefix does not send all 40,800 words


def test_memory_by_metadata(spark):
    rows = [(1, '{"a": "x", "b": 1}', 5), (2, '{"a": "x"}', 7), (3, "{broken", 9), (4, None, 9), (5, '{"a": "y"}', None), (6, '{"a": "x"}', 7)]
    items, wanted = spark.createDataFrame(rows, "item_id int, metadata string, at int"), spark.createDataFrame([("a", "x"), ("b", "1"), ("a", "x"), ("a", "z")], "key string, value string")
    got = sorted(tuple(r) for r in memory.by_metadata(items, wanted, 2).collect())
    assert got == [("a", "x", 1, 2), ("a", "x", 2, 6), ("b", "1", 1, 1)]
