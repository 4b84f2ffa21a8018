"""Zones, sections, findings and reports of Markdown against a plain walk over the lines."""

from __future__ import annotations

import random
import re

from quire.functions import rules
from quire.operators import markdown
from tests.cost import shuffled


def walk(text):
    rows = text.split("\n")
    close = next((i for i, x in enumerate(rows) if i >= 2 and x.startswith("---")), -1) if rows[0] == "---" else -1
    code, section = False, None
    for i, x in enumerate(rows):
        if i <= close:
            zone = "front"
        elif x.startswith("```"):
            zone, code = "code", not code
        else:
            zone = "code" if code else "body"
        if zone == "body" and x.startswith("## "):
            section = x[3:].strip(" ")
        yield i + 1, x, zone, section


def findings(text):
    for n, x, zone, section in walk(text):
        for w in rules.MARKDOWN_PLACEHOLDERS:
            if k := len(re.findall(re.escape(w), x)):
                yield n, zone, section, "placeholder", w, k
        m = re.match(r"\s*\|\s*(\d+[-\d]*)\s*\|", x)
        if m and zone == "body" and section and "章节结构" in section and re.match(r"\d+-\d+", m[1]):
            yield n, zone, section, "merged_chapter", m[1], 1


GOOD = "---\ntitle: t\nauthor: a\ndiscipline: d\ntags: []\n---\n" + "\n".join(f"## {i} {s}\n\n| 1 | x |\n| 2 | y |" for i, s in enumerate(rules.MARKDOWN_SECTIONS)) + "\n**底层逻辑**：\n\n- **前提假设**：a\n- **推理链条**：b\n- **核心结论**：c\n[[x]] [[y]]"
PARTS = ["---", "---", "----x", "```", "```json", "## 章节结构总览", "## 核心概念 ", "##no", "### 学习路径", "| 1-3 | x |", " |12| x", "|  4-5-6  |", "| a | 7 |", "待补充 TBD TBD", "（完整内容未提供）", "title: N/A", "", "text"]


def texts():
    r = random.Random(11)
    made = ["\n".join(r.choice(PARTS) for _ in range(n)) for n in (1, 2, 3, 8, 20, 20, 60, 60, 3000)]
    return [None, "", "---", "---\n---", "---\n\n---", "---\nx\n---y\n```\n## a", GOOD, GOOD.replace("| 2 |", "| 2-9 |"), GOOD.replace("author", "by")] + made + ["---\n" + m for m in made]


def table(spark):
    return spark.createDataFrame(list(enumerate(texts())), "i int, text string")


def test_lines(spark):
    got = sorted(tuple(r) for r in markdown.lines(table(spark), "i").select("i", "line", "content", "zone", "section").collect())
    want = [(i, *x) for i, t in enumerate(texts()) if t for x in walk(t)]
    assert got == want


def test_findings(spark):
    got = {tuple(r) for r in markdown.line_findings(markdown.lines(table(spark), "i"), "i").collect()}
    want = [(i, *x) for i, t in enumerate(texts()) if t for x in findings(t)]
    assert got == set(want) and len(want) == len(set(want))


def test_reports(spark):
    rows = {r.i: r for r in markdown.reports(table(spark), "i").collect()}
    all_missing = ["front matter", *rules.MARKDOWN_FIELDS, *rules.MARKDOWN_SECTIONS]
    assert len(rows) == len(texts()) and rows[0].missing == rows[1].missing == all_missing and rows[0].total_chars == rows[0].total_lines == 0
    good, merging, anonymous = rows[6], rows[7], rows[8]
    assert good.valid and (good.missing, good.first, good.merged, good.chapters, good.logic_blocks, good.book_links) == ([], [], [], 2, 1, 2)
    assert not merging.valid and merging.merged == ["2-9"] and merging.missing == [] and not anonymous.valid and anonymous.missing == ["author"]
    for i, t in enumerate(texts()):
        found = [f for f in findings(t)] if t else []
        words = sorted((f[0], f[4]) for f in found if f[3] == "placeholder")
        assert rows[i].placeholders == sum(f[5] for f in found if f[3] == "placeholder")
        assert rows[i].first == [f"{n}: {w}" for n, w in words[:5]] and rows[i].merged == [f[4] for f in found if f[3] == "merged_chapter"]
        assert (rows[i].total_chars, rows[i].total_lines) == (len(t or ""), (t or "").count("\n"))


def test_empty_table(spark):
    assert markdown.reports(table(spark).limit(0), "i").collect() == []


def test_reports_deal_out_few_lines(spark):
    body = "\n".join(f"plain words of line {i}, with a title" for i in range(400))
    long = spark.createDataFrame([(i, body) for i in range(20)] + [(20, "---\ntitle: x\n---\n" + body)], "i int, text string")
    counts = []
    run = lambda: counts.extend(markdown.reports(long, "i").collect())
    assert shuffled(spark, run) <= 20 + 404 and len(counts) == 21
    assert {r.i: r.missing[0] for r in counts}[20] == "author" and all(r.total_lines == 399 for r in counts if r.i < 20)


def test_reports_without_keys(spark):
    rows = markdown.reports(spark.createDataFrame([(None, "TBD"), (None, "a\nb"), (None, None)], "i int, text string"), "i").collect()
    assert sorted((r.total_lines, r.placeholders) for r in rows) == [(0, 0), (0, 1), (1, 0)]
