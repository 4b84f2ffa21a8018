"""Damaged and mistyped model output with known answers; axioms of the manifest on books that break them and books that do not."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from quire.operators import manifests, normalising

DAMAGED = [
    ('{"a": 1}', "parsed", {"a": 1}),
    ('  {"a": "// no, }"}', "parsed", {"a": "// no, }"}),
    ('Sure:\n```json\n{"a": [1, 2]}\n```\nDone.', "extracted", {"a": [1, 2]}),
    ('{"a": 1, /* why */ "b": [1, 2, ], // because\n}', "mended", {"a": 1, "b": [1, 2]}),
    ('{**"a"**: "x, }", "b": "http://y",}', "mended", {"a": "x, }", "b": "http://y"}),
    ('{"a": {"b": "c"}', "closed", {"a": {"b": "c"}}),
    ('```json\n{"a": [{"b": "say \\"hi', "closed", {"a": [{"b": 'say "hi'}]}),
    ('{"a": ["x", "y",', "closed", {"a": ["x", "y"]}),
    ('{"a": "// open', "closed", {"a": "// open"}),
    ('{"a": "x", "b":', "cut", {"a": "x"}),
    ('{"a": "x", "b', "cut", {"a": "x"}),
    ('{"a": "x", "b": tru', "cut", {"a": "x"}),
    ("", "none", None),
    (None, "none", None),
    ("no object", "none", None),
    ("[1, 2]", "none", None),
]


def test_documents(spark):
    rows = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(DAMAGED)], "i int, t string")
    got = {r[0]: (r[1], r[2]) for r in rows.select("i", normalising.document("t").alias("d")).select("i", "d.status", F.to_json("d.document")).collect()}
    for i, (text, status, doc) in enumerate(DAMAGED):
        assert (got[i][0], json.loads(got[i][1]) if got[i][1] else None) == (status, doc), text


def test_long_texts(spark):
    doc = {"a": ["x" * 50] * 20_000, "b": '"\\' * 20_000}
    whole = json.dumps(doc)
    rows = spark.createDataFrame([(0, whole), (1, whole[:-1]), (2, "so: " + whole)], "i int, t string")
    got = dict(rows.select("i", normalising.document("t").alias("d")).select("i", F.struct("d.status", F.to_json("d.document"))).collect())
    assert [got[i][0] for i in range(3)] == ["parsed", "closed", "extracted"] and all(json.loads(x[1]) == doc for x in got.values())


def book_of(spark, *docs):
    rows = spark.createDataFrame([(i, d if d is None or isinstance(d, str) else json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "i int, t string")
    return [r.b.asDict(True) for r in rows.select("i", normalising.book(F.try_parse_json("t")).alias("b")).orderBy("i").collect()]


def test_defaults(spark):
    for b in book_of(spark, None, "{}", {"metadata": None, "chapters": "none", "core_concepts": {"a": 1}, "learning_path": 3, "book_network": [], "critical_analysis": "x"}):
        assert b["metadata"] == {"title": "Unknown", "author": "Unknown", "author_intro": "", "discipline": "哲学"}
        assert b["chapters"] == b["core_concepts"] == b["key_quotes"] == [] and b["book_network"] == {}
        assert b["learning_path"] == {"beginner": [], "intermediate": [], "advanced": [], "practice": []}
        assert b["critical_analysis"]["core_doubts"] == [] and b["critical_analysis"]["ethical_boundaries"] == {"reasonable": "", "dangerous": "", "institutional_safeguards": ""}


def test_types_mended(spark):
    (b,) = book_of(
        spark,
        {
            "metadata": {"title": ["A", "B"], "author": [], "author_intro": "待补充", "discipline": 7, "more": 1},
            "core_concepts": ["name only", "TBD", 4, None, {"name": "n", "core_drivers": "a、 b 、", "development_stages": "start", "definition": "（待分析）"}, {"core_drivers": ["x", "略", None, 2], "development_stages": ["s", {"name": "t", "description": "暂无"}]}],
            "key_insights": [{"title": "i", "multi_perspectives": "seen otherwise"}, {"multi_perspectives": {"p": "q", "r": "TODO later", "s": None}}],
            "critical_analysis": {"core_doubts": ["why", {"question": "q", "analysis": "a"}], "ethical_boundaries": "fine"},
            "learning_path": {"beginner": "one", "advanced": ["x", "待完成"]},
            "key_quotes": ["said", {"text": "无题是一首诗，不是占位符而已"}],
        },
    )
    assert b["metadata"] == {"title": "A", "author": "Unknown", "author_intro": "", "discipline": "7"}
    first, second, third = b["core_concepts"]
    assert first["name"] == "name only" and first["definition"] == "" and first["core_drivers"] == first["development_stages"] == []
    assert (second["core_drivers"], second["definition"], second["development_stages"]) == (["a", "b"], "", [{"name": "start", "description": ""}])
    assert third["core_drivers"] == ["x", "2"] and third["development_stages"] == [{"name": "s", "description": ""}, {"name": "t", "description": ""}]
    assert [i["multi_perspectives"] for i in b["key_insights"]] == [{"其他视角": "seen otherwise"}, {"p": "q", "r": "", "s": ""}]
    assert b["critical_analysis"]["core_doubts"] == [{"question": "why", "analysis": ""}, {"question": "q", "analysis": "a"}]
    assert b["critical_analysis"]["ethical_boundaries"]["reasonable"] == "fine"
    assert b["learning_path"] == {"beginner": ["one"], "intermediate": [], "advanced": ["x"], "practice": []}
    assert [q["text"] for q in b["key_quotes"]] == ["said", "无题是一首诗，不是占位符而已"]


def plain_placeholder(text):
    from quire.functions.rules import OUTPUT_PLACEHOLDERS as words

    text = text.strip()
    return any(text in (w, f"（{w}）") or (text.startswith(w) and len(text) < len(w) + 10) for w in words)


def test_placeholders(spark):
    texts = ["无", " 无 ", "略" + "x" * 9, "略" + "x" * 10, "略" + "x" * 9 + " ", "（略）", "（略", "（无）", "（无）x", "x 无", "TBD\nlater", "N/A", "n/a", "", "待补充" + "字" * 9, "待补充" + "字" * 10, "🙂无", "无" + "🙂" * 9, "无" + "🙂" * 10]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", F.col("t").rlike(normalising.PLACEHOLDER))
    for t, found in rows.collect():
        assert found == plain_placeholder(t), t


GOOD = {
    "metadata": {"title": "T", "author": "A"},
    "time_background": {"macro_background": "m"},
    "critical_analysis": {"feminist_perspective": "f" * 51, "postcolonial_perspective": "p" * 51},
    "chapters": [{"chapter_number": str(n), "title": f"Part {n}", "core_argument": "c" * 60, "underlying_logic": "前提假设：" + "l" * 60} for n in range(1, 5)],
    "core_concepts": [{"name": "k", "definition": "d" * 30, "deep_meaning": "d" * 30, "underlying_logic": "核心结论: x"}],
    "key_insights": [{"description": "own words"}],
    "key_cases": [],
    "key_quotes": [{"text": "q", "chapter": "1", "background_context": "b", "underlying_logic": "u"}],
}


def changed(path, value):
    doc = json.loads(json.dumps(GOOD))
    at = doc
    for step in path[:-1]:
        at = at[step]
    if value is None:
        del at[path[-1]]
    else:
        at[path[-1]] = value
    return doc


BROKEN = [
    (("metadata", "title"), "TODO", "no-placeholder-pollution", "metadata.title"),
    (("chapters", 2, "core_argument"), "c" * 60 + "待补充", "no-placeholder-pollution", "chapters[2].core_argument"),
    (("chapters", 1, "chapter_number"), "11-22", "no-chapter-merge", "chapters[1].chapter_number"),
    (("chapters", 0, "core_argument"), "short", "no-empty-chapters", "chapters[0].core_argument"),
    (("core_concepts", 0, "definition"), "d" * 29, "concept-definition-depth", "core_concepts[0].definition"),
    (("key_quotes", 0, "background_context"), None, "quote-source-attribution", "key_quotes[0].background_context"),
    (("key_quotes", 0, "chapter"), "", "quote-source-attribution", "key_quotes[0].chapter"),
    (("critical_analysis", "postcolonial_perspective"), "p" * 50, "critical-analysis-coverage", "critical_analysis.postcolonial_perspective"),
    (("critical_analysis", "feminist_perspective"), None, "critical-analysis-coverage", "critical_analysis.feminist_perspective"),
    (("core_concepts", 0, "underlying_logic"), "plain words", "underlying-logic-format", "core_concepts[0].underlying_logic"),
    (("key_cases",), None, "required-fields-completeness", "key_cases"),
]


def test_axioms(spark):
    from quire.functions import rules

    broken = [*BROKEN, (("key_insights", 0, "description"), rules.TEMPLATES[0], "no-template-content", "key_insights[0].description")]
    assert {b[2] for b in broken} == {a.id for a in manifests.BOOK_AXIOMS}
    docs = [GOOD] + [changed(p, v) for p, v, _, _ in broken]
    rows = spark.createDataFrame([(i, json.dumps(d, ensure_ascii=False)) for i, d in enumerate(docs)], "i int, t string").withColumn("doc", F.try_parse_json("t"))
    got = dict(rows.select("i", manifests.findings(F.col("doc"))).collect())
    assert got[0] == []
    severity = {a.id: a.severity for a in manifests.BOOK_AXIOMS}
    for i, (_, _, axiom, place) in enumerate(broken, 1):
        assert [tuple(f) for f in got[i]] == [(axiom, severity[axiom], place)], docs[i]
    kept = {r.i: r for r in manifests.verdicts(rows, "doc", F.lit(6)).collect()}
    assert (kept[0].blocking, kept[0].warnings, kept[0].keeps) == (0, 1, True) and not kept[1].keeps


def test_awkward_documents(spark):
    rows = spark.createDataFrame([(0, None), (1, "{}"), (2, '{"chapters": "text", "core_concepts": [1, null, []]}')], "i int, t string").withColumn("doc", F.try_parse_json("t"))
    got = {r[0]: [f.place for f in r[1] if f.axiom != "required-fields-completeness"] for r in rows.select("i", manifests.findings(F.col("doc"))).collect()}
    assert set(map(tuple, got.values())) == {("critical_analysis.feminist_perspective", "critical_analysis.postcolonial_perspective")}
    with pytest.raises(ValueError):
        manifests.values(F.col("doc"), "a[0].b")


def test_nested_paths(spark):
    rows = spark.createDataFrame([('{"a": [{"b": [{"c": 1}, {"c": null}, {"d": 2}]}, {"b": 3}, {"b": [{"c": "x"}]}]}',)], "t string").withColumn("doc", F.try_parse_json("t"))
    (met, asked), = rows.select(manifests.values(F.col("doc"), "a[*].b[*].c"), manifests.values(F.col("doc"), "a[*].b[*].c", absent=True)).collect()
    assert [tuple(f) for f in met] == [("a[0].b[0].c", "1"), ("a[2].b[0].c", "x")]
    assert [tuple(f) for f in asked] == [("a[0].b[0].c", "1"), ("a[0].b[1].c", None), ("a[0].b[2].c", None), ("a[2].b[0].c", "x")]


def test_costly_values_are_worked_out_once(spark):
    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def made(i):
        calls.add(1)
        return ['{"a": 1}', 'so: {"a": 1} x', '{"a": 1, // x\n}', '{"a": ["x"', '{"a": "x", "b":', "none"][i]

    rows = spark.range(6).select(normalising.once(made(F.col("id").cast("int")), lambda x: normalising.document(x)["status"]).alias("s"))
    assert [r.s for r in rows.collect()] == ["parsed", "extracted", "mended", "closed", "cut", "none"] and calls.value == 6
    # the plan of a document holds the text it is of once, and each part of a book that a query uses
    plan = spark.range(1).select(normalising.document(F.concat(F.lit("{"), F.sha2(F.col("id").cast("string"), 256))).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha2(") == 1


def test_split_texts(spark):
    texts = ["a、b", " a、b ", "a 、 b、、 、c", "a、　b ", "é、ü、字", "🙂 、🙂", "a b、c", "a、b\n", "", "、"]
    (b,) = book_of(spark, {"core_concepts": [{"core_drivers": t} for t in texts]})
    assert [c["core_drivers"] for c in b["core_concepts"]] == [[p.strip() for p in t.split("、") if p.strip()] for t in texts]


def test_open_ends(spark):
    texts = ['{"a": "x\\', '{"a": "x\\\\', '{"a": ["x", \n', '{"a": ["x",\n\n\n\n\n', '{"a": ["x"], "b": {"c": [1,  ', '```json\n{"a": ["x",\n```\n', '{"a": "x\\\n']
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", normalising.document("t").alias("d")).select("i", "d.status", F.to_json("d.document"))
    got = {r[0]: (r[1], json.loads(r[2]) if r[2] else None) for r in rows.collect()}
    assert got[0] == ("closed", {"a": "x"}) and got[1] == ("closed", {"a": "x\\"}) and got[2] == got[3] == got[5] == ("closed", {"a": ["x"]})
    assert got[4] == ("closed", {"a": ["x"], "b": {"c": [1]}})
