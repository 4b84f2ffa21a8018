"""The quality engine: statistics, score, issues, warnings and verdict of nested book documents, in one projection without a shuffle.

A book has the columns metadata, time_background, critical_analysis (feminist_perspective, postcolonial_perspective,
ethical_boundaries with reasonable and dangerous), learning_path (beginner, intermediate, advanced, practice), book_network
(a map from books to relations), and the arrays chapters (chapter_number, title, core_argument, underlying_logic),
core_concepts (name, definition, deep_meaning, underlying_logic), key_insights (title, description, underlying_logic),
key_cases (name, source_chapter, event_description) and key_quotes (text, chapter, background_context, underlying_logic);
metadata and the items of the arrays may have related_books; ``expected_chapters`` may follow. Structs may be maps.

Defined cases: absent columns are missing fields; absent or null fields and null texts are empty texts, null arrays empty
arrays; a null item of an array counts as an item of empty texts; repeated books are rows like any other; an empty table
gives an empty result; other columns are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import rules
from quire.functions import text as X

LISTS = ["chapters", "core_concepts", "key_insights", "key_cases", "key_quotes"]


def _leaves(schema: T.DataType, value: Column) -> list[Column]:
    """Arrays of the string leaves below ``value``: structs and arrays of structs or strings; nested arrays are not entered."""
    if isinstance(schema, T.StringType):
        return [F.array(value)]
    if isinstance(schema, T.StructType):
        return [c for f in schema.fields for c in _leaves(f.dataType, value.getField(f.name))]
    if isinstance(schema, T.MapType):
        return _leaves(T.ArrayType(schema.valueType), F.map_values(value))
    if isinstance(schema, T.ArrayType):
        e = schema.elementType
        if isinstance(e, T.StringType):
            return [F.coalesce(value, F.array().cast("array<string>"))]
        if isinstance(e, T.StructType):
            none = F.array().cast("array<string>")

            def below(f: T.StructField) -> Column:
                return F.coalesce(F.flatten(F.transform(value, lambda x: reduce(F.concat, _leaves(f.dataType, x.getField(f.name))))), none)

            return [below(f) for f in e.fields if _leaves(f.dataType, F.lit(None))]
        if isinstance(e, T.ArrayType) and isinstance(e.elementType, T.StringType):
            return [F.coalesce(F.flatten(value), F.array().cast("array<string>"))]
    return []


def leaves(books: DataFrame, columns: list[str]) -> Column:
    """All string leaves of ``columns``, those of absent fields left out."""
    parts = [p for c in columns if c in books.columns for p in _leaves(books.schema[c].dataType, F.col(c))]
    return F.filter(reduce(F.concat, parts) if parts else F.array().cast("array<string>"), lambda s: s.isNotNull())


def _count(items: Column, test) -> Column:
    return F.size(F.filter(items, test))


def _field(schema: T.DataType | None, value: Column, name: str) -> tuple[T.DataType | None, Column]:
    """(type, value) of a struct's field or a map's entry; (None, null) where there is none."""
    if isinstance(schema, T.StructType) and name in schema.names:
        return schema[name].dataType, value.getField(name)
    if isinstance(schema, T.MapType):
        return schema.valueType, F.try_element_at(value, F.lit(name))
    return None, F.lit(None)


class _Items:
    """One of a book's arrays: its texts by name, and counts of items."""

    def __init__(self, books: DataFrame, column: str):
        here = column in books.columns
        self.type = books.schema[column].dataType.elementType if here else None
        # a null array reads as an empty one of the same type
        self.items = F.coalesce(F.col(column), F.array().cast(books.schema[column].dataType)) if here else F.array().cast("array<string>")
        self.size = F.size(self.items)

    def text(self, x: Column, name: str) -> Column:
        kind, value = _field(self.type, x, name)
        return F.coalesce(value.cast("string"), F.lit("")) if kind is not None else F.lit("")

    def count(self, test) -> Column:
        return _count(self.items, lambda x: F.coalesce(test(x), F.lit(False)))

    def dicts(self) -> Column:
        """Entries of the items' related_books that are not texts."""
        kind, _ = _field(self.type, F.lit(None), "related_books")
        if not isinstance(kind, T.ArrayType) or isinstance(kind.elementType, T.StringType):
            return F.lit(0)
        return F.aggregate(self.items, F.lit(0), lambda n, x: n + F.greatest(F.coalesce(F.size(F.filter(x["related_books"], lambda b: b.isNotNull())), F.lit(0)), F.lit(0)))


def _missing(books: DataFrame, column: str, fields: list[str]) -> Column:
    if column not in books.columns:
        return F.lit(len(fields))
    kind = books.schema[column].dataType
    return sum(((F.coalesce(_field(kind, F.col(column), f)[1].cast("string"), F.lit("")) == "").cast("int") for f in fields), F.lit(0))


def gaps(numbers: Column, most: int = 10) -> Column:
    """The first ``most`` (ten, as the rules' messages list them) numbers missing between the sorted numbers of an array."""
    n = F.array_sort(numbers)
    between = F.zip_with(F.slice(n, F.lit(1), F.greatest(F.size(n) - 1, F.lit(0))), F.slice(n, F.lit(2), F.greatest(F.size(n) - 1, F.lit(0))), lambda a, b: F.when(b > a + 1, F.sequence(a + 1, F.least(b - 1, a + most))).otherwise(F.array().cast("array<int>")))
    return F.slice(F.flatten(between), 1, most)


def statistics(books: DataFrame) -> dict[str, Column]:
    """What the score, the issues and the warnings are made of."""
    have = set(books.columns)
    top = [c for c in rules.TOP_FIELDS if c in have]
    chapters, concepts, insights, cases, quotes = (_Items(books, c) for c in LISTS)
    everything = leaves(books, [*top, *(c for c in ("learning_path", "book_network") if c in have)])

    def least(items: _Items, **lengths: int):
        """Whether an item lacks some text of a given stripped length."""
        return lambda x: ~reduce(lambda p, q: p & q, (X.has_substance(items.text(x, f), n) for f, n in lengths.items()))

    def vague(x: Column) -> Column:
        """Whether a direct text of a concept is empty, or has a placeholder or a template phrase."""
        kind, bad = concepts.type, lambda v: v.isNotNull() & ((v == "") | X.has_placeholder(v) | X.is_template(v))
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            return F.exists(F.map_values(x), bad)
        direct = [x.getField(f.name) for f in kind.fields if isinstance(f.dataType, T.StringType)] if isinstance(kind, T.StructType) else []
        return reduce(lambda p, q: p | q, (F.coalesce(bad(v), F.lit(False)) for v in direct), F.lit(False))

    number = lambda x: chapters.text(x, "chapter_number")
    numbers = F.filter(F.transform(chapters.items, lambda x: F.nullif(F.regexp_extract(number(x), "[0-9]+", 0), F.lit("")).try_cast("int")), lambda n: n.isNotNull()) if chapters.type is not None else F.array().cast("array<int>")
    logic = [(i, lambda x, i=i: i.text(x, "underlying_logic")) for i in (chapters, concepts, insights)]
    stated = reduce(lambda p, q: p + q, (i.count(lambda x, t=t: t(x) != "") for i, t in logic))
    formed = reduce(lambda p, q: p + q, (i.count(lambda x, t=t: X.has_logic_form(t(x))) for i, t in logic))
    expected = F.coalesce(F.col("expected_chapters"), F.lit(0)) if "expected_chapters" in have else F.lit(0)
    critical = (books.schema["critical_analysis"].dataType, F.col("critical_analysis")) if "critical_analysis" in have else (None, F.lit(None))
    ethics = _field(*critical, "ethical_boundaries")
    path = (books.schema["learning_path"].dataType, F.col("learning_path")) if "learning_path" in have else (None, F.lit(None))

    def stage(name: str) -> Column:
        kind, value = _field(*path, name)
        return F.coalesce(F.exists(value, lambda x: X.has_substance(x, 8)), F.lit(False)).cast("int") if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType) else F.lit(0)

    def said(owner, name: str) -> Column:
        kind, value = _field(*owner, name)
        return F.coalesce(value, F.lit("")) if isinstance(kind, T.StringType) else F.lit("")

    network = F.lit(False)
    if "book_network" in have and isinstance(books.schema["book_network"].dataType, T.MapType):
        network = F.coalesce(F.exists(F.map_entries("book_network"), lambda e: X.has_substance(e["key"]) & X.has_substance(e["value"])), F.lit(False))
    related = _field(books.schema["metadata"].dataType, F.col("metadata"), "related_books") if "metadata" in have else (None, F.lit(None))
    related_dicts = F.greatest(F.coalesce(F.size(F.filter(related[1], lambda x: x.isNotNull())), F.lit(0)), F.lit(0)) if isinstance(related[0], T.ArrayType) and not isinstance(related[0].elementType, T.StringType) else F.lit(0)
    return {
        "missing_fields": F.lit(len(rules.TOP_FIELDS)) - sum((F.col(c).isNotNull().cast("int") for c in top), F.lit(0)),
        "missing_metadata": _missing(books, "metadata", rules.METADATA_FIELDS),
        "missing_background": _missing(books, "time_background", rules.TIME_FIELDS),
        "related_dicts": F.least(F.lit(10), related_dicts + sum((i.dicts() for i in (chapters, concepts, insights, cases, quotes)), F.lit(0))),
        "bad_numbers": chapters.count(lambda x: ~number(x).rlike("^[0-9]{2}$")),
        "missing_logic": chapters.count(lambda x: F.trim(chapters.text(x, "underlying_logic")).isin("", "-")),
        "merged_chapters": chapters.count(lambda x: X.is_merged(number(x))) + chapters.count(lambda x: X.is_merged(chapters.text(x, "title"))),
        "placeholder_chapters": chapters.count(lambda x: X.chapter_placeholder(number(x), chapters.text(x, "title"), chapters.text(x, "core_argument")).isNotNull()),
        "chapters": chapters.size,
        "coverage": F.when(expected > 0, chapters.size / expected).otherwise(1.0),
        "gaps": gaps(numbers),
        "empty_chapters": chapters.count(lambda x: F.length(F.concat(chapters.text(x, "core_argument"), chapters.text(x, "underlying_logic"))) < rules.MIN_CONTENT),
        "template_titles": chapters.count(lambda x: X.is_template(chapters.text(x, "title"))),
        "concepts": concepts.size,
        "shallow_concepts": concepts.count(lambda x: (F.length(concepts.text(x, "definition")) < rules.MIN_DEFINITION) | (F.length(concepts.text(x, "deep_meaning")) < rules.MIN_DEFINITION)),
        "placeholder_concepts": concepts.count(vague),
        "quotes": quotes.size,
        "short_quotes": quotes.count(lambda x: F.length(quotes.text(x, "text")) < 10),
        "insights": insights.size,
        "template_insights": insights.count(lambda x: X.is_template(insights.text(x, "description"))),
        "cases": cases.size,
        "placeholder_leaves": _count(everything, X.has_placeholder),
        "template_leaves": _count(everything, X.is_template),
        "logic_ratio": F.when(stated > 0, formed / stated).otherwise(0.0),
        "feminist_placeholder": X.is_placeholder_or_template(said(critical, "feminist_perspective")),
        "postcolonial_placeholder": X.is_placeholder_or_template(said(critical, "postcolonial_perspective")),
        "ethics_missing": ~(X.has_substance(said(ethics, "reasonable")) & X.has_substance(said(ethics, "dangerous"))),
        "path_stages": sum((stage(n) for n in rules.LEARNING_STAGES), F.lit(0)),
        "network_missing": ~network,
        "weak_insights": insights.count(least(insights, description=30)),
        "weak_cases": cases.count(lambda x: least(cases, name=4, source_chapter=2, event_description=40)(x) | (cases.text(x, "name") == "未命名")),
        "weak_quotes": quotes.count(least(quotes, text=10, chapter=2, background_context=20, underlying_logic=20)),
    }


def assess(books: DataFrame) -> DataFrame:
    """Every book with ``stats``, ``score`` (0 to 100), ``issues``, ``warnings`` (how many the score counts), ``blocking`` and ``passed``."""
    stats = statistics(books)
    rows = books.withColumn("stats", F.struct(*(v.alias(k) for k, v in stats.items())))
    s = {k: F.col(f"stats.{k}") for k in stats}

    def step(value, *bounds):
        out = None
        for test, penalty in bounds:
            out = F.when(test(value), penalty) if out is None else out.when(test(value), penalty)
        return out.otherwise(0)

    # shares over 0.3 are counts over 0.3 of the items
    many_empty, many_shallow = s["empty_chapters"] > 0.3 * s["chapters"], s["shallow_concepts"] > 0.3 * s["concepts"]
    issues = [
        (s["missing_fields"] > 0, "顶层结构缺失"),
        (s["missing_metadata"] > 0, "书籍元数据缺失"),
        (s["missing_background"] > 0, "时代背景缺失"),
        (s["related_dicts"] > 0, "related_books格式错误"),
        (s["merged_chapters"] > 0, "章节合并"),
        (s["placeholder_chapters"] > 0, "章节占位符"),
        (s["coverage"] < 0.5, "章节覆盖率极低"),
        ((s["coverage"] >= 0.5) & (s["coverage"] < 0.8), "章节覆盖率不足"),
        (s["chapters"] < rules.MIN_CHAPTERS, "章节数量不足"),
        (F.size(s["gaps"]) > 0, "章节缺失"),
        (many_empty, "空洞章节"),
        (s["concepts"] < rules.MIN_CONCEPTS, "核心概念数量不足"),
        (many_shallow, "浅薄概念"),
        (s["placeholder_concepts"] > 0, "概念含占位符"),
        (s["quotes"] < rules.MIN_QUOTES, "金句数量不足"),
        (s["insights"] < rules.MIN_INSIGHTS, "关键洞见数量不足"),
        (s["cases"] < rules.MIN_CASES, "关键案例数量不足"),
        (s["placeholder_leaves"] > 5, "占位符污染"),
        ((s["placeholder_leaves"] > 0) & (s["placeholder_leaves"] <= 5), "存在占位符"),
        (s["template_leaves"] > 3, "模板化内容"),
        (s["logic_ratio"] < 0.5, "底层逻辑格式不正确"),
        (s["ethics_missing"], "伦理边界缺失"),
        (s["path_stages"] < 2, "学习路径缺失"),
        (s["weak_insights"] > 0, "关键洞见缺少描述"),
        (s["weak_cases"] > 0, "关键案例缺少证据"),
        (s["weak_quotes"] > 0, "金句缺少证据"),
    ]
    warnings = [
        s["bad_numbers"] > 0,
        s["missing_logic"] > 0,
        (s["chapters"] >= rules.MIN_CHAPTERS) & (s["chapters"] < 10),
        (s["empty_chapters"] > 0) & ~many_empty,
        s["template_titles"] > 0,
        (s["shallow_concepts"] > 0) & ~many_shallow,
        s["short_quotes"] > 0,
        (s["template_leaves"] > 0) & (s["template_leaves"] <= 3),
        (s["logic_ratio"] >= 0.5) & (s["logic_ratio"] < 0.8),
        s["feminist_placeholder"],
        s["postcolonial_placeholder"],
        s["network_missing"],
    ]
    warned = s["template_insights"] + sum((w.cast("int") for w in warnings), F.lit(0))
    penalty = (
        20 * s["missing_fields"] + 15 * (s["missing_metadata"] + s["missing_background"]) + 50 * (s["merged_chapters"] + s["placeholder_chapters"])
        + step(s["coverage"], (lambda v: v < 0.5, 30), (lambda v: v < 0.8, 15))
        + step(s["chapters"], (lambda v: v < rules.MIN_CHAPTERS, 20), (lambda v: v < 10, 5))
        + step(many_empty, (lambda v: v, 15))
        + step(s["concepts"], (lambda v: v < rules.MIN_CONCEPTS, 15))
        + step(many_shallow, (lambda v: v, 10))
        + 5 * s["placeholder_concepts"]
        + step(s["quotes"], (lambda v: v < rules.MIN_QUOTES, 10))
        + step(s["insights"], (lambda v: v < rules.MIN_INSIGHTS, 10))
        + step(s["cases"], (lambda v: v < rules.MIN_CASES, 10))
        + 8 * s["placeholder_leaves"] + 5 * s["template_leaves"]
        + step(s["logic_ratio"], (lambda v: v < 0.5, 15), (lambda v: v < 0.8, 5))
        + 5 * (s["feminist_placeholder"].cast("int") + s["postcolonial_placeholder"].cast("int"))
        + 2 * F.col("warnings")
    )
    found = F.filter(F.array(*(F.when(c, F.lit(t)) for c, t in issues)), lambda x: x.isNotNull())
    rows = rows.withColumn("warnings", warned).withColumn("score", F.greatest(F.lit(0), F.lit(100) - penalty).cast("int")).withColumn("issues", found)
    rows = rows.withColumn("blocking", F.filter("issues", lambda i: reduce(lambda p, q: p | q, (i.contains(b) for b in rules.BLOCKING))))
    return rows.withColumn("passed", (F.size("blocking") == 0) & (F.col("score") >= 70))


def priority(score: Column) -> Column:
    """HIGH under 50, MEDIUM under 70, else LOW."""
    return F.when(score < 50, "HIGH").when(score < 70, "MEDIUM").otherwise("LOW")


def chapter_gaps(chapters: DataFrame, key: str, number: str, most: int | None = 10) -> DataFrame:
    """(key, missing): numbers between a key's chapters that none has, the first ``most`` in order (None: all)."""
    from pyspark.sql import Window

    first = F.nullif(F.regexp_extract(F.col(number).cast("string"), r"\d+", 0), F.lit("")).cast("int")
    have = chapters.select(key, first.alias("n")).where("n is not null").distinct()
    ahead = have.withColumn("next", F.lead("n").over(Window.partitionBy(key).orderBy("n"))).where("next > n + 1")
    last = F.col("next") - 1 if most is None else F.least(F.col("next") - 1, F.col("n") + most)
    gaps = ahead.select(key, F.sequence(F.col("n") + 1, last).alias("g"))
    missing = F.array_sort(F.flatten(F.collect_list("g")))
    return gaps.groupBy(key).agg((missing if most is None else F.slice(missing, 1, most)).alias("missing"))
