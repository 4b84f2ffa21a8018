"""Queries of overlapping chunks, outlines and long-term memory over the generated tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import rules
from quire.operators import chunking, markdown, memory
from quire.plans.catalog import register
from quire.session import load

#: Unicode white space for DuckDB's regular expressions.
_SPACE = r"[\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _headed(marks: dict[str, str]) -> Column:
    """The documents' texts with headings before lines that begin with certain letters."""
    return reduce(lambda x, m: F.regexp_replace(x, f"\n([{m[0]}])", f"\n{m[1]} $1"), marks.items(), F.coalesce("text", F.lit("")))


def _headed_sql(marks: dict[str, str]) -> str:
    return reduce(lambda x, m: f"regexp_replace({x}, '\\n([{m[0]}])', chr(10) || '{m[1]} \\1', 'g')", marks.items(), "coalesce(text, '')")


_CHAPTERS = {"A-D": "##", "E-H": "Chapter 12", "I-M": "第 三章"}
_SIZE, _OVERLAP = 1500, 200


def _chunk_sql() -> str:
    def end(at: str) -> str:
        low = f"greatest({at}, {at} + {_SIZE - 2 * _OVERLAP})"
        region = f"substr(x, {low} + 1, least({at} + {_SIZE + _OVERLAP}, n) - {low})"
        cuts = []
        for p in reversed(rules.CHUNK_HEADINGS):
            p = p.replace(r"(?U:\s)", _SPACE).replace(r"(?U:\d)", r"\p{Nd}")
            cut = f"{low} + length({region}) - length(string_split_regex({region}, '{p}')[-1]) - length(regexp_extract_all({region}, '{p}')[-1])"
            cuts.append(f"CASE WHEN {cut} > {at} + {_SIZE // 2} THEN {cut} END")
        return f"CASE WHEN n <= {_SIZE} OR {at} + {_SIZE} >= n THEN n ELSE coalesce({', '.join(cuts)}, {at} + {_SIZE}) END"

    return f"""WITH RECURSIVE d AS (SELECT doc_id, x, length(x) AS n FROM (SELECT doc_id, {_headed_sql(_CHAPTERS)} AS x FROM documents) WHERE x <> ''),
 c AS (SELECT doc_id, x, n, 0 AS chunk_index, CAST(0 AS BIGINT) AS begin, {end('CAST(0 AS BIGINT)')} AS "end" FROM d
  UNION ALL SELECT doc_id, x, n, chunk_index + 1, "end", {end('"end"')} FROM c WHERE "end" < n)
 SELECT doc_id, chunk_index, CAST(greatest(0, begin - {_OVERLAP}) AS INTEGER) AS "start", CAST("end" AS INTEGER) AS "end", md5(substr(x, greatest(0, begin - {_OVERLAP}) + 1, "end" - greatest(0, begin - {_OVERLAP}))) AS content FROM c"""


@register("overlapping_chunks", _chunk_sql())
def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with chapter headings, cut into overlapping chunks that end at headings where they can."""
    chunks = chunking.overlapping_chunks(_headed(_CHAPTERS), _SIZE, _OVERLAP)
    return load(spark, sf_dir, "documents").select("doc_id", F.inline(chunks)).withColumn("content", F.md5(F.col("content").cast("binary")))


_LEVELS = {"A-C": "#", "D-F": "##", "G-I": "###", "J-O": "####", "P-S": "######"}


@register(
    "outlines",
    f"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS line, unnest(range(len(string_split(x, chr(10))))) AS i FROM (SELECT doc_id, {_headed_sql(_LEVELS)} AS x FROM documents) WHERE x <> ''),
 h AS (SELECT *, length(regexp_extract(line, '^(#{{1,6}})[ \\t]', 1)) AS level, sum(CASE WHEN regexp_matches(line, '^#{{1,6}}[ \\t]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS ordinal, max(i) OVER (PARTITION BY doc_id) AS last FROM l),
 s AS (SELECT doc_id, CAST(ordinal AS INTEGER) AS ordinal, max(level) AS level, max(CASE WHEN level > 0 THEN trim(regexp_replace(line, '^#+[ \\t]+', '')) ELSE '' END) AS title, CAST(sum(CASE WHEN level > 0 THEN 0 ELSE length(line) + CASE WHEN i < last THEN 1 ELSE 0 END END) AS INTEGER) AS n_body FROM h GROUP BY doc_id, ordinal),
 p AS (SELECT doc_id, ordinal, CASE level WHEN 1 THEN NULL WHEN 2 THEN l1 WHEN 3 THEN greatest(l1, l2) WHEN 4 THEN greatest(l1, l2, l3) WHEN 6 THEN greatest(l1, l2, l3, l4) END AS parent FROM
  (SELECT *, {', '.join(f'max(CASE WHEN level = {k} THEN ordinal END) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l{k}' for k in (1, 2, 3, 4))} FROM s)),
 u AS (SELECT s.doc_id, s.ordinal, p.parent AS up, [s.title] AS path FROM s JOIN p USING (doc_id, ordinal) WHERE level > 0
  UNION ALL SELECT u.doc_id, u.ordinal, p.parent, list_prepend(s.title, u.path) FROM u JOIN s ON s.doc_id = u.doc_id AND s.ordinal = u.up JOIN p ON p.doc_id = u.doc_id AND p.ordinal = u.up)
 SELECT s.doc_id, s.ordinal, CAST(s.level AS INTEGER) AS level, p.parent, s.n_body, md5(array_to_string(coalesce(path, []), ' > ')) AS path FROM s JOIN p USING (doc_id, ordinal) LEFT JOIN u ON u.doc_id = s.doc_id AND u.ordinal = s.ordinal AND u.up IS NULL""",
)
def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of every document with headings of several levels: their parents and the paths of titles above them."""
    docs = load(spark, sf_dir, "documents").select("doc_id", _headed(_LEVELS).alias("text"))
    out = chunking.outline(chunking.sections(docs, "doc_id"), "doc_id")
    return out.select("doc_id", "ordinal", "level", "parent", F.length("body").alias("n_body"), F.md5(F.array_join("path", " > ").cast("binary")).alias("path"))


_TOKENS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')"


@register(
    "memory_search",
    f"""WITH t AS (SELECT doc_id AS item_id, {_TOKENS} AS w FROM documents), size AS (SELECT item_id, len(w) AS size FROM t), g AS (SELECT count(*) AS items, avg(size) AS mean FROM size),
 a AS (SELECT item_id, unnest(w) AS token, unnest(range(len(w))) AS place FROM t), b AS (SELECT item_id AS search_id, {_TOKENS} AS w FROM benchmark),
 q AS (SELECT search_id, 0 AS phrase, 0 AS part, 2 AS n, w[1] AS token, false AS prefix FROM b UNION ALL SELECT search_id, 0, 1, 2, w[2], false FROM b UNION ALL SELECT search_id, 1, 0, 1, w[4][1:3], true FROM b),
 v AS (SELECT search_id, phrase, n, item_id, place - part AS begin, count(*) AS parts FROM q JOIN a ON CASE WHEN prefix THEN starts_with(a.token, q.token) ELSE a.token = q.token END GROUP BY ALL HAVING count(*) = n),
 h AS (SELECT search_id, phrase, item_id, count(*) AS tf FROM v GROUP BY ALL), d AS (SELECT search_id, phrase, count(*) AS df FROM h GROUP BY ALL),
 s AS (SELECT search_id, item_id, round(sum(greatest(ln((items - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * size / mean))), 6) AS score FROM h JOIN d USING (search_id, phrase) JOIN size USING (item_id), g GROUP BY ALL HAVING count(*) = 2)
 SELECT search_id, CAST(row_number() OVER (PARTITION BY search_id ORDER BY score DESC, item_id) AS INTEGER) AS rank, item_id, score FROM s QUALIFY rank <= 5""",
)
def memory_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents searched for the phrase of each benchmark item's first two words, along with words that begin like its fourth."""
    w = memory.words("text")
    searches = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("search_id"), F.array(F.concat_ws(" ", F.get(w, 0), F.get(w, 1)), F.concat(F.substring(F.get(w, 3), 1, 3), F.lit("*"))).alias("phrases"))
    return memory.search(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("item_id"), "text"), searches)


@register(
    "memory_by_metadata",
    "WITH c AS (SELECT click_id AS item_id, ts AS seen, CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS value FROM clicks) SELECT 'k' AS key, value, CAST(row_number() OVER (PARTITION BY value ORDER BY seen DESC NULLS LAST, item_id) AS INTEGER) AS rank, item_id FROM c WHERE value IN (SELECT CAST(vendor_id AS VARCHAR) FROM vendors) QUALIFY rank <= 10",
)
def memory_by_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest clicks whose properties name each vendor's number as k."""
    clicks = load(spark, sf_dir, "clicks").select(F.col("click_id").alias("item_id"), F.col("props").alias("metadata"), F.col("ts").alias("at"))
    wanted = load(spark, sf_dir, "vendors").select(F.lit("k").alias("key"), F.col("vendor_id").cast("string").alias("value"))
    return memory.by_metadata(clicks, wanted)


_MARKS = {"A-C": "## 核心概念", "D-F": "## 章节结构总览", "G": "```", "H-K": "| 3-5 |", "L-M": "| 7 |", "N-P": "- TODO [[b]] 待补充", "Q-S": "### 学习路径"}
_MARKED_SQL = f"SELECT doc_id, CASE WHEN regexp_matches(coalesce(text, ''), '^[A-M]') THEN '---' || chr(10) || 'title: TBD' || chr(10) || 'tags' || chr(10) || '---' || chr(10) ELSE '' END || {_headed_sql(_MARKS)} AS x FROM documents"
_PLACES_SQL = f"""d AS ({_MARKED_SQL}), l AS (SELECT doc_id, unnest(string_split(x, chr(10))) AS content, unnest(range(1, len(string_split(x, chr(10))) + 1)) AS n FROM d WHERE x <> ''),
 f AS (SELECT *, CASE WHEN bool_or(n = 1 AND content = '---') OVER (PARTITION BY doc_id) THEN min(CASE WHEN n > 2 AND starts_with(content, '---') THEN n END) OVER (PARTITION BY doc_id) END AS close FROM l),
 z AS (SELECT *, sum(CASE WHEN starts_with(content, '```') AND n > coalesce(close, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS fences FROM f),
 s AS (SELECT doc_id, n, content, CASE WHEN n <= coalesce(close, 0) THEN 'front' WHEN fences % 2 = 1 OR starts_with(content, '```') THEN 'code' ELSE 'body' END AS zone FROM z),
 t AS (SELECT *, last_value(CASE WHEN zone = 'body' AND starts_with(content, '## ') THEN trim(content[4:]) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS section, regexp_extract(content, '^\\s*\\|\\s*(\\d+[-\\d]*)\\s*\\|', 1) AS cell FROM s),
 k AS (SELECT unnest({list(rules.MARKDOWN_PLACEHOLDERS)}) AS word),
 w AS (SELECT doc_id, n AS line, zone, section, 'placeholder' AS finding, word AS detail, CAST(len(string_split(content, word)) - 1 AS INTEGER) AS times FROM t JOIN k ON contains(content, word)
  UNION ALL SELECT doc_id, n, zone, section, 'merged_chapter', cell, 1 FROM t WHERE zone = 'body' AND contains(section, '章节结构') AND regexp_matches(cell, '^\\d+-\\d+'))"""


def _marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the Markdown of a book, with front matter, sections, tables, code and placeholders by first letters."""
    front = F.when(F.coalesce("text", F.lit("")).rlike("^[A-M]"), F.lit("---\ntitle: TBD\ntags\n---\n")).otherwise("")
    return load(spark, sf_dir, "documents").select("doc_id", F.concat(front, _headed(_MARKS)).alias("text"))


@register("markdown_findings", f"WITH {_PLACES_SQL} SELECT doc_id, CAST(line AS INTEGER) AS line, zone, md5(section) AS section, finding, detail, times AS n FROM w")
def markdown_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placeholders and merged chapters in every document's Markdown, with their lines, zones and sections."""
    found = markdown.line_findings(markdown.lines(_marked(spark, sf_dir), "doc_id"), "doc_id")
    return found.withColumn("section", F.md5(F.col("section").cast("binary")))


def _report_sql() -> str:
    fields = ", ".join(f"CASE WHEN NOT coalesce(bool_or(zone = 'front' AND contains(content, '{f}')), false) THEN '{f}' END" for f in rules.MARKDOWN_FIELDS)
    sections = ", ".join(f"CASE WHEN NOT coalesce(bool_or(regexp_matches(content, '## .*{s}')), false) THEN '{s}' END" for s in rules.MARKDOWN_SECTIONS)
    return f"""WITH {_PLACES_SQL}, m AS (SELECT d.doc_id, list_filter([CASE WHEN NOT coalesce(bool_or(zone = 'front'), false) THEN 'front matter' END, {fields}, {sections}], lambda v: v IS NOT NULL) AS missing,
  count(*) FILTER (zone = 'body' AND contains(section, '章节结构') AND cell <> '') AS chapters FROM d LEFT JOIN t ON t.doc_id = d.doc_id GROUP BY 1),
 p AS (SELECT doc_id, sum(times) FILTER (finding = 'placeholder') AS placeholders, array_to_string(list(line || ': ' || detail ORDER BY line, detail) FILTER (finding = 'placeholder')[1:5], ', ') AS first, string_agg(detail, ',' ORDER BY line) FILTER (finding = 'merged_chapter') AS merged FROM w GROUP BY 1)
 SELECT d.doc_id, len(missing) = 0 AND merged IS NULL AS valid, array_to_string(missing, ',') AS missing, CAST(coalesce(placeholders, 0) AS BIGINT) AS placeholders, coalesce(first, '') AS first, CAST(chapters AS BIGINT) AS chapters, md5(coalesce(merged, '')) AS merged,
  CAST(len(regexp_extract_all(x, '\\[\\[[^\\n]*?\\]\\]')) AS INTEGER) AS book_links, CAST(length(x) AS INTEGER) AS total_chars, CAST(len(string_split(x, chr(10))) - 1 AS INTEGER) AS total_lines FROM d JOIN m USING (doc_id) LEFT JOIN p USING (doc_id)"""


@register("markdown_reports", _report_sql())
def markdown_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every document's Markdown lacks and what it counts."""
    r = markdown.reports(_marked(spark, sf_dir), "doc_id")
    merged = F.md5(F.array_join("merged", ",").cast("binary"))
    return r.select("doc_id", "valid", F.array_join("missing", ",").alias("missing"), "placeholders", F.array_join("first", ", ").alias("first"), "chapters", merged.alias("merged"), "book_links", "total_chars", "total_lines")
