"""Checking Markdown line by line: what zone and section a line is in, and what is wrong with it.

Lines carry their state by windows over the lines of one text, ordered; a text is a row, so a window holds what a row does.

Defined cases: null and empty texts have no lines, and lack everything that a text must have; repeated rows need different keys;
an empty table gives an empty result. Line numbers begin with 1; a line ends at \\n alone.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rules


def _states(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Lines (keys, line, content and more) with their zone and section; lines that change no state may be missing."""
    whole = Window.partitionBy(*keys)
    so_far = whole.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.max((F.col("line") == 1) & (F.col("content") == "---")).over(whole)
    close = F.min(F.when((F.col("line") > 2) & F.col("content").startswith("---"), F.col("line"))).over(whole)
    at = rows.withColumn("_front", F.coalesce(F.when(opens, close), F.lit(0)))
    fence = F.col("content").startswith("```") & (F.col("line") > F.col("_front"))
    at = at.withColumn("_fence", fence).withColumn("_fences", F.sum(F.col("_fence").cast("int")).over(so_far))
    zone = F.when(F.col("line") <= F.col("_front"), "front").when(F.col("_fence") | (F.col("_fences") % 2 == 1), "code").otherwise("body")
    at = at.withColumn("zone", zone)
    title = F.when((F.col("zone") == "body") & F.col("content").rlike("^## "), F.regexp_replace(F.substring("content", 4, 2**31 - 1), "^ +| +$", ""))
    return at.withColumn("section", F.last(title, ignorenulls=True).over(so_far)).drop("_front", "_fence", "_fences")


def _changes_state() -> Column:
    """Whether a line is the first, ends front matter, is a fence or a heading of level 2."""
    x = F.col("content")
    return (F.col("line") == 1) | x.startswith("---") | x.startswith("```") | x.startswith("## ")


def lines(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, line, content, zone, section) of the lines of Markdown texts.

    ``zone``: ``front`` from a first line ``---`` to the next that begins so, two lines on at least; ``code`` from a line that
    begins with three back-ticks to the next, or to the end; else ``body``. ``section``: the last heading of level 2 in the body
    so far, this line's included; null before the first.
    """
    rows = docs.where(F.col(text) != "").select(key, F.posexplode(F.split(text, "\n", -1)).alias("line", "content")).withColumn("line", F.col("line") + 1)
    return _states(rows, [key]).select(key, "line", "content", "zone", "section")


def _cells(x: Column) -> Column:
    """The first cell of a table's row if it is a chapter's number, else an empty text."""
    return F.regexp_extract(x, r"^\s*\|\s*(\d+[-\d]*)\s*\|", 1)


def _any_of(words: list[str]) -> Column:
    """Whether a line holds one of the words."""
    return reduce(Column.__or__, (F.col("content").contains(w) for w in words))


def _words() -> Column:
    """(detail, n) of the placeholders in a line."""
    counted = (F.struct(F.lit(w).alias("detail"), F.regexp_count("content", F.lit(f"\\Q{w}\\E")).alias("n")) for w in rules.MARKDOWN_PLACEHOLDERS)
    return F.filter(F.array(*counted), lambda w: w["n"] > 0)


def _bits(conditions: Iterable[Column]) -> Column:
    """Conditions as the bits of a number, the first lowest."""
    return reduce(Column.__add__, (F.when(c, 1 << i).otherwise(0) for i, c in enumerate(conditions)))


def line_findings(found: DataFrame, key: str) -> DataFrame:
    """(key, line, zone, section, finding, detail, n) of ``found`` (:func:`lines`): placeholders, each word with its number in the line, and rows of the
    chapters' table that merge several."""
    words = F.array(*(F.struct(F.lit("placeholder").alias("finding"), F.lit(w).alias("detail"), F.regexp_count("content", F.lit(f"\\Q{w}\\E")).alias("n")) for w in rules.MARKDOWN_PLACEHOLDERS))
    cell = _cells(F.col("content"))
    merged = (F.col("zone") == "body") & F.col("section").contains("章节结构") & cell.rlike(r"^\d+-\d+")
    row = F.array(F.struct(F.lit("merged_chapter").alias("finding"), cell.alias("detail"), F.when(merged, 1).otherwise(0).alias("n")))
    return found.select(key, "line", "zone", "section", F.inline(F.filter(F.concat(words, row), lambda f: f["n"] > 0)))


def reports(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row for each text: valid, missing (fields and sections that are not there), placeholders (how many), first (the first five as ``line: word``),
    chapters, merged (numbers of chapters that stand for several), logic_blocks, book_links, total_chars, total_lines.

    A text is valid if it has front matter with every field, every section, and no merged chapter.
    """
    x, content = F.coalesce(F.col(text), F.lit("")), F.col("content")
    logic = r"\*\*底层逻辑\*\*：\n\n- \*\*前提假设\*\*：[^\n]*\n- \*\*推理链条\*\*：[^\n]*\n- \*\*核心结论\*\*："
    rows = F.split(x, "\n", -1)
    wholes = F.struct(
        F.length(x).alias("total_chars"), (F.size(rows) - 1).alias("total_lines"),
        F.regexp_count(x, F.lit(logic)).alias("logic_blocks"), F.regexp_count(x, F.lit(r"\[\[[^\n]*?\]\]")).alias("book_links"),
    )
    # texts without a key are told apart; a text's own numbers go with its first line
    nth = F.when(F.col(key).isNull(), F.monotonically_increasing_id()).alias("_nth")
    at = docs.select(key, nth, wholes.alias("_text"), (F.get(rows, 0) == "---").alias("_opens"), rows.alias("_rows"))
    at = at.select(key, "_nth", "_text", "_opens", F.posexplode("_rows").alias("line", "content")).withColumn("line", F.col("line") + 1)
    said, named = _any_of(rules.MARKDOWN_PLACEHOLDERS), F.col("_opens") & _any_of(rules.MARKDOWN_FIELDS)
    # lines are dealt out only if a report can depend on them, and what it needs of each
    at = at.where(_changes_state() | said | named | content.contains("|") | content.contains("## "))
    at = at.select(
        key, "_nth", "line", F.when(_changes_state() & ((F.col("line") > 1) | F.col("_opens") | content.startswith("```") | content.startswith("## ")), content).otherwise("").alias("content"),
        F.when(F.col("line") == 1, F.col("_text")).alias("_text"), F.when(said, _words()).alias("_words"), F.when(content.contains("|"), _cells(content)).otherwise("").alias("_cell"),
        F.when(named, _bits(content.contains(f) for f in rules.MARKDOWN_FIELDS)).otherwise(0).alias("_fields"),
        F.when(content.contains("## "), _bits(content.rlike(f"(?s)## .*{s}") for s in rules.MARKDOWN_SECTIONS)).otherwise(0).alias("_sections"),
    )
    found = _states(at, [key, "_nth"])
    front = F.col("zone") == "front"
    listing = (F.col("zone") == "body") & F.col("section").contains("章节结构") & (F.col("_cell") != "")
    # the first five of the places: of a line only if fewer than five are before it, so no text's findings are held at once
    earlier = Window.partitionBy(key, "_nth").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("_earlier", F.coalesce(F.sum(F.size("_words")).over(earlier), F.lit(0)))
    out = found.groupBy(key, "_nth").agg(
        F.max("_text").alias("_text"), F.max(front).alias("_front"), F.coalesce(F.bit_or(F.when(front, F.col("_fields"))), F.lit(0)).alias("_fields"), F.bit_or("_sections").alias("_sections"),
        F.coalesce(F.sum(F.aggregate("_words", F.lit(0), lambda n, w: n + w["n"])), F.lit(0)).alias("placeholders"),
        F.collect_list(F.when(F.col("_earlier") < 5, F.transform("_words", lambda w: F.struct(F.col("line").alias("line"), w["detail"].alias("detail"))))).alias("_places"),
        F.sum(F.when(listing, 1).otherwise(0)).alias("chapters"),
        F.transform(F.array_sort(F.collect_list(F.when(listing & F.col("_cell").rlike(r"^\d+-\d+"), F.struct("line", "_cell")))), lambda p: p["_cell"]).alias("merged"),
    )
    lacks = [F.when(~F.col("_front"), F.lit("front matter"))]
    lacks += [F.when(F.col(c).bitwiseAND(1 << i) == 0, F.lit(n)) for c, names in (("_fields", rules.MARKDOWN_FIELDS), ("_sections", rules.MARKDOWN_SECTIONS)) for i, n in enumerate(names)]
    first = F.transform(F.slice(F.array_sort(F.flatten("_places")), 1, 5), lambda p: F.concat_ws(": ", p["line"].cast("string"), p["detail"]))
    return out.withColumn("missing", F.filter(F.array(*lacks), lambda m: m.isNotNull())).select(
        key, ((F.size("missing") == 0) & (F.size("merged") == 0)).alias("valid"), "missing", "placeholders", first.alias("first"),
        "chapters", "merged", "_text.logic_blocks", "_text.book_links", "_text.total_chars", "_text.total_lines",
    )
