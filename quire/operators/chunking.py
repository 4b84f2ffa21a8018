"""Overlapping chunks that end at headings where they can, and outlines of nested headings.

Chunks are cut inside the row of their text, by a fold over as many steps as there can be chunks: no shuffle, no Python.
Outlines order the headings of each text by a window; a text is a row, so what one window holds is bounded by a row.

Defined cases: null and empty texts have no chunks and no headings; repeated rows are rows like any other (outlines: give
them different keys); an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import rules
from quire.functions.text import strip

CHUNK = "struct<chunk_index:int,start:int,end:int,content:string>"


#: Put before a number sign that is no heading.
_MARK = "\x00"


def _last_start(region: Column, pattern: str) -> Column:
    """Characters before the last of a pattern's matches, found from the left without overlap; null without a match."""
    found = F.regexp_extract_all(region, F.lit(pattern), F.lit(0))
    after = F.element_at(F.split(region, pattern, -1), -1)
    return F.when(F.size(found) > 0, F.length(region) - F.length(after) - F.length(F.element_at(found, -1)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), body), 0)


def _successor(text: Column, n: Column, at: Column, size: int, overlap: int) -> Column:
    """Where the chunk of a text of length ``n`` that begins at ``at`` ends.

    ``size`` further on, or the end of the text; before the end of the text at the last heading around that place that is
    beyond half the size, by the last of the heading patterns that has one there.
    """
    end = at + size
    low = F.greatest(at, end - 2 * overlap)

    def last(region: Column) -> Column:
        cuts = (_let(low + _last_start(region, p), lambda c: F.when(c > at + size // 2, c)) for p in reversed(rules.CHUNK_HEADINGS))
        return F.coalesce(*cuts, end)

    return F.when(end >= n, n).otherwise(_let(F.substring(text, low + 1, F.least(end + overlap, n) - low), last))


def overlapping_chunks(text: Column | str, size: int = 50_000, overlap: int = 2_000) -> Column:
    """Array of (chunk_index, start, end, content): chunks of about ``size`` characters, each beginning with the last ``overlap`` before it.

    A text of at most ``size`` characters is one chunk. ``start`` counts the overlap in; chunks without their overlaps make
    up the text. A text of fewer than ``size`` + 1 characters is not searched for headings.
    """
    x = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    # every chunk but the last is longer than half the size
    begin = F.struct(F.lit(0).alias("at"), F.length(x).alias("n"), F.array().cast(f"array<{CHUNK}>").alias("out"))

    def step(state: Column) -> Column:
        def grown(end: Column) -> Column:
            start = F.greatest(F.lit(0), state["at"] - overlap)
            chunk = F.struct(F.size(state["out"]).alias("chunk_index"), start.alias("start"), end.alias("end"), F.substring(x, start + 1, end - start).alias("content"))
            return F.struct(end.alias("at"), state["n"].alias("n"), F.concat(state["out"], F.array(chunk)).alias("out"))

        return _let(_successor(x, state["n"], state["at"], size, overlap), grown)

    steps = F.sequence(F.lit(1), F.floor(F.length(x) / (size // 2 + 1)).cast("int") + 1)
    cut = F.aggregate(steps, begin, lambda s, _: F.when(s["at"] < s["n"], step(s)).otherwise(s), lambda s: s["out"])
    whole = F.array(F.struct(F.lit(0).alias("chunk_index"), F.lit(0).alias("start"), F.length(x).alias("end"), x.alias("content")))
    return F.when(F.length(x) == 0, F.array().cast(f"array<{CHUNK}>")).when(F.length(x) <= size, whole.cast(f"array<{CHUNK}>")).otherwise(cut)


def sections(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, ordinal, level, title, body) of Markdown texts, cut at headings of every level; ordinal 0 is what is before the first, level 0.

    Lines inside code fences are no headings.
    """
    x = F.coalesce(F.col(text), F.lit(""))
    # within a fence, lines are marked so that they do not look like headings; lines that look marked get one more mark
    parts = F.split(F.concat(F.lit("\n"), F.regexp_replace(x, f"(?md)^(?={_MARK}+#)", _MARK)), "(?md)^(?=```)", -1)
    marked = F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.regexp_replace(p, "(?md)^(?=#)", _MARK)).otherwise(p))
    pieces = F.split(F.substring(F.array_join(marked, ""), 2, 2**31 - 1), "(?md)^(?=#{1,6}[ \\t])", -1)
    has_head = F.element_at(pieces, 1).rlike("(?d)^#{1,6}[ \\t]")
    pieces = F.when(has_head, F.concat(F.array(F.lit("")), pieces)).otherwise(pieces)
    rows = docs.where(x != "").select(key, F.posexplode(pieces).alias("ordinal", "p"))
    head = F.when(F.col("ordinal") > 0, F.regexp_extract("p", "(?d)^(#{1,6})[ \\t]", 1)).otherwise("")
    title = F.when(F.col("ordinal") > 0, strip(F.regexp_replace(F.regexp_extract("p", "(?d)^#{1,6}[ \\t]+([^\\n]*)", 1), "[ \\t]+#+[ \\t]*$", ""))).otherwise("")
    body = F.regexp_replace(F.when(F.col("ordinal") > 0, F.regexp_replace("p", "(?d)^[^\\n]*\\n?", "")).otherwise(F.col("p")), f"(?md)^{_MARK}(?={_MARK}*#)", "")
    return rows.select(key, "ordinal", F.length(head).alias("level"), title.alias("title"), body.alias("body"))


def outline(found: DataFrame, key: str) -> DataFrame:
    """``found`` (key, ordinal, level, title, ...) with parent (ordinal of the nearest earlier heading of a smaller level) and path (titles from the top).

    The last heading of each level so far is carried along; one of them is an ancestor exactly if it comes after the last
    of every smaller level.
    """
    so_far = Window.partitionBy(key).orderBy("ordinal").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.struct("ordinal", "title")), ignorenulls=True).over(so_far) for k in range(1, 6)]
    rows = found.select("*", *(c.alias(f"_l{k}") for k, c in enumerate(last, 1)))

    def at(k: int) -> Column:
        return F.coalesce(F.col(f"_l{k}.ordinal"), F.lit(-1))

    def ancestor(k: int) -> Column:
        later = reduce(lambda p, q: p & q, (at(k) > at(j) for j in range(1, k)), at(k) >= 0)
        return F.when(later & (F.col("level") > k), F.col(f"_l{k}"))

    chain = F.filter(F.array(*map(ancestor, range(1, 6))), lambda a: a.isNotNull())
    path = F.when(F.col("level") > 0, F.concat(F.transform(chain, lambda a: a["title"]), F.array("title"))).otherwise(F.array().cast("array<string>"))
    return rows.select(*found.columns, F.get(chain, F.size(chain) - 1)["ordinal"].alias("parent"), path.alias("path"))
