"""Rendering and writing: Markdown, JSON, mind maps, partitioned tables with upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import markdown_cell, mermaid_label, truncated
from quire.operators.series import latest


def section(title: str, lines: Column, empty: str = "") -> Column:
    """A second-level section of lines; ``empty`` where there are none."""
    lines = F.filter(lines, lambda s: F.coalesce(s, F.lit("")) != "")
    body = F.when(F.size(lines) > 0, F.array_join(lines, "\n")).otherwise(F.lit(empty))
    return F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n"))


def table(header: list[str], rows: Column) -> Column:
    """A Markdown table of rows, each an array of strings."""
    head = "| " + " | ".join(header) + " |\n|" + "---|" * len(header)
    body = F.array_join(F.transform(rows, lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, markdown_cell), " | "), F.lit(" |"))), "\n")
    return F.concat_ws("\n", F.lit(head), F.nullif(body, F.lit("")))


def book_markdown(title: Column, fields: dict[str, Column], sections: list[Column]) -> Column:
    """Front matter, a title and sections."""
    head = F.concat_ws("\n", *(F.concat(F.lit(f"{k}: "), F.coalesce(v.cast("string"), F.lit(""))) for k, v in fields.items()))
    return F.concat(F.lit("---\n"), head, F.lit("\n---\n\n# "), F.coalesce(title, F.lit("")), F.lit("\n\n"), F.array_join(F.array(*sections), "\n"))


def mind_map(root: Column, branches: list[tuple[str, Column, int]], width: int = 30) -> Column:
    """A Mermaid mind map of a root and named branches of items, the first so many of each."""
    parts = [F.concat(F.lit(f"    {name}"), F.array_join(F.transform(F.slice(items, 1, n), lambda s: F.concat(F.lit("\n      "), mermaid_label(s, width))), "")) for name, items, n in branches]
    return F.concat_ws("\n", F.lit("mindmap"), F.concat(F.lit("  root(("), mermaid_label(root, width), F.lit("))")), *parts)


def summary(title: Column, insights: Column, n: int = 5, width: int = 200) -> Column:
    """A short Markdown summary of the first insights (title, description)."""
    lines = F.transform(F.slice(insights, 1, n), lambda x: F.concat(F.lit("- **"), x["title"], F.lit("**: "), truncated(F.coalesce(x["description"], F.lit("")), width, "")))
    return F.concat_ws("\n\n", F.concat(F.lit("# "), title), F.nullif(F.array_join(lines, "\n"), F.lit("")))


def envelope(df: DataFrame, kind: str, fields: list[str] | None = None) -> DataFrame:
    """(json) of every row, or of some fields of it, in an envelope of its kind."""
    return df.select(F.to_json(F.struct(F.lit(kind).alias("type"), F.struct(*(fields or df.columns)).alias("data"))).alias("json"))


def write_partitioned(df: DataFrame, path: str, by: list[str], fmt: str = "parquet") -> None:
    """Replaces just the partitions that ``df`` has; the committer makes each write all or nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).format(fmt).save(path)


def upsert_sections(old: DataFrame, new: DataFrame) -> DataFrame:
    """Sections (book, section, body) with those of ``new`` in place of the old."""
    both = old.select("book", "section", "body", F.lit(0).alias("_v")).unionByName(new.select("book", "section", "body", F.lit(1).alias("_v")))
    return latest(both, ["book", "section"], ["_v", "body"]).drop("_v")
