"""Queries of model output and of rule manifests over the generated tables, each with the SQL that must give the same rows."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import rules
from quire.operators import manifests, normalising
from quire.plans.catalog import register
from quire.session import load


def _any(words: list[str]) -> str:
    return "|".join(map(re.escape, words))


@register(
    "mended_properties",
    """WITH p AS (SELECT click_id, props, CASE WHEN props IS NULL OR NOT starts_with(props, '{') THEN 'none' WHEN json_valid(props) THEN 'parsed' WHEN json_valid(props || '}') THEN 'closed' ELSE 'cut' END AS status FROM clicks),
 d AS (SELECT click_id, status, CASE status WHEN 'parsed' THEN props WHEN 'closed' THEN props || '}' END AS x FROM p)
 SELECT click_id, status, CAST(json_extract_string(x, '$.k') AS BIGINT) AS k, json_extract_string(x, '$.device.os') AS os, json_extract_string(x, '$.device.ver') AS ver FROM d""",
)
def mended_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of every click, those of broken JSON too."""
    found = load(spark, sf_dir, "clicks").select("click_id", normalising.document("props").alias("d")).select("click_id", "d.status", "d.document")
    field = {"k": ("$.k", "long"), "os": ("$.device.os", "string"), "ver": ("$.device.ver", "string")}
    return found.select("click_id", "status", *(F.try_variant_get("document", path, kind).alias(name) for name, (path, kind) in field.items()))


def _json(x: Column) -> Column:
    """A text as JSON."""
    return normalising.once(F.to_json(F.array(x)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def _output() -> Column:
    """A model's output about a document: lines as concepts of several makes, within prose, with a comma too many or cut off, by the first letter."""

    def concept(line: Column) -> Column:
        own = F.struct(line.alias("name"), F.lit("略").alias("definition"), F.concat_ws("、", F.split(line, " ")).alias("core_drivers"), line.alias("development_stages"))
        return F.when(line == "", F.lit('"TBD"')).when(line.rlike("^[A-M]"), _json(line)).otherwise(F.to_json(own))

    def text(lines: Column, first: Column, head: Column) -> Column:
        parts = {
            "metadata": F.concat(F.lit('{"title": ['), head, F.lit(', "x"], "author": null}')),
            "core_concepts": F.concat(F.lit("["), F.array_join(F.transform(lines, concept), ", "), F.lit("]")),
            "key_insights": F.concat(F.lit('[{"title": "t", "multi_perspectives": '), head, F.lit("}]")),
            "critical_analysis": F.concat(F.lit('{"ethical_boundaries": '), head, F.lit(', "core_doubts": '), F.to_json(lines), F.lit("}")),
            "learning_path": F.concat(F.lit('{"beginner": '), head, F.lit(', "practice": '), F.to_json(lines), F.lit("}")),
            "key_quotes": F.lit('"none"'),
        }
        body = F.concat_ws(", ", *(F.concat(F.lit(f'"{k}": '), v) for k, v in parts.items()))
        return (
            F.when(first.rlike("^[A-F]"), F.concat(F.lit("Here it is:\n```json\n{"), body, F.lit("}\n```\nDone.")))
            .when(first.rlike("^[G-L]"), F.concat(F.lit("{"), body, F.lit(", // end\n}")))
            .when(first.rlike("^[M-R]"), F.concat(F.lit("{"), body))
            .otherwise(F.concat(F.lit("{"), body, F.lit("}")))
        )

    return normalising.once(_lines(), lambda lines: normalising.once(F.get(lines, 0), lambda first: normalising.once(_json(first), lambda head: text(lines, first, head))))


_EMPTY_TEXT = f"(?s)^\\s*(?:(?:{_any(rules.OUTPUT_PLACEHOLDERS)}).{{0,9}}|（(?:{_any(rules.OUTPUT_PLACEHOLDERS)})）)\\s*$"


@register(
    "normalised_outputs",
    f"""WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
 k AS (SELECT doc_id, s[1] AS head, s, list_filter(s, lambda x: NOT regexp_matches(x, '{_EMPTY_TEXT}')) AS clean FROM l),
 c AS (SELECT *, CASE WHEN regexp_matches(head, '{_EMPTY_TEXT}') THEN '' ELSE head END AS own, list_filter(list_transform(s, lambda x: CASE WHEN x = '' THEN NULL WHEN regexp_matches(x, '^[A-M]') THEN CASE WHEN NOT regexp_matches(x, '{_EMPTY_TEXT}') THEN [x, '', '', ''] END
   ELSE CASE WHEN regexp_matches(x, '{_EMPTY_TEXT}') THEN ['', '', '', ''] ELSE [x, '', array_to_string(list_filter(string_split(x, ' '), lambda w: w <> ''), '、'), x] END END), lambda y: y IS NOT NULL) AS rows FROM k)
 SELECT doc_id, CASE WHEN regexp_matches(head, '^[A-F]') THEN 'extracted' WHEN regexp_matches(head, '^[G-L]') THEN 'mended' WHEN regexp_matches(head, '^[M-R]') THEN 'closed' ELSE 'parsed' END AS status,
  md5(own) AS title, 'Unknown' AS author, CAST(len(rows) AS INTEGER) AS n_concepts, md5(array_to_string(list_transform(rows, lambda r: array_to_string(r, '|')), chr(10))) AS concepts, md5(own) AS other_view, md5(own) AS reasonable,
  md5(array_to_string(clean, chr(10))) AS doubts, md5(own) AS beginner, CAST(len(clean) AS INTEGER) AS n_practice, 0 AS n_quotes FROM c""",
)
def normalised_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outputs about every document, damaged in several ways, in the shape of a book."""
    found = load(spark, sf_dir, "documents").select("doc_id", normalising.document(_output()).alias("d"))
    books = found.select("doc_id", "d.status", normalising.book(F.col("d.document")).alias("b"))
    # parts of which several columns are made are columns themselves, so that each is shaped once
    parts = books.select("doc_id", "status", "b.metadata", "b.core_concepts", "b.key_insights", "b.critical_analysis", "b.learning_path", "b.key_quotes")

    def digest(x: Column) -> Column:
        return F.md5(x.cast("binary"))

    def concept(c: Column) -> Column:
        return F.concat_ws("|", c["name"], c["definition"], F.concat_ws("、", c["core_drivers"]), F.concat_ws("、", F.transform(c["development_stages"], lambda s: s["name"])))

    analysis = F.col("critical_analysis")
    return parts.select(
        "doc_id", "status", digest(F.col("metadata.title")).alias("title"), F.col("metadata.author").alias("author"), F.size("core_concepts").alias("n_concepts"),
        digest(F.array_join(F.transform("core_concepts", concept), "\n")).alias("concepts"), digest(F.get("key_insights", 0)["multi_perspectives"]["其他视角"]).alias("other_view"),
        digest(analysis["ethical_boundaries"]["reasonable"]).alias("reasonable"), digest(F.array_join(F.transform(analysis["core_doubts"], lambda q: q["question"]), "\n")).alias("doubts"),
        digest(F.get("learning_path.beginner", 0)).alias("beginner"), F.size("learning_path.practice").alias("n_practice"), F.size("key_quotes").alias("n_quotes"),
    )


def _book() -> Column:
    """A document as a book's analysis: a chapter of each line, concepts and quotes of some."""
    def chapter(line: Column, i: Column) -> Column:
        number = F.when(line.rlike("^[A-C]"), F.lit("1-3")).otherwise(F.concat(i.cast("string"), F.lit("")))
        logic = F.when(line.rlike("^[D-H]"), F.concat(F.lit("前提假设："), line)).otherwise(line)
        return F.struct(number.alias("chapter_number"), F.substring(line, 1, 30).alias("title"), line.alias("core_argument"), logic.alias("underlying_logic"))

    concepts = F.transform(F.filter(_lines(), lambda x: x.rlike("^[I-M]")), lambda x: F.struct(x.alias("definition"), F.lit(None).cast("string").alias("deep_meaning")))
    quotes = F.transform(F.filter(_lines(), lambda x: x.rlike("^[S-T]")), lambda x: F.struct(x.alias("text"), x.alias("chapter")))
    parts = F.struct(
        F.struct(F.get(_lines(), 0).alias("title"), F.lit(None).cast("string").alias("author")).alias("metadata"), F.transform(_lines(), chapter).alias("chapters"), concepts.alias("core_concepts"), quotes.alias("key_quotes"),
        F.array().cast("array<string>").alias("key_insights"), F.struct(F.col("text").alias("feminist_perspective")).alias("critical_analysis"),
    )
    return F.try_parse_json(F.to_json(parts))


_FORBIDDEN, _MERGED, _TEMPLATES = _any(rules.AXIOM_PLACEHOLDERS), "|".join(rules.MERGED), _any(rules.TEMPLATES)


@register(
    "manifest_verdicts",
    f"""WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
 c AS (SELECT *, list_filter(s, lambda x: regexp_matches(x, '^[I-M]')) AS k, list_filter(s, lambda x: regexp_matches(x, '^[S-T]')) AS q, list_transform(s, lambda x: CASE WHEN regexp_matches(x, '^[D-H]') THEN '前提假设：' || x ELSE x END) AS g FROM l),
 v AS (SELECT doc_id, (CASE WHEN regexp_matches(s[1], '{_FORBIDDEN}') THEN 1 ELSE 0 END) + len(list_filter(list_concat(s, k, q), lambda x: regexp_matches(x, '{_FORBIDDEN}')))
   + len(list_filter(s, lambda x: regexp_matches(x, '^[A-C]'))) + len(list_filter(s, lambda x: regexp_matches(x[1:30], '^(?:{_MERGED})'))) + len(list_filter(s, lambda x: length(x) < 50)) + len(list_filter(g, lambda x: length(x) < 50))
   + len(list_filter(s, lambda x: regexp_matches(x[1:30], '{_TEMPLATES}'))) + 2 AS blocking,
  len(list_filter(k, lambda x: length(x) < 30)) + 2 * len(q) + (CASE WHEN length(coalesce(text, '')) < 51 THEN 1 ELSE 0 END) + 1 + len(list_filter(g, lambda x: x <> '' AND NOT regexp_matches(x, '{rules.LOGIC}')))
   + (CASE WHEN len(s) < 6.4 THEN 1 ELSE 0 END) AS warnings FROM c)
 SELECT doc_id, CAST(blocking AS INTEGER) AS blocking, CAST(warnings AS INTEGER) AS warnings, blocking = 0 AS keeps FROM v""",
)
def manifest_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The findings of a book's manifest over every document taken as a book, eight chapters expected of each."""
    books = load(spark, sf_dir, "documents").select("doc_id", _book().alias("doc"))
    return manifests.verdicts(books, "doc", F.lit(8)).drop("doc")
