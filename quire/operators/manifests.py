"""Rule manifests: axioms with severities over paths such as ``chapters[*].title``, compiled into expressions over VARIANT documents.

One pass over the documents checks all axioms: a path becomes nested transforms, a test a predicate over the values it meets.

Defined cases: a null document breaks no axiom but those that ask for something to be there. A path meets nothing where a
field on it is absent or is no list although ``[*]`` follows; a value of JSON null is absent.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import rules
from quire.functions.text import quoted
from quire.operators.normalising import at, kind

_FOUND = "array<struct<place:string,value:string>>"


@dataclass(frozen=True)
class Axiom:
    """A rule: what no value on ``paths`` may be (``test`` of its text) or, with ``absent``, what must be there as well."""

    id: str
    severity: str
    paths: tuple[str, ...]
    test: object
    absent: bool = False


def _steps(path: str) -> list[str]:
    if not re.fullmatch(r"\w+(\[\*\])?(\.\w+(\[\*\])?)*", path):
        raise ValueError(f"not a path: {path}")
    return re.findall(r"\w+|\[\*\]", path)


def values(doc: Column, path: str, absent: bool = False) -> Column:
    """Array of (place, value): the values that a path meets, with their places (``chapters[3].title``).

    With ``absent``, a last field that is not there is met as well, with a null value.
    """

    def walk(v: Column, place: Column, steps: list[str]) -> Column:
        if not steps:
            text = F.try_variant_get(v, "$", "string")
            there = (kind(v) != "VOID") & v.isNotNull()
            one = F.array(F.struct(place.alias("place"), text.alias("value"))).cast(_FOUND)
            if absent:
                return F.when(F.coalesce(there, F.lit(False)), one).otherwise(F.array(F.struct(place.alias("place"), F.lit(None).cast("string").alias("value"))).cast(_FOUND))
            return F.when(F.coalesce(there, F.lit(False)), one).otherwise(F.array().cast(_FOUND))
        if steps[0] == "[*]":
            items = F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array().cast("array<variant>"))
            return F.flatten(F.transform(items, lambda x, i: walk(x, F.concat(place, F.lit("["), i.cast("string"), F.lit("]")), steps[1:])))
        return walk(at(v, steps[0]), F.concat(place, F.lit("." + steps[0])), steps[1:])

    met = walk(doc, F.lit(""), _steps(path))
    return F.transform(met, lambda f: F.struct(F.substring(f["place"], 2, 2**31 - 1).alias("place"), f["value"].alias("value")))


def shorter(n: int):
    return lambda x: F.length(F.coalesce(x, F.lit(""))) < n


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).isin("", "[]", "{}")


def has(words: list[str]):
    return lambda x: F.coalesce(x, F.lit("")).rlike(quoted(words))


def like(patterns: list[str]):
    return lambda x: F.coalesce(x, F.lit("")).rlike("^(?:" + "|".join(patterns) + ")")


def unlike(pattern: str):
    return lambda x: (F.coalesce(x, F.lit("")) != "") & ~F.coalesce(x, F.lit("")).rlike(pattern)


#: The manifest of a book's analysis.
BOOK_AXIOMS = (
    Axiom("no-placeholder-pollution", "blocking", ("metadata.title", "metadata.author", "chapters[*].core_argument", "core_concepts[*].definition", "key_quotes[*].text"), has(rules.AXIOM_PLACEHOLDERS)),
    Axiom("no-chapter-merge", "blocking", ("chapters[*].chapter_number", "chapters[*].title"), like(rules.MERGED)),
    Axiom("no-empty-chapters", "blocking", ("chapters[*].core_argument", "chapters[*].underlying_logic"), shorter(50)),
    Axiom("no-template-content", "blocking", ("chapters[*].title", "key_insights[*].description"), has(rules.TEMPLATES)),
    Axiom("concept-definition-depth", "warning", ("core_concepts[*].definition", "core_concepts[*].deep_meaning"), shorter(30)),
    Axiom("quote-source-attribution", "warning", ("key_quotes[*].chapter", "key_quotes[*].background_context", "key_quotes[*].underlying_logic"), blank, absent=True),
    Axiom("critical-analysis-coverage", "warning", ("critical_analysis.feminist_perspective", "critical_analysis.postcolonial_perspective"), shorter(51), absent=True),
    Axiom("underlying-logic-format", "warning", ("chapters[*].underlying_logic", "core_concepts[*].underlying_logic"), unlike(rules.LOGIC)),
    Axiom("required-fields-completeness", "blocking", tuple(rules.TOP_FIELDS), lambda x: x.isNull(), absent=True),
)


def _broken(doc: Column, a: Axiom, path: str) -> Column:
    bad = F.filter(values(doc, path, a.absent), lambda f: a.test(f["value"]))
    return F.transform(bad, lambda f: F.struct(F.lit(a.id).alias("axiom"), F.lit(a.severity).alias("severity"), f["place"].alias("place")))


def findings(doc: Column, axioms=BOOK_AXIOMS) -> Column:
    """Array of (axiom, severity, place): every value that breaks an axiom, in the manifest's order."""
    return F.concat(*(_broken(doc, a, p) for a in axioms for p in a.paths))


def coverage(doc: Column, expected: Column, least: float = 0.8) -> Column:
    """Array of (axiom, severity, place): one if fewer than ``least`` of the ``expected`` chapters are there; none where no number is expected."""
    n = F.size(F.coalesce(F.try_variant_get(doc, "$.chapters", "array<variant>"), F.array().cast("array<variant>")))
    one = F.array(F.struct(F.lit("chapter-coverage-rate").alias("axiom"), F.lit("warning").alias("severity"), F.lit("chapters").alias("place")))
    return F.when((expected > 0) & (n < expected * F.lit(least)), one).otherwise(F.array().cast("array<struct<axiom:string,severity:string,place:string>>"))


def verdicts(books: DataFrame, doc: str, expected: Column | None = None) -> DataFrame:
    """``books`` with blocking and warnings (how many findings of each severity) and keeps: within bounds, without a blocking one."""
    found = findings(F.col(doc)) if expected is None else F.concat(findings(F.col(doc)), coverage(F.col(doc), expected))

    def count(severity: str) -> Column:
        return F.size(F.filter("_found", lambda f: f["severity"] == severity))

    return books.withColumn("_found", found).select(*books.columns, count("blocking").alias("blocking"), count("warning").alias("warnings"), (count("blocking") == 0).alias("keeps"))
