"""Semi-structured model output: repair, parsing, field names, required fields."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire import scratch
from quire.functions import rules

_ALIASES = {alias: name for name, aliases in rules.FIELD_ALIASES.items() for alias in aliases}

#: Characters of an output that parses in no way that are kept.
RAW = 5000


def _outside_strings(text: str) -> str:
    """Comments and trailing commas outside strings removed, the open string and open brackets closed."""
    out, stack, i, quoted = [], [], 0, False
    while i < len(text):
        c = text[i]
        if quoted:
            out.append(c)
            if c == "\\" and i + 1 < len(text):
                i += 1
                out.append(text[i])
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
            out.append(c)
        elif text.startswith("//", i) or c == "#":
            i = text.find("\n", i)
            if i < 0:
                break
            continue
        elif text.startswith("/*", i):
            j = text.find("*/", i)
            i = len(text) if j < 0 else j + 1
        else:
            if c in "}]":
                while out and out[-1].isspace():
                    out.pop()
                if out and out[-1] == ",":
                    out.pop()
                if stack and stack[-1] == c:
                    stack.pop()
                elif c in stack:  # brackets left open inside are closed first
                    while stack[-1] != c:
                        out.append(stack.pop())
                    stack.pop()
                else:
                    i += 1
                    continue
            elif c in "{[":
                stack.append("}" if c == "{" else "]")
            out.append(c)
            if not stack and c in "}]":
                break  # what follows the document is prose
        i += 1
    if quoted:
        out.append('"')
    rest = re.sub(r'[,:\s]+$', "", "".join(out))
    return rest + "".join(reversed(stack))


def repair(text: str | None) -> str:
    """The JSON document in a model's output: fences, prose, bold keys, comments, trailing commas and lost ends mended."""
    s = text or ""
    fence = re.search(r"```(?:json)?\s*\n(.*?)(?:\n\s*```|\Z)", s, re.S)
    if fence and "{" in fence[1]:
        s = fence[1]
    start = s.find("{")
    if start < 0:
        return ""
    return _outside_strings(re.sub(r'\*\*("[^"\n]+")\s*(:?)\s*\*\*(\s*:?)', r"\1\2\3", re.sub(r'\*\*("[^"\n]+"\s*:)(?!\*\*)', r"\1", s[start:])))


def parse(text: str | None) -> tuple[dict, str]:
    """(document, status): parsed as it is, after repair, or kept raw."""
    for how, s in (("parsed", text or ""), ("repaired", repair(text))):
        try:
            doc = json.loads(s, strict=False)
        except ValueError:
            continue
        if isinstance(doc, dict):
            named: dict = {}
            for k, v in doc.items():
                named.setdefault(_ALIASES.get(k, k), v)
            return named, how
    return {"raw": (text or "")[:RAW]}, "raw"


def _parsed(x: pd.Series) -> pd.DataFrame:
    both = [parse(t) for t in x]
    return pd.DataFrame({"document": [json.dumps(d, ensure_ascii=False) for d, _ in both], "status": [s for _, s in both]})


def parsed(x: Column | str) -> Column:
    """(document, status) of model outputs: JSON with canonical field names."""
    return F.pandas_udf(_parsed, "struct<document:string,status:string>")(F.col(x) if isinstance(x, str) else x)


def missing_fields(document: Column, kind: str) -> Column:
    """The required fields of a kind of output that a JSON document lacks or leaves empty."""
    lacking = (F.when(F.coalesce(F.get_json_object(document, f"$.{f}"), F.lit("")).isin("", "[]", "{}"), F.lit(f)) for f in rules.MANDATORY[kind])
    return F.filter(F.array(*lacking) if rules.MANDATORY[kind] else F.array().cast("array<string>"), lambda f: f.isNotNull())


def coalesced(base: DataFrame, key: str, sources: list[DataFrame], fields: list[str]) -> DataFrame:
    """Every row's fields from itself, else from the first source (key, fields) that has them; empty texts are missing."""
    out = base
    for i, s in enumerate(sources):
        out = out.join(s.select(key, *(F.col(f).alias(f"_{i}_{f}") for f in fields)).dropDuplicates([key]), key, "left")
    rest = [c for c in base.columns if c not in fields]
    return out.select(*rest, *(F.coalesce(*(F.nullif(F.col(c), F.lit("")) for c in (f, *(f"_{i}_{f}" for i in range(len(sources)))) if c in out.columns)).alias(f) for f in fields))


def fix_items(assessed: DataFrame, key: str) -> DataFrame:
    """(key, priority, item): what to repair of assessed books, the most urgent first, then by book and in the rules' order."""
    s = F.col("stats")
    items = [
        ("CRITICAL", s["merged_chapters"] > 0, "merged_chapters"), ("CRITICAL", s["placeholder_chapters"] > 0, "placeholder_chapters"), ("CRITICAL", s["missing_fields"] > 0, "missing_fields"),
        ("HIGH", s["empty_chapters"] > 0.3 * s["chapters"], "empty_chapters"), ("HIGH", s["placeholder_leaves"] > 0, "placeholders"), ("HIGH", s["concepts"] < rules.MIN_CONCEPTS, "concepts"),
        ("MEDIUM", s["quotes"] < rules.MIN_QUOTES, "quotes"), ("MEDIUM", s["logic_ratio"] < 0.5, "logic_format"),
    ]
    cells = F.filter(F.array(*(F.when(c, F.struct(F.lit(p).alias("priority"), F.lit(i).alias("item"), F.lit(k).alias("_place"))) for k, (p, c, i) in enumerate(items))), lambda x: x.isNotNull())
    # the rules are worked out once, not again for the sort
    found = scratch.materialize(assessed.select(key, F.inline(cells)), "fix-items")
    urgent = F.array_position(F.array(*map(F.lit, ("CRITICAL", "HIGH", "MEDIUM"))), F.col("priority"))
    return found.orderBy(urgent, key, "_place").drop("_place")
