"""Recognising, aligning and resolving entities."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import scratch
from quire.functions import rules
from quire.functions.text import normal_name
from quire.operators.graph import first_come
from quire.operators.retrieval import cosine

#: Most terms of a dictionary that is sent to every task; a larger one is refused.
DICTIONARY_LIMIT = 1_000_000

#: Rows of a block of vectors that are compared with another block at once.
BLOCK = 512

MENTION = "doc_id long, text string, type string, start int, end int, confidence double"


def dictionary_mentions(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Mentions of ``terms`` (type, term) in docs (doc_id, text): all occurrences, overlapping ones too, in code points.

    One automaton over all terms, so a text is read once whatever the number of terms. The terms are counted first, and
    more than DICTIONARY_LIMIT are refused. Null texts and empty terms have no mentions.
    """
    rows = terms.where("term is not null and term <> ''").select("term", "type").distinct().limit(DICTIONARY_LIMIT + 1).collect()
    if len(rows) > DICTIONARY_LIMIT:
        raise ValueError(f"the dictionary has more than {DICTIONARY_LIMIT} terms")
    table: dict[str, list[str]] = {}
    for term, kind in sorted((r[0], r[1]) for r in rows):
        table.setdefault(term, []).append(kind)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for term in table:
            automaton.add_word(term, term)
        if table:
            automaton.make_automaton()
        for b in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for last, term in automaton.iter(text) if table and text else ():
                    for kind in table[term]:
                        for column, value in zip(out, (doc, term, kind, last + 1 - len(term), last + 1)):
                            column.append(value)
            kinds = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(out, kinds)), pa.array([rules.TERM_CONFIDENCE] * len(out[0]), pa.float64())], names=["doc_id", "text", "type", "start", "end", "confidence"])

    return docs.select("doc_id", "text").mapInArrow(find, MENTION)


def pattern_mentions(docs: DataFrame, patterns: list[tuple[str, str, float]] | None = None) -> DataFrame:
    """Mentions by pattern (type, expression whose first group is the name, confidence): works in brackets, named speakers.

    Built from splits at the matches, so offsets need no Python: a piece's start is the summed length of what precedes it.
    """
    patterns = patterns or [("著作", rules.WORK_PATTERN, rules.WORK_CONFIDENCE), ("人物", rules.PERSON_PATTERN, rules.PERSON_CONFIDENCE)]
    out = None
    for kind, pattern, confidence in patterns:
        whole, name = (F.regexp_extract_all("text", F.lit(pattern), F.lit(g)) for g in (0, 1))
        gaps = F.split("text", pattern, -1)
        lead = F.transform(gaps, F.length)
        cells = F.zip_with(F.zip_with(whole, name, lambda w, n: F.struct(w.alias("w"), n.alias("n"))), F.slice(lead, 1, F.greatest(F.size(whole), F.lit(1))), lambda x, g: F.struct(x["w"].alias("w"), x["n"].alias("n"), g.alias("g")))
        found = docs.where(F.col("text").rlike(pattern)).select("doc_id", F.posexplode(cells).alias("i", "m"))
        before = F.coalesce(F.sum(F.col("m.g") + F.length("m.w")).over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        start = (before + F.col("m.g") + F.instr(F.col("m.w"), F.col("m.n")) - 1).cast("int")
        one = found.select("doc_id", F.col("m.n").alias("text"), F.lit(kind).alias("type"), start.alias("start"), (start + F.length("m.n")).cast("int").alias("end"), F.lit(confidence).alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


def best_mentions(mentions: DataFrame) -> DataFrame:
    """One mention of each place: the most confident, ties by text and type."""
    w = Window.partitionBy("doc_id", "start", "end").orderBy(F.desc("confidence"), "text", "type")
    return mentions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def merge_entities(entities: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """(name, type, description, source_count, merged_from) of entities (ordinal, name, type, description) by normal name.

    An entity alone under its normal name keeps its own. Descriptions are joined by newlines in order; the type is the most frequent, ties to the smaller, none being 未知.
    """
    named = entities.withColumn("key", normal_name("name", aliases)).withColumn("kind", F.coalesce("type", F.lit("未知")))
    votes = named.groupBy("key", "kind").agg(F.count(F.lit(1)).alias("n"))
    kind = votes.groupBy("key").agg(F.min_by("kind", F.struct(-F.col("n"), F.col("kind"))).alias("type"))
    parts = F.array_sort(F.collect_list(F.struct("ordinal", "name", "description")))
    merged = named.groupBy("key").agg(parts.alias("p")).select(
        "key",
        F.array_join(F.filter(F.transform("p", lambda x: x["description"]), lambda d: F.coalesce(d, F.lit("")) != ""), "\n").alias("description"),
        F.size("p").alias("source_count"),
        F.array_distinct(F.transform("p", lambda x: x["name"])).alias("merged_from"),
    )
    alone = F.col("source_count") == 1
    return merged.join(kind, "key").select(F.when(alone, F.col("merged_from")[0]).otherwise(F.col("key")).alias("name"), "type", "description", "source_count", "merged_from")


def _near_pairs(items: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs of items (item_id, vector) with a < b and a cosine of at least ``threshold``, all compared.

    Vectors are packed in blocks of about BLOCK rows of one length, and each pair of blocks is one matrix product in double
    precision. Items without a vector, or with one that is empty, has a null or no length, have no pair.
    """
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    unit = items.select("item_id", F.col("vector").cast("array<double>").alias("v")).where("item_id is not null and size(v) > 0").withColumn("n", norm).where("n > 0")
    unit = scratch.materialize(unit.select("item_id", "v", "n", F.size("v").alias("dim")), "vectors")
    parts = max(1, -(-unit.count() // BLOCK))
    packed = unit.groupBy("dim", F.pmod(F.xxhash64("item_id"), F.lit(parts)).alias("part")).agg(F.collect_list("item_id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs"), F.collect_list("n").alias("ns"))
    packed = scratch.materialize(packed.repartition(parts, "part", "dim"), "blocks")
    left, right = (packed.select(*(F.col(c).alias(f"{c}_{side}") for c in ("dim", "part", "ids", "vs", "ns"))) for side in "xy")
    # no key to shuffle by: blocks of one length would all meet in one task
    pairs = left.join(right, (F.col("dim_x") - F.col("dim_y") == 0) & (F.col("part_x") <= F.col("part_y")))
    found = pairs.select("part_x", "part_y", "ids_x", "vs_x", "ns_x", "ids_y", "vs_y", "ns_y")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                px, py, ids_x, vs_x, ns_x, ids_y, vs_y, ns_y = (batch.column(c)[i] for c in range(8))
                ids_x, ids_y, n, m = ids_x.values, ids_y.values, len(ns_x), len(ns_y)
                x, y = vs_x.values.to_numpy().reshape(n, -1), vs_y.values.to_numpy().reshape(m, -1)
                hit = (x @ y.T) / (ns_x.values.to_numpy()[:, None] * ns_y.values.to_numpy()) >= threshold
                r, c = np.nonzero(np.triu(hit, 1) if px == py else hit)
                if len(r):
                    yield pa.RecordBatch.from_arrays([ids_x.take(pa.array(r)), ids_y.take(pa.array(c))], names=["a", "b"])

    kind = items.schema["item_id"].dataType
    out = found.mapInArrow(compare, T.StructType([T.StructField("a", kind), T.StructField("b", kind)])).where("a <> b")
    return out.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def leaders(items: DataFrame, threshold: float) -> DataFrame:
    """(item_id, leader): in order of id an item joins the first earlier leader with a cosine of at least ``threshold``,
    else leads itself. Items without a vector, or without an id, lead themselves.

    The similarity join's links are worked off in rounds until no item is open: see :func:`quire.operators.graph.first_come`.
    Links come from a join on a coarse key where ``items`` has a column ``block``, else from all pairs of the table.
    """
    block = "block" if "block" in items.columns else None
    if block:
        a, b = (items.select(F.col("item_id").alias(i), F.col("vector").alias(v), F.col(block).alias(f"block_{i}")) for i, v in (("a", "va"), ("b", "vb")))
        links = a.join(b, (F.col("a") < F.col("b")) & (F.col("block_a") == F.col("block_b"))).where(cosine(F.col("va"), F.col("vb")) >= threshold).select("a", "b")
    else:
        links = _near_pairs(items, threshold)
    links = scratch.materialize(links, "links")
    led = first_come(items.select(F.col("item_id").alias("node")), links.select(F.col("b").alias("node"), F.col("a").alias("other"))).select(F.col("node").alias("item_id"))
    first = links.join(led.select(F.col("item_id").alias("a")), "a").groupBy(F.col("b").alias("item_id")).agg(F.min("a").alias("leader"))
    own = led.unionByName(items.select("item_id").where("item_id is null")).select("item_id", F.col("item_id").alias("leader"))
    return own.unionByName(first.join(led, "item_id", "left_anti"))


def located(spans: DataFrame, texts: DataFrame) -> DataFrame:
    """Spans (doc_id, span) with ``start`` and ``end`` of their first exact place in the text; null where there is none."""
    at = F.expr("nullif(locate(span, text), 0) - 1")
    return spans.join(texts.select("doc_id", "text"), "doc_id", "left").withColumn("start", at).withColumn("end", F.col("start") + F.length("span")).drop("text")


def aligned(spans: DataFrame, accept: float = 0.75) -> DataFrame:
    """(…, start, end, ratio, status) of spans (span, text): exact place, else the window with the longest common
    subsequence. Windows are 1.5 spans wide and a quarter apart; under ``accept`` a span is ungrounded.

    status: exact, fuzzy, lesser (shorter than the span), greater (longer), ungrounded.
    """

    def ratio(a: np.ndarray, b: np.ndarray) -> float:
        row = np.zeros(len(b) + 1, np.int32)
        for x in a:  # one row of the table at a time: the running maximum carries the left neighbour
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], np.where(b == x, row[:-1] + 1, 0)))
        return row[-1] / len(a)

    def place(span: str | None, text: str | None):
        if not span or not text:
            return None, None, 0.0, "ungrounded"
        at = text.find(span)
        if at >= 0:
            return at, at + len(span), 1.0, "exact"
        s, t = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (span, text))
        m = len(s)
        width, best = max(1, m * 3 // 2), (0.5, None)
        for i in range(0, max(1, len(t) - m // 2), max(1, m // 4)):
            if (r := ratio(s, t[i : i + width])) > best[0]:
                best = (r, i)
        if best[1] is None or best[0] < accept:
            return None, None, float(best[0] if best[1] is not None else 0.0), "ungrounded"
        window = text[best[1] : best[1] + width]
        i, j = max(window.find(span[0]), 0), window.rfind(span[-1])
        i, j = best[1] + i, best[1] + (j + 1 if j >= i else len(window))
        return i, j, float(best[0]), "lesser" if j - i < m else "greater" if j - i > m else "fuzzy"

    keep = spans.columns
    at, text_at = keep.index("span"), keep.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [place(*x) for x in zip(b.column(at).to_pylist(), b.column(text_at).to_pylist())]
            cols = list(zip(*out)) if out else [[], [], [], []]
            kinds = (pa.int32(), pa.int32(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[*keep, "start", "end", "ratio", "status"])

    from pyspark.sql import types as T

    extra = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("ratio", T.DoubleType()), T.StructField("status", T.StringType())]
    return spans.mapInArrow(run, T.StructType([*spans.schema.fields, *extra]))


def first_pass_wins(spans: DataFrame) -> DataFrame:
    """Spans (doc_id, pass, ordinal, start, end) that overlap no span accepted before them; the first pass stays whole.

    Half-open, so touching spans do not overlap. Later spans come in order of pass and ordinal; unlocated ones go. A
    document's spans are folded in one row.
    """
    rows = spans.where("start is not null and end is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pass", "ordinal", "start", "end"))).alias("s"))
    first = F.array_min(F.transform("s", lambda x: x["pass"]))

    def step(kept, x):
        free = (x["pass"] == first) | ~F.exists(kept, lambda k: (k["start"] < x["end"]) & (x["start"] < k["end"]))
        return F.when(free, F.concat(kept, F.array(x))).otherwise(kept)

    kept = F.aggregate("s", F.slice("s", 1, 0), step)
    return rows.select("doc_id", F.inline(kept))
