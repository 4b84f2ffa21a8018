from __future__ import annotations

import itertools
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from quire.llm import kernels, language, quality
from quire.llm.crf import LinearChain
from quire.llm.folds import held_out
from tests.llm import edge

DATA = "/root/testdata/sf0.01"


def test_language_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    found = language.identify(docs, language.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id")
    rows = found.where(held_out(F.col("doc_id"))).select("lang_pred", "lang", "score").collect()
    assert len(rows) > 100
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_filters_return_all_languages_of_a_gram():
    f = language.LanguageFilters(["the river"] * 3 + ["la river"] * 3 + ["der fluss"] * 3, ["en"] * 3 + ["fr"] * 3 + ["de"] * 3)
    data, offsets = kernels.strings(pa.array(["river"], pa.large_string()))
    masks = f.languages(language.grams(data, offsets)[0])
    both = (1 << f.names.index("en")) | (1 << f.names.index("fr"))
    assert masks.shape == (1, 3)
    assert all(int(m) & both == both for m in masks[0])


def plain_grams(text):
    folded = "".join(chr(b) if b > 127 or chr(b).isalpha() else " " for b in text.lower().encode())
    out = []
    for word in folded.split(" "):
        framed = f" {word} "
        out += [framed] if 3 <= len(framed) < language.GRAM else [framed[i : i + language.GRAM] for i in range(len(framed) - language.GRAM + 1)] if word else []
    return out


def test_language_against_plain_sets(spark):
    """Scores and decisions are those of sets instead of filters, within the filters' false positives."""
    rows = spark.read.parquet(f"{DATA}/documents.parquet").select("text", "lang").where("lang is not null and text is not null").collect()
    learn, asked = rows[:400], rows[400:600]
    f = language.LanguageFilters([r.text for r in learn], [r.lang for r in learn])
    known = {}
    for name in f.names:
        counts = Counter(g for r in learn if r.lang == name for g in plain_grams(r.text))
        known[name] = {g for g, n in counts.items() if n >= min(language.LEAST, 1 + (sum(r.lang == name for r in learn) + 1) // language.FEW)}
    column = pa.array([r.text for r in asked], pa.string())
    best, score, total = language._predict(f, column)
    for r, b, s, n in zip(asked, best, score, total, strict=True):
        grams = plain_grams(r.text)
        assert n == len(grams)
        if grams and re.search(r"[^\W\d_]", r.text):
            share = {name: sum(g in known[name] for g in grams) / len(grams) for name in f.names}
            top = max(share.values())
            assert abs(s - top) <= 0.02 + 2 / len(grams)
            assert share[f.names[b]] >= top - 0.02 - 2 / len(grams)


def test_many_languages_and_ties():
    names = [f"l{k:03}" for k in range(150)]
    texts = [" ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}{x}" for x in ("alpha", "beta", "gamma")) for k in range(150)]
    f = language.LanguageFilters([t for t in texts for _ in range(3)], [n for n in names for _ in range(3)])
    best, score, _ = language._predict(f, pa.array(texts, pa.string()))
    assert [f.names[b] for b in best] == names
    assert min(score) > 0.9
    tied = language.LanguageFilters(["la casa"] * 9, ["it"] * 3 + ["es"] * 3 + ["zz"] * 3)
    assert [tied.names[b] for b in language._predict(tied, pa.array(["la casa", "unknown words"]))[0]] == ["es", "es"]


def test_short_clean_texts_stay(spark):
    rows = [(i, t) for i, t in enumerate(["Re.", "A.", "Ok no", "le la", "The house by the river was sold"])]
    f = language.LanguageFilters(["the house by the river was sold in the spring"] * 3, ["en"] * 3)
    kept = language.keep_identified(spark.createDataFrame(rows, "doc_id long, text string"), f, 0.3).collect()
    assert [r.doc_id for r in kept] == [0, 1, 2, 3, 4]


def test_language_of_awkward_rows(spark):
    f = language.fit(edge.table(spark), each=100)
    got = {r.doc_id: r for r in language.identify(edge.table(spark), f).collect()}
    assert {i for i, r in got.items() if r.lang_pred == "und"} == {2, 3, 4, 8}
    assert all(got[i].score == 0 for i in (2, 3, 4, 8))
    assert language.identify(edge.empty(spark), f).collect() == []
    none = language.fit(edge.empty(spark))
    assert {r.lang_pred for r in language.identify(edge.table(spark), none).collect()} == {"und"}
    kept = language.keep_identified(edge.table(spark), f, 0.0)
    assert kept.columns == edge.table(spark).columns
    assert {2, 3, 4, 8}.isdisjoint(r.doc_id for r in kept.collect())


def test_chain_is_exact():
    rng = np.random.default_rng(0)
    c = LinearChain(6)
    c.w, c.trans, c.start = rng.normal(size=(6, 2)), rng.normal(size=(2, 2)), rng.normal(size=2)
    lengths = np.array([3, 0, 5, 1, 4])
    f = rng.integers(0, 6, (lengths.sum(), 2))
    marginal, _, log_z = c.forward_backward(c.scores(f), lengths)
    path, at, total = c.decode(f, lengths), 0, 0.0
    for n in lengths.tolist():
        if not n:
            continue
        e = c.scores(f[at : at + n])
        scores = {y: c.start[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(c.trans[y[i - 1], y[i]] for i in range(1, n)) for y in itertools.product((0, 1), repeat=n)}
        z = np.logaddexp.reduce(list(scores.values()))
        total += z
        for i in range(n):
            assert np.isclose(marginal[at + i, 1], sum(np.exp(s - z) for y, s in scores.items() if y[i]))
        assert tuple(path[at : at + n]) == max(scores, key=scores.get)
        at += n
    assert np.isclose(total, log_z)


def plain_score(model, text):
    """The document score by enumerating all labellings of its lines."""
    data, offsets = kernels.strings(pa.array([text], pa.large_string()))
    f, weight, per_doc = quality.lines(data, offsets)
    c, n = model.chain, int(per_doc[0])
    e = c.scores(f)
    scores = {y: c.start[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(c.trans[y[i - 1], y[i]] for i in range(1, n)) for y in itertools.product((0, 1), repeat=n)}
    z = np.logaddexp.reduce(list(scores.values()))
    good = sum(weight[i] * sum(np.exp(s - z) for y, s in scores.items() if y[i]) for i in range(n)) / weight.sum()
    return float(1 / (1 + np.exp(-quality._shape(np.array([good])) @ model.curve))[0])


def test_document_score_is_the_weighted_marginal(spark):
    """The score of a short text against enumeration of all labellings of its lines."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    texts = ["A quiet house by the river.\nclick here | menu | login\nIt was sold in the spring.", "one line only", "x\n\nBuy now!!! $$$"]
    got = {r.doc_id: r.score for r in quality.classify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    for k, text in enumerate(texts):
        assert abs(got[k] - plain_score(model, text)) < 1e-9


def test_quality_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    found = quality.classify(docs, quality.fit(docs, labels)).join(labels, "doc_id").where(held_out(F.col("doc_id"))).select("score", "quality").collect()
    assert len(found) > 40
    assert np.mean([(r.score >= 0.3) == bool(r.quality) for r in found]) > 0.95


def test_quality_of_awkward_rows(spark):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(12)] + [(None, 1, 1), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(edge.table(spark), labels)
    got = quality.classify(edge.table(spark), model).collect()
    assert len(got) == len(edge.ROWS)
    assert all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (2, 3, 4)} == {model.prior}
    assert quality.classify(edge.empty(spark), model).collect() == []
    untaught = quality.fit(edge.empty(spark), labels)
    assert {r.score for r in quality.classify(edge.table(spark), untaught).collect()} == {0.5}
