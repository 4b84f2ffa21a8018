"""Queries of the training-data operators, as the driver registers them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import scratch
from quire.llm import alignment, decontaminate, html, intervals, jaccard, language, mixing, pieces, quality, secrets, token_counts, token_orc, vectors
from quire.llm.folds import held_out

VOCABULARY, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


@query
def op1_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    found = secrets.find_secrets(_read(spark, sf_dir, "documents"))
    base = digest(F.filter("spans", lambda s: s["kind"] != "markov"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(base.cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"), "n_markov")


@query
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = language.identify(docs, language.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


@query
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    found = quality.classify(docs, quality.fit(docs, _read(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "n_lines", "n_bad_lines")


@query
def op4_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(_read(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), F.explode(F.sequence(F.lit(1).cast("long"), F.col("m"))).alias("_row")).drop("_row")


@query
def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


@query
def op6_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query
def op7_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch.new_path(spark, "token-orc")
    token_orc.write_tokens(_read(spark, sf_dir, "documents"), path, public_tokenizers.path(VOCABULARY), end_id=2)
    return token_orc.digests(spark, path).drop("part")


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(_read(spark, sf_dir, "documents"), n=3, share=90)


@query
def op9_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), limit=512)


@query
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(_read(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.path(PIECES))


@query
def op12_piece_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(_read(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


@query
def op13_session_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return intervals.session_relations(*(_read(spark, sf_dir, t) for t in ("sales", "sale_lines", "clicks")))


ORACLE_SQL["op13_session_overlaps"] = intervals.SESSION_RELATIONS_SQL
QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
