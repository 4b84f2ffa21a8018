"""The corpus pipeline: from raw documents to token ids, in stages that each keep what the one before kept.

Each stage takes (spark, docs, sf_dir), ``docs`` being what its predecessor returned, written and read again. All but the
last return the columns of documents. No stage can be put into SQL whole (learned filters, components, spaced seeds,
queueing, tokens), so ORACLE_SQL is None and the tests hold the stages against plain versions.

Defined cases of every stage: columns beyond those read are carried along, whatever their names; an empty table gives an
empty result; fully repeated rows are told apart by nothing, so they share each decision but the near-copy stage's, which
keeps one of them; null ids come last among ids, and first among those written.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quire import scratch
from quire.llm import decontaminate, jaccard, language, mixing, token_orc

#: The least language score that stays: corrected share of a text's n-grams that the language's sample has. Texts of a
#: few n-grams stay whatever their score.
LANGUAGE_SCORE = 0.3
#: Words of a shingle and hundredths of Jaccard similarity from which documents are near copies.
SHINGLE, SIMILARITY = 5, 80
#: Words of the shortest benchmark item that is evidence against a document; fewer are ordinary phrases.
EVIDENCE = 4
#: Times a document may be taken by the mix.
EPOCHS = 3
VOCABULARY, END_ID = "byte_bpe_50k.json", 2
#: Pre-tokens of a worker's cache: fewer than where encoding is all that an executor does.
CACHED = 60_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that are in no learned language.

    Null, empty and letterless texts are dropped; texts too short for evidence stay; ties between languages do not matter;
    with no labelled row in the table nothing can be learned and all are dropped.
    """
    return language.keep_identified(docs, language.fit(docs), LANGUAGE_SCORE)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component of near copies.

    Null texts and texts without words are no copies and stay; of rows with the same id and the same words one stays; a
    null id stays only where its component has no other.
    """
    return jaccard.one_of_each(docs, SHINGLE, SIMILARITY)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with a benchmark item of at least ``EVIDENCE`` words.

    Null and empty texts and items overlap with nothing; repeated rows and items, null ids and ties change nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), shortest=EVIDENCE)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, up to ``EPOCHS`` times.

    Null texts have size 0 and are taken where the queue is taken as far as their place; a null source is a source of its own; fully repeated rows share one decision;
    rows tie by finish time, then source, epoch and a hash of their content.
    """
    return mixing.mixed(docs, EPOCHS)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in ORC files; doc_id, start, n_tokens and ids_crc32 of each written document.

    A null text is the end id alone; null ids come first; repeated ids keep a row each, ordered by text.
    """
    path = scratch.new_path(spark, "pipeline-tokens")
    token_orc.write_tokens(docs, path, public_tokenizers.path(VOCABULARY), END_ID, cached=CACHED)
    return token_orc.digests(spark, path).drop("part")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language", identify_language),
    ("near_copies", drop_near_copies),
    ("benchmark", drop_benchmark),
    ("mix", mix_sources),
    ("tokens", write_tokens),
]

ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each result is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, scratch.materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.drop(before)  # nothing reads a stage's table once its successor is written
        scratch.release(spark)  # nor what its joins have broadcast
    return STAGES[-1][1](spark, docs, sf_dir)
