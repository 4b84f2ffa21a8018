"""Token counts by prefix dynamic programming.

Each distinct pre-token gets a table with the exact token count of every one of its prefixes; a text's counts are sums
of table entries, so truncation and budget questions are answered without encoding anything again.

Defined cases: null text counts as empty (0 bytes, 0 tokens); repeated rows and null ids are rows like any other; an
empty table gives an empty result; other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from quire.llm.arrow import lean
from quire.llm.bpe import encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fits_chars long"


def token_counts(docs: DataFrame, vocabulary: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact counts per document, and the code points of its longest prefix within ``limit`` tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [enc.fitting(t, limit) for t in texts]
            n = [x[0] for x in found]
            yield pa.RecordBatch.from_arrays(
                [b.column(0).cast(pa.int64()), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_()), pa.array([x[1] for x in found], pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit", "fits_chars"],
            )

    return docs.select(docs[id_col], docs[text_col]).mapInArrow(lean(count, caches=True), SCHEMA)
