"""Token ids as ORC: integer run-length encoded stripes, row indexes, and Bloom filters on document ids.

Documents are range-partitioned by id, encoded where they land and written in ascending order, one or more stripes a
file. ``part`` numbers the range partitions in id order and ``local_start`` counts the ids before a document within its
own, so a reader of any subset of stripes knows each document's position from one small table of partition sums.

Defined cases: null text is encoded as empty (the end id alone); null ids come first; repeated ids keep one row each,
ordered by text; an empty table gives an empty but readable folder; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.arrow import lean, partition_id, small
from quire.llm.bpe import CACHE_ENTRIES, encoder

SCHEMA = "part int, doc_id long, local_start long, n_tokens long, ids array<int>"
DIGEST = "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long"

#: Bytes of a stripe, rows of a row-index group, false positives of the Bloom filter on doc_id.
STRIPE_BYTES, INDEX_ROWS, BLOOM_FPP = 16 << 20, 1000, 0.01


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", cached: int = CACHE_ENTRIES) -> None:
    """Encode every whole text, append ``end_id`` and write the ORC folder ``path``; ``cached`` trades memory of a worker for time."""
    ranged = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, at = encoder(vocabulary, cached), partition_id(), 0
        end = np.array([end_id], "<u4").tobytes()
        for b in batches:
            lo = 0
            texts = b.column(1)
            while lo < b.num_rows:  # a batch of few, or of one long text
                hi, size, got = lo, 0, []
                while hi < b.num_rows and size < 8 << 20:
                    got.append(enc.encode(texts[hi].as_py() or "") + end)
                    size += len(got[-1])
                    hi += 1
                n = np.array([len(x) // 4 for x in got], np.int64)
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.frombuffer(b"".join(got), "<i4")))
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hi - lo, part, np.int32)), b.column(0).slice(lo, hi - lo), pa.array(starts), pa.array(n), ids], names=["part", "doc_id", "local_start", "n_tokens", "ids"])
                lo = hi

    options = {"orc.stripe.size": STRIPE_BYTES, "orc.row.index.stride": INDEX_ROWS, "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": BLOOM_FPP, "orc.create.index": "true", "compression": "zstd"}
    ranged.mapInArrow(lean(encode, caches=True), SCHEMA).write.options(**options).orc(path)


def read_tokens(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The written rows; with ``ids`` only those documents, pruned by stripe statistics and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if ids is None else rows.where(F.col("doc_id").isin(ids))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(4)
            off = np.asarray(ids.offsets)
            raw = memoryview(np.ascontiguousarray(np.asarray(ids.values), "<i4")).cast("B")
            sums = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sums, pa.int64())], names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path)
    # one row for each range partition
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    before = F.sum("_sum").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = small(parts.select("part", F.coalesce(before, F.lit(0)).alias("_before")))
    return rows.mapInArrow(lean(crc), DIGEST).join(parts, "part").select("doc_id", (F.col("local_start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32", "part")
