"""Folds and bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Documents a fitted model learns from, at most about this many for each label value.
SAMPLE_EACH = 1500


def held_out(id_col: Column) -> Column:
    """Whether a row is in the held-out fold: crc32 of its id as text, modulo 5, is 0 (a null id is held out)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def sample(rows: DataFrame, id_col: str, label_col: str, each: int = SAMPLE_EACH, seed: int = 3) -> DataFrame:
    """Rows outside the held-out fold with a label: about ``each`` for every label value, chosen by a hash of the id.

    Counts per label come first (one narrow pass), so the size of the sample does not grow with the table.
    """
    learn = rows.where(~held_out(F.col(id_col)) & F.col(label_col).isNotNull())
    counts = learn.groupBy(label_col).count().collect()  # one row for each label value
    share = F.lit(0.0)
    for r in counts:
        share = F.when(F.col(label_col) == F.lit(r[0]), F.lit(min(1.0, each / r[1]))).otherwise(share)
    return learn.where((F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(1_000_000)) / 1e6) < share)
