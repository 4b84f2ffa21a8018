"""Written intermediate tables in the folder that driver and executors share.

Lineage is cut by writing a table and reading it back, so a lost executor costs a re-read, not a recomputation.
The folder comes from ``spark.checkpoint.dir``; one of our own is used only in local sessions without the setting.
"""

from __future__ import annotations

import atexit
import gc
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task where partitions are counted by rows; few rows still make tasks of FEW_ROWS.
TASK_ROWS, FEW_ROWS = 1_000_000, 50_000

_OWN: dict[str, str] = {}
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by the session; in a local session without one, a folder of this process."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return _OWN.setdefault("dir", tempfile.mkdtemp(prefix="quire-"))


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a scratch table; removed when the process ends."""
    path = f"{shared_dir(spark)}/quire/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


def materialize(df: DataFrame, name: str, fmt: str = "parquet") -> DataFrame:
    """Write ``df`` to the shared folder and return a plan that scans it."""
    path = new_path(df.sparkSession, name)
    df.write.format(fmt).save(path)
    out = df.sparkSession.read.format(fmt).schema(df.schema).load(path)
    out._quire_path = path
    return out


def partitions(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: one for each TASK_ROWS, more up to the session's own number where these are large for few rows."""
    own = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(1, math.ceil(rows / TASK_ROWS), min(own, math.ceil(rows / FEW_ROWS)))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` of about so many rows by its keys, TASK_ROWS to a task, so that the memory of a task does not grow with the table.

    Left as it is where the session's own number of partitions is enough for that.
    """
    if rows <= TASK_ROWS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df
    return df.repartition(partitions(df.sparkSession, rows), *keys)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a scratch table through Hadoop's file system, wherever it lives."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame made by :func:`materialize` once nothing reads it any more."""
    if path := getattr(df, "_quire_path", None):
        delete(df.sparkSession, path)
        _MADE[:] = [x for x in _MADE if x[1] != path]


def release(spark: SparkSession) -> None:
    """Let the driver collect now, so that shuffle files of finished jobs go before the next large step, not some time.

    The last query's plan is held until another one ends, so a trivial one is run first.
    """
    spark.range(1).collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@atexit.register
def _clean() -> None:
    for spark, path in _MADE:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the JVM may already be gone at exit
            return
