"""Streams: windowed request metrics, the state of model pools, and drains of a folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quire.functions import rules


def windowed_metrics(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(window start, event_type, n, failures, total, buckets) of events (ts, event_type, value); batch or stream alike."""
    stamped = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        stamped = stamped.withWatermark("ts", late)
    buckets = F.array(*(F.count_if(F.col("value") <= b) for b in rules.API_BUCKETS))
    out = stamped.groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("failures"), F.round(F.sum("value"), 6).alias("total"), buckets.alias("buckets"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *(c for c in out.columns if c != "window"))


def pool_updates(requests: DataFrame) -> DataFrame:
    """(model, requests, successes, streak, response_time, admitted) whenever a model's requests (model, ts, ok, seconds) come in.

    The stateful form of ``series.pool_state``: one small state per model, whatever the length of the stream.
    """
    schema = "model long, requests long, successes long, streak long, response_time double, admitted boolean"
    state_schema = "requests long, successes long, streak long, response_time double, admitted boolean"

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, good, streak, rt, admitted = state.get if state.exists else (0, 0, 0, None, False)
        rows = pd.concat(list(frames)).sort_values("ts", kind="stable")
        for ok, seconds in zip(rows["ok"], rows["seconds"]):
            n += 1
            good, streak = (good + 1, 0) if ok else (good, streak + 1)
            if ok:
                rt = float(seconds) if rt is None else rt * 0.7 + float(seconds) * 0.3
            if streak >= 3 or (n >= 5 and good / n < 0.5):
                admitted = False
            elif good >= 3 and (good / n >= 0.7 or n < 3) and (rt or 0.0) <= 30:
                admitted = True
        state.update((n, good, streak, rt, admitted))
        yield pd.DataFrame({"model": [key[0]], "requests": [n], "successes": [good], "streak": [streak], "response_time": [rt], "admitted": [admitted]})

    return requests.groupBy("model").applyInPandasWithState(update, schema, state_schema, "update", GroupStateTimeout.NoTimeout)


def drain(spark: SparkSession, folder: str, schema: str, each: Callable[[DataFrame, int], None], checkpoint: str, fmt: str = "json") -> None:
    """Hands all files of ``folder`` that were not handled yet to ``each`` in micro-batches, then stops."""
    stream = spark.readStream.schema(schema).format(fmt).load(folder)
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
