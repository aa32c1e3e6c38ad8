"""Streams: idempotent feedback folds and event-time windows (extensions; the same functions run on batches)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark, path: str, **options) -> DataFrame:
    """A stream of Parquet event files."""
    return spark.readStream.schema(EVENTS).options(**options).parquet(path)


def windowed(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """start, event_type, n, total of tumbling windows; late events are taken for that long in a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def once(feedback: DataFrame, late: str = "1 hour") -> DataFrame:
    """feedback (feedback_id, ts, ...) without repeated ids."""
    return feedback.withWatermark("ts", late).dropDuplicatesWithinWatermark(["feedback_id"])


def fold_weights(feedback: DataFrame, rate: float = 0.2) -> DataFrame:
    """feedback: id, ts, positive -> id, weight after each micro-batch: the feedback fold with its state kept by edge. Events of a batch are
    taken in time order; a new edge starts at rate."""

    def step(key, batches, state):
        weight, n = state.get if state.exists else (rate, 0)
        rows = pd.concat(list(batches)).sort_values("ts")
        for positive in rows["positive"]:
            weight = weight * (1 - rate) + (rate if positive else 0.0)
            n += 1
        state.update((weight, n))
        yield pd.DataFrame({"id": [key[0]], "weight": [weight], "events": [n]})

    return feedback.groupBy("id").applyInPandasWithState(step, "id long, weight double, events long", "weight double, events long", "update", "NoTimeout")


def publish(stream: DataFrame, path: str, checkpoint: str):
    """Epochs of a stream written as directories epoch=n: a batch that is run again overwrites its own directory."""

    def write(df: DataFrame, epoch: int) -> None:
        df.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
