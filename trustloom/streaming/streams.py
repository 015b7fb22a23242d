"""Live forms of the rating operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bursts(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Events per key in sliding hours; run in update mode. Events over an hour late are dropped."""
    return events.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour", "10 minutes"), key).agg(F.count("*").alias("n"))


def stream_dedupe(events: DataFrame, key: str = "event_id") -> DataFrame:
    return events.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark([key])


def stream_score(events: DataFrame, users: DataFrame, path: str, checkpoint: str, threshold: float = 2.0):
    """Alerts for events far from their user's fitted mean, appended batch by batch."""

    def score(batch: DataFrame, batch_id: int) -> None:
        z = F.abs(F.col("value") - F.col("user_mean")) / (F.col("user_std") + 1e-3)
        batch.join(users, "user_id", "left").withColumn("z", z).filter(F.col("z") >= threshold).write.mode("append").parquet(path)

    return events.writeStream.foreachBatch(score).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
