"""Streaming twins of row diffs, retry states and windowed counts."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Counts and sums by window and type; events.ts may lack a time zone and is read as UTC."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def retry_states(outcomes: DataFrame, max_attempts: int = 3) -> DataFrame:
    """key, status, attempts after each micro-batch of (key, outcome); the state lives in Spark's store."""

    def step(key: tuple, frames: Iterator, state) -> Iterator:
        import pandas as pd

        status, attempts = state.get if state.exists else ("pending", 0)
        for frame in frames:
            for outcome in frame["outcome"]:
                if outcome == "terminal":
                    status = "failed"
                    continue
                attempts += 1
                status = "success" if outcome == "success" else "failed" if attempts >= max_attempts else "pending"
        state.update((status, attempts))
        yield pd.DataFrame([(key[0], status, attempts)], columns=["key", "status", "attempts"])

    return outcomes.groupBy("key").applyInPandasWithState(step, "key string, status string, attempts long", "status string, attempts long", "update", "NoTimeout")


def changed_rows(batch: DataFrame, stored: DataFrame, key: str, digest: str) -> DataFrame:
    """For foreachBatch: rows of a micro-batch that are new or whose digest changed; repeated keys count once."""
    old = stored.select(key, F.col(digest).alias("_old"))
    return batch.dropDuplicates([key, digest]).join(old, key, "left").where(~F.col("_old").eqNullSafe(F.col(digest))).drop("_old")
