"""Streaming forms of window operators (beyond the batch engine): sessions, newest per key, host breaker."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Parquet files arriving in a folder, with ts as a timestamp."""
    return spark.readStream.schema(schema).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def tumbling(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.max_by("event_id", "ts").alias("newest"))


def first_of_each(events: DataFrame, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def breaker(outcomes: DataFrame, key: str, failed: str, limit: int = 2) -> DataFrame:
    """State of a circuit breaker per key after each batch: `limit` failures in a row open it, a success closes it."""

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        for part in parts:
            for bad in part.sort_values(["ts", "event_id"])[failed]:
                n = n + 1 if bad else 0
        state.update((n,))
        yield pd.DataFrame({key: [k[0]], "failures": [n], "is_open": [n >= limit]})

    kind = outcomes.schema[key].dataType.simpleString()
    return outcomes.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, failures int, is_open boolean", "failures int", "update", GroupStateTimeout.NoTimeout)
