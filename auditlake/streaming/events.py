"""The event queries as Structured Streaming: watermarked windows and sessions, deduplicated ingest, folded state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from auditlake.operators.events import ACTIONS, STEPS, micros


def source(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(micros("w.start").alias("start_us"), "event_type", "n")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return rows.select("user_id", micros("w.start").alias("start_us"), "n")


def first_of_each(events: DataFrame, key: str, late: str) -> DataFrame:
    """Idempotent ingest: an event that comes again within the watermark is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def workflow(events: DataFrame) -> DataFrame:
    """State of each user's document after each batch of actions; the state is two values for each key."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now, moves = state.get if state.exists else ("DRAFT", 0)
        for e in pd.concat(list(frames)).sort_values(["ts", "event_id"]).itertuples():
            to = STEPS.get((now, ACTIONS.get(e.event_type)))
            now, moves = (to, moves + 1) if to else (now, moves)
        state.update((now, moves))
        yield pd.DataFrame({"user_id": [key[0]], "state": [now], "moves": [moves]})

    rows = events.filter(F.col("event_type").isin(*ACTIONS)).select("user_id", "ts", "event_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(fold, "user_id long, state string, moves long", "state string, moves long", "update", GroupStateTimeout.NoTimeout)
