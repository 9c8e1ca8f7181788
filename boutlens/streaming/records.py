"""Streams of events and bouts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_files(spark: SparkSession, path: str, schema, files_a_trigger: int = 100) -> DataFrame:
    """New Parquet files of a folder, a bounded number at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(path)


def counts_by_window(events: DataFrame, ts: str = "ts", by: str = "event_type", window: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums in tumbling windows; rows later than ``late`` behind the newest are left out, and state with them."""
    timed = events.withColumn(ts, F.col(ts).cast("timestamp"))
    grouped = timed.withWatermark(ts, late).groupBy(F.window(ts, window), by)
    return grouped.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


_STATE = "bouts long, wins long, streak long, ewma double"


def _record(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    bouts, wins, streak, ewma = state.get if state.exists else (0, 0, 0, None)
    rows = pd.concat(list(frames)).sort_values(["event_date", "fight_id"])
    for won in rows["won"]:
        bouts += 1
        if pd.isna(won):
            streak = 0
            continue
        wins, streak = wins + int(won), streak + 1 if won else 0
        ewma = float(won) if ewma is None else ewma * (1 - 0.206) + float(won) * 0.206
    state.update((bouts, wins, streak, ewma))
    yield pd.DataFrame([(key[0], bouts, wins, streak, 0.0 if ewma is None else ewma)], columns=["fighter", "bouts", "wins", "streak", "ewma"])


def running_record(sides: DataFrame) -> DataFrame:
    """A fighter's record after each micro-batch that has bouts of theirs; bouts come in the order of time."""
    return sides.groupBy("fighter").applyInPandasWithState(_record, f"fighter long, {_STATE}", _STATE, "update", GroupStateTimeout.NoTimeout)
