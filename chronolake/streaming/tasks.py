"""Streams of task events: the state of each key, and counts by event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolake.operators.results import TERMINAL


def sticky_status(events: DataFrame) -> DataFrame:
    """events: file_hash, created_at, task_id, status. Emits the status of a key whenever it has new events; the first
    terminal one seen stays, as later transitions are ignored. One row of state for each key."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status = state.get[0] if state.exists else None
        rows = pd.concat(list(parts)).sort_values(["created_at", "task_id"])
        for new in rows.status:
            if status in TERMINAL:
                break
            status = new
        state.update((status,))
        yield pd.DataFrame({"file_hash": [key[0]], "status": [status], "terminal": [status in TERMINAL]})

    return events.groupBy("file_hash").applyInPandasWithState(step, "file_hash long, status string, terminal boolean", "status string", "update", "NoTimeout")


def counts_by_hour(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of each status and hour; hours close once the watermark has passed them."""
    return events.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour"), "status").agg(F.count(F.lit(1)).alias("n"))


def upload_sessions(events: DataFrame, idle: str = "30 minutes") -> DataFrame:
    """Sessions of each key that end after ``idle`` without an event."""
    return events.withWatermark("created_at", idle).groupBy(F.session_window("created_at", idle), "file_hash").agg(F.count(F.lit(1)).alias("n"))
