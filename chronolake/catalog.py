"""All queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import acoustics, jobs, records, reports, review, streams, timeline  # noqa: F401  (the others add to the same registry)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(timeline.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(timeline.SQL)
