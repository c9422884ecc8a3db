"""Event-time aggregates for streams and tables alike. An extension: nothing of the kind is needed by retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _timed(events: DataFrame, time: str, late: str | None) -> DataFrame:
    return events.withWatermark(time, late) if late and events.isStreaming else events


def tumbling(events: DataFrame, size: str, by: str, time: str = "ts", value: str = "value", late: str | None = "1 hour") -> DataFrame:
    """(start, by, n, total) per window and key."""
    grouped = _timed(events, time, late).groupBy(F.window(time, size).alias("w"), by)
    return grouped.agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def sliding(events: DataFrame, size: str, slide: str, by: str, time: str = "ts", late: str | None = "1 hour") -> DataFrame:
    grouped = _timed(events, time, late).groupBy(F.window(time, size, slide).alias("w"), by)
    return grouped.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(events: DataFrame, gap: str, by: str, time: str = "ts", late: str | None = "1 hour") -> DataFrame:
    """(by, start, n): runs of events without a pause of ``gap``."""
    grouped = _timed(events, time, late).groupBy(F.session_window(time, gap).alias("w"), by)
    return grouped.agg(F.count("*").alias("n")).select(by, F.col("w.start").alias("start"), "n")
