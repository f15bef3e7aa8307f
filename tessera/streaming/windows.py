"""Windowed channel metrics on streams: an extension beyond the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_metrics(events: DataFrame, *, time: str = "ts", keys: tuple[str, ...] = ("lab",), value: str = "value", size: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Count, mean, deviation and range by tumbling or sliding window; works on static and streaming frames."""
    window = F.window(time, size, slide) if slide else F.window(time, size)
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.min(value).alias("low"), F.max(value).alias("high"))
