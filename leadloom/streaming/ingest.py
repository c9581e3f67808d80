"""Streams of leads and events: the same functions as in batch, with watermarks and bounded state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.urls import normalize_key


def first_seen(leads: DataFrame, time: str, delay: str = "1 day") -> DataFrame:
    """The first lead of each address within the watermark; state of older addresses is dropped."""
    return leads.withColumn("url_key", normalize_key(F.col("url"))).withWatermark(time, delay).dropDuplicatesWithinWatermark(["url_key"])


def windowed_counts(events: DataFrame, time: str, kind: str, size: str = "1 hour", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and kind; late rows within the watermark still count."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.withWatermark(time, delay).groupBy(w, kind).agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), kind, "n", "value")


def sessions(events: DataFrame, time: str, key: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions of each key: start, end and number of events."""
    out = events.withWatermark(time, delay).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def upsert_latest(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every micro-batch to ``merge`` (which must be idempotent) until the available data are used up."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
