"""Streaming weekly news features and event deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weekpanel.operators.news import enrich, weekly_aggregates


def deduplicated(events: DataFrame, keys: tuple[str, ...] = ("requested_symbol", "news_id"), delay: str = "7 days") -> DataFrame:
    """First event per key inside the watermark; state is dropped behind it."""
    return events.withWatermark("published_at", delay).dropDuplicatesWithinWatermark(list(keys))


def weekly_features_stream(events: DataFrame, delay: str = "7 days") -> DataFrame:
    """Weekly news features per event-time week (Saturday to Friday).

    The windows start two days after the epoch's Thursday, i.e. on Saturdays,
    so a window's last day is the week-ending Friday of the batch operator.
    The state holds one aggregate row per open week.
    """
    marked = events if events.isStreaming is False else events.withWatermark("published_at", delay)
    enriched = enrich(marked).drop("week_end")
    window = F.window("published_at", "7 days", "7 days", "2 days")
    return (
        enriched.groupBy(window.alias("w"))
        .agg(*weekly_aggregates())
        .select(
            F.date_sub(F.col("w.end").cast("date"), 1).alias("week_end"), "*",
            F.lit("aggregated_from_news_events_enriched").alias("source"),
        )
        .drop("w")
    )
