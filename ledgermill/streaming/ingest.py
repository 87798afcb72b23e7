"""Incremental import as a stream: transactions are taken once by fingerprint within a watermark and rolled up as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def period_stream(events: DataFrame, delay: str = "10 days", period: str = "30 days") -> DataFrame:
    """Sums by period and class of a stream of (event_time, fingerprint, economic_class, amount).

    The aggregate is keyed by a window of the event time, so the watermark closes each period: append mode gives it once, and its state
    leaves. A stream's windows have a fixed length; months of the calendar are the sums of `monthly_batch`.
    """
    once = events.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["fingerprint"])
    sums = once.groupBy(F.window("event_time", period), "economic_class").agg(F.count("*").alias("n"), F.sum("amount").alias("total"))
    return sums.select(F.col("window.start").alias("period_start"), F.col("window.end").alias("period_end"), "economic_class", "n", "total")


def day_stream(events: DataFrame, delay: str = "10 days") -> DataFrame:
    """Sums by day, from which `monthly_batch` makes the months of the calendar."""
    return period_stream(events, delay, "1 day")


def monthly_batch(days: DataFrame) -> DataFrame:
    """Months of the calendar from the closed days that `day_stream` gave."""
    month = F.date_format("period_start", "yyyy-MM").alias("month")
    return days.groupBy(month, "economic_class").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
