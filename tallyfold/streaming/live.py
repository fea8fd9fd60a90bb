"""Live filings: duplicates dropped within the watermark, entry sessions by a stream-static join, monthly counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import entry_index


def live_entries(stream: DataFrame, sessions: DataFrame, key: str = "accession_no", at: str = "accepted_at", late: str = "1 day") -> DataFrame:
    """Each filing once, with the index of the session it is entered on."""
    once = stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
    return entry_index(once, sessions, at)


def windowed_counts(stream: DataFrame, at: str, kind: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    w = stream.withWatermark(at, late).groupBy(F.window(at, width), kind)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")


def monthly_counts(stream: DataFrame, at: str) -> DataFrame:
    """Months are no fixed duration, so the key is the truncated instant."""
    return stream.groupBy(F.date_trunc("month", at).alias("month")).agg(F.count(F.lit(1)).alias("n"))
