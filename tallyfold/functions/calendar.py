"""Sessions as an ordinal domain: every date rule is an equi-join on a session's index, never a walk."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NEW_YORK, CUTOFF_SECONDS = "America/New_York", 16 * 3600
#: Sessions the exchange lost to unscheduled closures.
CLOSED = (date(2012, 10, 29), date(2012, 10, 30), date(2018, 12, 5), date(2025, 1, 9))


def easter(year: int) -> date:
    a, b, c = year % 19, year // 100, year % 100
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (32 + 2 * e + 2 * i - h - k) % 7
    n = (a + 11 * h + 22 * m) // 451
    month, day = divmod(h + m - 7 * n + 114, 31)
    return date(year, month, day + 1)


def holidays(year: int) -> set[date]:
    """Full-day holidays of the exchange, on the day they are observed."""

    def nth(month: int, weekday: int, n: int) -> date:
        first = date(year, month, 1)
        return first + timedelta(days=(weekday - first.weekday()) % 7 + 7 * (n - 1))

    def observed(day: date) -> date | None:
        if day.weekday() == 5:
            return None if (day.month, day.day) == (1, 1) else day - timedelta(days=1)
        return day + timedelta(days=1) if day.weekday() == 6 else day

    last_may = date(year, 5, 31)
    out = {nth(1, 0, 3), nth(2, 0, 3), easter(year) - timedelta(days=2), last_may - timedelta(days=last_may.weekday()), nth(9, 0, 1), nth(11, 3, 4)}
    out |= {observed(date(year, 1, 1)), observed(date(year, 7, 4)), observed(date(year, 12, 25))}
    if year >= 2022:
        out.add(observed(date(year, 6, 19)))
    return {d for d in out if d}


def exchange_sessions(spark: SparkSession, first: int = 2009, last: int = 2027) -> DataFrame:
    """day and idx of every session of the years; a few thousand rows, whatever the data."""
    off = set(CLOSED).union(*(holidays(y) for y in range(first, last + 1)))
    day, days = date(first, 1, 1), []
    while day.year <= last:
        if day.weekday() < 5 and day not in off:
            days.append(day)
        day += timedelta(days=1)
    return spark.createDataFrame(list(zip(days, range(len(days)))), "day date, idx int")


def indexed(days: DataFrame, column: str = "day") -> DataFrame:
    """day and idx for the distinct days of a table. One ordered pass over days, of which a century has 36,525."""
    return days.select(F.col(column).cast("date").alias("day")).where("day is not null").distinct().withColumn("idx", F.row_number().over(Window.orderBy("day")) - 1)


def day_table(sessions: DataFrame) -> DataFrame:
    """For each calendar day of the span: is_session, prev_idx (strictly before), on_idx (on or after) and next_idx (strictly after)."""
    span = sessions.agg(F.min("day").alias("a"), F.max("day").alias("b"))
    days = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    j = days.join(sessions, "day", "left")
    w = Window.orderBy("day")
    before = F.last("idx", True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    after = F.first("idx", True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return j.select("day", F.col("idx").isNotNull().alias("is_session"), before.alias("prev_idx"), F.coalesce("idx", after).alias("on_idx"), after.alias("next_idx"))


def shifted(df: DataFrame, sessions: DataFrame, idx: Column, out: str) -> DataFrame:
    """df with the day of the session at idx, null beyond the calendar."""
    s = sessions.select(F.col("idx").alias("_idx"), F.col("day").alias(out))
    return df.join(s, idx == F.col("_idx"), "left").drop("_idx")


def entry_index(df: DataFrame, sessions: DataFrame, accepted_at: str, zone: str = NEW_YORK) -> DataFrame:
    """df with entry_idx: accepted before the cutoff of a session -> the next session, otherwise the one after it."""
    local = F.from_utc_timestamp(accepted_at, zone)
    seconds = F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)
    d = day_table(sessions).withColumnRenamed("day", "_day")
    out = df.withColumn("_at", F.to_date(local)).withColumn("_s", seconds).join(d, F.col("_at") == F.col("_day"), "left")
    early = F.col("is_session") & (F.col("_s") < CUTOFF_SECONDS)
    return out.withColumn("entry_idx", F.when(early, F.col("next_idx")).otherwise(F.col("next_idx") + 1)).drop("_at", "_s", "_day", "is_session", "prev_idx", "on_idx", "next_idx")


def acceptance_bucket(df: DataFrame, sessions: DataFrame, accepted_at: str, zone: str = NEW_YORK) -> DataFrame:
    """df with bucket: 'weekend' (Friday after the cutoff, Saturday, Sunday), 'preholiday' (after the cutoff of a session
    that a weekday without session follows, or on such a weekday), else 'control'; and after_hours."""
    local = F.from_utc_timestamp(accepted_at, zone)
    late = F.hour(local) >= CUTOFF_SECONDS // 3600
    gap = F.col("next_day") > F.date_add(F.col("_at"), 1)
    s = sessions.select(F.col("idx").alias("_idx"), F.col("day").alias("next_day"))
    d = day_table(sessions).join(s, F.col("next_idx") == F.col("_idx"), "left").select(F.col("day").alias("_day"), "is_session", "next_day")
    out = df.withColumn("_at", F.to_date(local)).withColumn("_late", late).join(d, F.col("_at") == F.col("_day"), "left")
    weekday = F.weekday("_at")
    off = F.exists(F.when(gap, F.sequence(F.date_add("_at", 1), F.date_sub("next_day", 1))), lambda x: F.weekday(x) < 5)
    bucket = (
        F.when((weekday >= 5) | ((weekday == 4) & F.col("_late")), "weekend")
        .when((F.col("_late") | ~F.coalesce("is_session", F.lit(False))) & F.coalesce(off, F.lit(False)), "preholiday")
        .otherwise("control")
    )
    return out.withColumn("bucket", bucket).withColumn("after_hours", F.col("_late")).drop("_at", "_late", "_day", "is_session", "next_day")


def month_ends(sessions: DataFrame) -> DataFrame:
    """Sessions whose next session lies in another month; the last session never qualifies."""
    following = F.lead("day").over(Window.orderBy("idx"))
    return sessions.withColumn("_n", following).where(F.date_trunc("month", "_n") > F.date_trunc("month", "day")).drop("_n")


def partition_of(ts: Column, explore_to: int = 2019, holdout_to: int = 2024) -> Column:
    """By the year of the UTC instant."""
    year = F.year(ts)
    return F.when(year <= explore_to, "explore").when(year <= holdout_to, "holdout").otherwise("forward")


def in_acceptance_window(ts: Column, zone: str = NEW_YORK) -> Column:
    local = F.from_utc_timestamp(ts, zone)
    return (F.hour(local) * 3600 + F.minute(local) * 60 + F.second(local)).between(4 * 3600, 20 * 3600)


def long_date(text: Column) -> Column:
    """'March 5, 2018' or 'Mar 5, 2018' anywhere in a text."""
    found = F.regexp_extract(text, r"([A-Z][a-z]{2,8}\.? \d{1,2}, \d{4})", 1)
    found = F.regexp_replace(found, r"\.", "")
    return F.to_date(F.coalesce(F.try_to_timestamp(found, F.lit("MMMM d, yyyy")), F.try_to_timestamp(found, F.lit("MMM d, yyyy"))))


def insider_date(text: Column) -> Column:
    return F.to_date(F.try_to_timestamp(F.initcap(F.lower(text)), F.lit("dd-MMM-yyyy")))


#: How pages write a day, tried in this order.
PAGE_DATES = ("MMMM d, yyyy", "MMM d, yyyy", "yyyy-MM-dd", "d MMMM yyyy", "d MMM yyyy", "M/d/yyyy", "MMMM d yyyy", "MMM d yyyy", "yyyy/M/d", "yyyyMMdd")


def universe_date(raw: Column) -> Column:
    """The day that a page's cell names, null where it names none; notes in brackets behind it do not count."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(raw, r"\[[^\]]*\]", ""), r"\s+", " "))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(bare, F.lit(f))) for f in PAGE_DATES])
