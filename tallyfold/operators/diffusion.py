"""Lead and lag between the members of an industry group, with membership on the day.

An event never meets its peers. Membership is a sweep over each ticker's sessions: joining adds one, leaving takes one off,
and a running sum tells whether the ticker is a member on a session, however many intervals it has. Members' returns are
then summed over their group for each session, and an event takes its group's sums less its own filer's share. Work follows
tickers times sessions plus events, and no group of events or of peers is in one task.

Intervals include their last day; no last day means still a member. A ticker in no group, or a group without another member
with a return, gives the event no pair. Repeated or overlapping intervals count once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def member_sessions(members: DataFrame, sessions: DataFrame) -> DataFrame:
    """ticker and idx of every session on which the ticker is a member. members: ticker, start_date, end_date (included)."""
    m = members.where("end_date is null or end_date >= start_date")
    moves = F.array(F.struct(F.col("start_date").alias("day"), F.lit(1).alias("delta")), F.struct(F.date_add("end_date", 1).alias("day"), F.lit(-1).alias("delta")))
    deltas = m.select("ticker", F.inline(moves)).where("day is not null")
    ticks = m.select("ticker").distinct().crossJoin(F.broadcast(sessions.select("day", "idx")))  # the calendar: some thousand sessions
    every = deltas.select("ticker", "day", F.lit(None).cast("int").alias("idx"), "delta").unionByName(ticks.select("ticker", "day", F.col("idx").cast("int"), F.lit(0).alias("delta")))
    open_ = F.sum("delta").over(Window.partitionBy("ticker").orderBy("day", F.col("idx").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    return every.withColumn("_open", open_).where("idx is not null and _open > 0").select("ticker", "idx")


def group_sums(returns: DataFrame, groups: DataFrame, present: DataFrame) -> DataFrame:
    """Of each group, session and horizon: n, sum, sum of squares and numbers above and below 0 of the returns of those present.
    returns: ticker, idx, horizon, x; groups: ticker, grp; present: ticker, idx."""
    x = F.col("x")
    day = returns.where("x is not null").join(present, ["ticker", "idx"]).join(groups, "ticker")
    return day.groupBy("grp", "idx", "horizon").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(x * x).alias("q"), F.sum((x > 0).cast("int")).alias("above"), F.sum((x < 0).cast("int")).alias("below"))


def peer_sums(events: DataFrame, returns: DataFrame, groups: DataFrame, present: DataFrame) -> DataFrame:
    """events (with ticker, idx and sign) times horizons with n, s, q and hits of the signed returns of the filer's peers on the
    event's session; events without a peer's return go."""
    own = returns.where("x is not null").join(present, ["ticker", "idx"]).select(F.col("ticker").alias("_t"), F.col("idx").alias("_i"), F.col("horizon").alias("_h"), F.col("x").alias("_x"))
    j = events.join(groups, "ticker").join(group_sums(returns, groups, present), ["grp", "idx"])
    j = j.join(own, (F.col("ticker") == F.col("_t")) & (F.col("idx") == F.col("_i")) & (F.col("horizon") == F.col("_h")), "left")
    x = F.coalesce("_x", F.lit(0.0))
    less = {"n": F.col("_x").isNotNull().cast("int"), "s": x, "q": x * x, "above": (x > 0).cast("int"), "below": (x < 0).cast("int")}
    out = j.select(*events.columns, "horizon", *[(F.col(c) - v).alias(c) for c, v in less.items()]).where("n > 0")
    return out.select(*events.columns, "horizon", "n", (F.col("sign") * F.col("s")).alias("s"), "q", F.when(F.col("sign") > 0, F.col("above")).otherwise(F.col("below")).alias("hits"))


def pooled(sums: DataFrame, keys: list[str], event: str) -> DataFrame:
    """Over all pairs of a key: n_pairs, n_events, mean_bps, t of one sample, hit_rate."""
    n, s, q = F.sum("n"), F.sum("s"), F.sum("q")
    sd = F.sqrt(F.greatest((q - s * s / n) / (n - 1), F.lit(0.0)))
    return sums.groupBy(*keys).agg(n.alias("n_pairs"), F.count_distinct(event).alias("n_events"), (s / n * 1e4).alias("mean_bps"), F.when((n > 1) & (sd > 0), s / n / (sd / F.sqrt(n))).otherwise(0.0).alias("t"), (F.sum("hits") / n).alias("hit_rate"))
