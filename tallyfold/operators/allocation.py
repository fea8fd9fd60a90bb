"""Momentum and trend signals by session ordinal, and books over month ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_ends


def momentum(bars_i: DataFrame, sessions: DataFrame, lookback: int = 252, skip: int = 21, hold: int = 20) -> DataFrame:
    """ticker, idx, day and momentum = adj_close[idx - skip] / adj_close[idx - lookback] - 1 at month ends that have room for both windows."""
    n = sessions.agg(F.count(F.lit(1)).alias("n"))
    at = month_ends(sessions).crossJoin(F.broadcast(n)).where((F.col("idx") >= lookback) & (F.col("idx") + hold + 2 < F.col("n"))).select("day", "idx")  # one row
    p = bars_i.select("ticker", F.col("idx").alias("_i"), "adj_close")
    late = at.join(p, F.col("_i") == F.col("idx") - skip).select("day", "idx", "ticker", F.col("adj_close").alias("_late"))
    early = p.select(F.col("ticker").alias("_t"), F.col("_i").alias("_j"), F.col("adj_close").alias("_early"))
    j = late.join(early, (F.col("ticker") == F.col("_t")) & (F.col("_j") == F.col("idx") - lookback)).where("_early > 0")
    return j.select("ticker", "idx", "day", (F.col("_late") / F.col("_early") - 1).alias("momentum"))


def trend(bars_i: DataFrame, sessions: DataFrame, sleeves: list[str], cash: str, lookback: int = 252, cost_bps: float = 10.0) -> DataFrame:
    """month (day of the following month end) and ret: each sleeve holds its asset if its return over the lookback is above
    0, cash if it is not or is missing; a month with a missing sleeve return is skipped; changed sleeves pay twice the cost."""
    spark = bars_i.sparkSession
    ends = month_ends(sessions)
    ends = ends.withColumn("next_idx", F.lead("idx").over(Window.orderBy("idx"))).withColumn("month", F.lead("day").over(Window.orderBy("idx"))).where("next_idx is not null")
    p = bars_i.select(F.col("ticker").alias("_t"), F.col("idx").alias("_i"), F.col("adj_close").alias("_p"))
    grid = ends.where(F.col("idx") >= lookback).crossJoin(F.broadcast(spark.createDataFrame([(s,) for s in sleeves], "sleeve string")))  # the sleeves of a fixed allocation

    def priced(df, ticker, idx, out):
        q = p.select(F.col("_t").alias(f"t_{out}"), F.col("_i").alias(f"i_{out}"), F.col("_p").alias(out))
        return df.join(q, (ticker == F.col(f"t_{out}")) & (idx == F.col(f"i_{out}")), "left").drop(f"t_{out}", f"i_{out}")

    g = priced(priced(grid, F.col("sleeve"), F.col("idx"), "now"), F.col("sleeve"), F.col("idx") - lookback, "then")
    g = g.withColumn("held", F.when((F.col("then") > 0) & (F.col("now") / F.col("then") - 1 > 0), F.col("sleeve")).otherwise(F.lit(cash)))
    g = priced(priced(g, F.col("held"), F.col("idx"), "h_now"), F.col("held"), F.col("next_idx"), "h_next")
    g = g.withColumn("ret", F.when(F.col("h_now") > 0, F.col("h_next") / F.col("h_now") - 1))
    whole = g.withColumn("_k", F.count("ret").over(Window.partitionBy("month"))).where(F.col("_k") == len(sleeves))
    before = F.lag("held").over(Window.partitionBy("sleeve").orderBy("month"))
    whole = whole.withColumn("_changed", F.when(before.isNull() | (before != F.col("held")), 1).otherwise(0))
    k = float(len(sleeves))
    return whole.groupBy("month").agg(F.sum("_changed").alias("n_changed"), (F.avg("ret") - F.sum("_changed") / k * 2 * cost_bps / 10_000.0).alias("ret"))


def compared(trended: DataFrame, bars_i: DataFrame, sessions: DataFrame, benchmark: str, bond: str, period) -> DataFrame:
    """label (trend, hold, mixed), period and n_months, cagr, volatility, sharpe, max_drawdown of monthly returns: the trend's
    rows (month, ret), the benchmark held, and 0.6 of it with 0.4 of the bond; months that lack a price of these go."""
    ends = month_ends(sessions)
    ends = ends.withColumn("next_idx", F.lead("idx").over(Window.orderBy("idx"))).withColumn("month", F.lead("day").over(Window.orderBy("idx"))).select("idx", "next_idx", "month")

    def held(ticker, out):
        a = bars_i.where((F.col("ticker") == ticker) & (F.col("adj_close") > 0)).select("idx", F.col("adj_close").alias("_a"))
        b = bars_i.where(F.col("ticker") == ticker).select(F.col("idx").alias("next_idx"), F.col("adj_close").alias("_b"))
        return ends.join(a, "idx").join(b, "next_idx").select("month", (F.col("_b") / F.col("_a") - 1).alias(out))

    j = trended.join(held(benchmark, "hold"), "month").join(held(bond, "_bond"), "month").withColumn("mixed", 0.6 * F.col("hold") + 0.4 * F.col("_bond"))
    labelled = F.explode(F.array(*[F.struct(F.lit(n).alias("label"), F.col(c).alias("x")) for n, c in (("trend", "ret"), ("hold", "hold"), ("mixed", "mixed"))]))
    long = j.select("month", period.alias("period"), labelled.alias("_l")).select("month", "period", "_l.*")
    w = Window.partitionBy("label", "period").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    long = long.withColumn("_wealth", F.product(1 + F.col("x")).over(w)).withColumn("_peak", F.greatest(F.lit(1.0), F.max("_wealth").over(w)))
    n, sd = F.count("x"), F.stddev_samp("x")
    two = lambda c: F.when(n > 1, c).otherwise(0.0)
    return long.groupBy("label", "period").agg(
        n.alias("n_months"), two(F.pow(F.product(1 + F.col("x")), 12.0 / n) - 1).alias("cagr"), two(sd * F.sqrt(F.lit(12.0))).alias("volatility"),
        two(F.avg("x") / sd * F.sqrt(F.lit(12.0))).alias("sharpe"), two(F.abs(F.least(F.lit(0.0), F.min(F.col("_wealth") / F.col("_peak") - 1)))).alias("max_drawdown"),
    )
