"""Event returns in excess of a benchmark, with exactly one reason for every event that has none."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PENNY = 5.0
#: Why an event has no return, in the order in which the reasons are tried.
REASONS = (
    "prediction_is_null", "exit_beyond_calendar", "no_price_coverage_for_ticker", "no_prior_close", "prior_close_below_5_usd", "security_did_not_trade_on_entry", "missing_price_in_window", "missing_benchmark_in_window",
)


def with_factor(bars: DataFrame) -> DataFrame:
    """bars with adj_open; adj_close falls back to close, and the factor is 1 where close is 0."""
    adj = F.coalesce("adj_close", "close")
    factor = F.when(F.col("close") == 0, 1.0).otherwise(adj / F.col("close"))
    return bars.withColumn("adj_close", adj).withColumn("adj_open", F.col("open") * factor)


def on_index(bars: DataFrame, sessions: DataFrame) -> DataFrame:
    return with_factor(bars).join(sessions, "day").select("ticker", "idx", "close", "adj_open", "adj_close")


def window_returns(df: DataFrame, bars_i: DataFrame, ticker: str, start: str, end: str, out: str, at: str = "adj_open") -> DataFrame:
    """df with out: adj_close at index `end` over `at` at index `start`, less 1; null if a bar is missing or the first price is not positive."""
    a = bars_i.select(F.col("ticker").alias("_t"), F.col("idx").alias("_i"), F.col(at).alias("_a"))
    b = bars_i.select(F.col("ticker").alias("_u"), F.col("idx").alias("_j"), F.col("adj_close").alias("_b"))
    df = df.join(a, (F.col(ticker) == F.col("_t")) & (F.col(start) == F.col("_i")), "left").join(b, (F.col(ticker) == F.col("_u")) & (F.col(end) == F.col("_j")), "left")
    return df.withColumn(out, F.when(F.col("_a") > 0, F.col("_b") / F.col("_a") - 1)).drop("_t", "_i", "_a", "_u", "_j", "_b")


def event_returns(events: DataFrame, bars_i: DataFrame, sessions: DataFrame, benchmark: str, horizons: tuple[int, ...]) -> DataFrame:
    """events (accession, ticker, entry_idx, and of predictions direction and probability, and any more) times horizons, with exit_idx, raw, bench, excess and reason.

    Lookups are by session index: the prior close is that of the session before, not of the bar before. The first failing
    test names the reason; reason is null where excess is given."""
    last = sessions.agg(F.max("idx").alias("last_idx"))
    e = events.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("exit_idx", F.col("entry_idx") + F.col("horizon")).withColumn("prior_idx", F.col("entry_idx") - 1)
    e = e.crossJoin(F.broadcast(last))  # one row
    covered = bars_i.select(F.col("ticker").alias("_cov")).distinct()
    prior = bars_i.select(F.col("ticker").alias("_pt"), F.col("idx").alias("_pi"), F.col("close").alias("prior_close"))
    opened = bars_i.select(F.col("ticker").alias("_ot"), F.col("idx").alias("_oi"))
    e = e.join(covered, e.ticker == F.col("_cov"), "left")
    e = e.join(prior, (F.col("ticker") == F.col("_pt")) & (F.col("prior_idx") == F.col("_pi")), "left")
    e = e.join(opened, (F.col("ticker") == F.col("_ot")) & (F.col("entry_idx") == F.col("_oi")), "left")
    e = window_returns(e, bars_i, "ticker", "entry_idx", "exit_idx", "raw")
    e = window_returns(e.withColumn("_bench", F.lit(benchmark)), bars_i, "_bench", "entry_idx", "exit_idx", "bench")
    given = [F.col(c).isNull() for c in ("direction", "probability") if c in events.columns]
    reason = (
        F.when(functools.reduce(Column.__or__, given, F.lit(False)), "prediction_is_null")
        .when(F.col("exit_idx").isNull() | (F.col("exit_idx") > F.col("last_idx")), "exit_beyond_calendar")
        .when(F.col("_cov").isNull(), "no_price_coverage_for_ticker")
        .when(F.col("prior_close").isNull(), "no_prior_close")
        .when(F.col("prior_close") < PENNY, "prior_close_below_5_usd")
        .when(F.col("_oi").isNull(), "security_did_not_trade_on_entry")
        .when(F.col("raw").isNull(), "missing_price_in_window")
        .when(F.col("bench").isNull(), "missing_benchmark_in_window")
    )
    e = e.withColumn("reason", reason).withColumn("excess", F.when(F.col("reason").isNull(), F.col("raw") - F.col("bench")))
    return e.drop("_cov", "_pt", "_pi", "_ot", "_oi", "_bench", "last_idx", "prior_idx", "prior_close")


def ledger(returns: DataFrame, keys: list[str], example: str = "accession", examples: int = 5) -> DataFrame:
    """Count and the first few examples of each reason."""
    r = returns.where("reason is not null")
    counted = r.groupBy(*keys, "reason")
    if examples == 1:
        return counted.agg(F.count(F.lit(1)).alias("n"), F.min(example).alias("first_example"))
    # each task cuts its groups to the first few before anything is gathered
    few = r.select(*keys, "reason", example).distinct().withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "reason").orderBy(example))).where(F.col("_r") <= examples)
    few = few.groupBy(*keys, "reason").agg(F.sort_array(F.collect_list(example)).alias("examples"))
    return counted.agg(F.count(F.lit(1)).alias("n")).join(few, [*keys, "reason"])


def net_return(signed: Column, cost_bps) -> Column:
    return signed - F.lit(cost_bps) / 10_000.0


def signed_excess(direction: Column, excess: Column) -> Column:
    return F.when(direction == "up", excess).when(direction == "down", -excess)
