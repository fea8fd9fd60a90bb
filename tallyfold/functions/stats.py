"""Aggregates of the studies. All numbers that leave a query are rounded, since engines add in different orders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranks import middle, with_middle


def summary(x: str, prefix: str = "") -> list[Column]:
    """n, mean, sample deviation (0 below two rows) and median; zeros for no rows. For rows with their middle marked: summarised()."""
    zero = F.lit(0.0)
    return [
        F.count(x).alias(f"{prefix}n"),
        F.coalesce(F.avg(x), zero).alias(f"{prefix}mean"),
        F.coalesce(F.when(F.count(x) > 1, F.stddev_samp(x)), zero).alias(f"{prefix}stdev"),
        F.coalesce(middle(x), zero).alias(f"{prefix}median"),
    ]


def summarised(rows: DataFrame, keys: list[str], x: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates by keys, with exact medians of x that no task gathers."""
    return with_middle(rows.select(*dict.fromkeys([*keys, x])), keys, x).groupBy(*keys).agg(*aggregates)


def one_sample_t(x: str) -> Column:
    n, sd = F.count(x), F.stddev_samp(x)
    return F.when((n > 1) & (sd > 0), F.avg(x) / (sd / F.sqrt(n))).otherwise(0.0)


def normal_cdf(x: Column) -> Column:
    """Abramowitz and Stegun 26.2.17, error below 7.5e-8: neither Spark nor the oracle has an error function."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    upper = F.exp(-x * x / 2) / 2.5066282746310002 * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def welch(xa: Column, xb: Column) -> Column:
    """t of the difference of two groups given as columns that are null outside their group; 0 below two rows or without spread."""
    na, nb = F.count(xa), F.count(xb)
    se = F.sqrt(F.var_samp(xa) / na + F.var_samp(xb) / nb)
    return F.when((na > 1) & (nb > 1) & (se > 0), (F.avg(xa) - F.avg(xb)) / se).otherwise(0.0)


def two_sided(t: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(t)))


def series_stats(series: DataFrame, keys: list[str], order: str, value: str, periods: int = 12) -> DataFrame:
    """Of each key's series in order: n, mean, t, Sharpe ratio over a year, maximal drawdown from 1, share above 0."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    s = series.withColumn("_wealth", F.product(1 + F.col(value)).over(w))
    s = s.withColumn("_peak", F.greatest(F.lit(1.0), F.max("_wealth").over(w)))
    sd = F.stddev_samp(value)
    return s.groupBy(*keys).agg(
        F.count(value).alias("n_periods"),
        F.avg(value).alias("mean"),
        one_sample_t(value).alias("t"),
        F.when((F.count(value) > 1) & (sd > 0), F.avg(value) / sd * F.sqrt(F.lit(float(periods)))).otherwise(0.0).alias("sharpe"),
        F.abs(F.least(F.lit(0.0), F.min(F.col("_wealth") / F.col("_peak") - 1))).alias("max_drawdown"),
        F.avg((F.col(value) > 0).cast("double")).alias("hit_rate"),
    )


def book_stats(series: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """n_months, mean_monthly, sharpe and max_drawdown of each key's monthly series; zeros below two months."""
    s = series_stats(series, keys, order, value)
    two = lambda c: F.when(F.col("n_periods") > 1, F.col(c)).otherwise(0.0)
    return s.select(*keys, F.col("n_periods").alias("n_months"), two("mean").alias("mean_monthly"), two("sharpe").alias("sharpe"), two("max_drawdown").alias("max_drawdown"))


def bps_summary(x: str) -> list[Column]:
    """n, mean and median in basis points, t and the share above 0; zeros for no rows."""
    zero = F.lit(0.0)
    return [
        F.count(x).alias("n"), F.coalesce(F.avg(x) * 1e4, zero).alias("mean_bps"), F.coalesce(middle(x) * 1e4, zero).alias("median_bps"), one_sample_t(x).alias("t"),
        F.coalesce(F.avg((F.col(x) > 0).cast("double")), zero).alias("hit_rate"),
    ]


def every_cell(rows: DataFrame, dims: dict[str, list], x: str, aggregates: list[Column]) -> DataFrame:
    """Aggregates of x for every combination of the dimensions' values; zeros where there are no rows."""
    spark = rows.sparkSession
    grid = None
    for name, values in dims.items():
        d = spark.createDataFrame([(v,) for v in values], f"{name} {'int' if isinstance(values[0], int) else 'string'}")
        grid = d if grid is None else grid.crossJoin(d)  # a few values each
    return grid.join(summarised(rows, list(dims), x, aggregates), list(dims), "left").na.fill(0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])
