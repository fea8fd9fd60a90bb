"""Calibration of probabilities against outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reliability(rows: DataFrame, keys: list[str], probability: str, correct: str, n_bins: int = 10) -> DataFrame:
    """One row for each bin [i/n, (i+1)/n), the last closed, empty bins included with zeros: a join from bins, which are few."""
    spark = rows.sparkSession
    bins = spark.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    at = F.least(F.floor(F.col(probability) * n_bins + 1e-9), F.lit(n_bins - 1)).cast("int")
    got = rows.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(probability).alias("mean_probability"), F.avg(F.col(correct).cast("double")).alias("observed"))
    grid = rows.select(*keys).distinct().crossJoin(F.broadcast(bins))  # n_bins rows
    zero = F.lit(0.0)
    return grid.join(got, [*keys, "bin"], "left").select(
        *keys, "bin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("mean_probability", zero).alias("mean_probability"), F.coalesce("observed", zero).alias("observed"),
        F.coalesce(F.col("observed") - F.col("mean_probability"), zero).alias("gap"),
    )


def scores(rows: DataFrame, keys: list[str], probability: str, correct: str) -> DataFrame:
    y = F.col(correct).cast("double")
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("hit_rate"), F.avg(F.pow(F.col(probability) - y, 2)).alias("brier"), (F.avg(probability) - F.avg(y)).alias("overconfidence"))


def diagram(bins: DataFrame, width: int = 40) -> DataFrame:
    """A text bar for each bin."""
    return bins.withColumn("bar", F.format_string("%4.2f |%s", F.col("mean_probability"), F.expr(f"repeat('#', cast(round(observed * {width}) as int))")))
