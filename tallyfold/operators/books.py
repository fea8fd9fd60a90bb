"""Quantile books: legs of floor(n / 5) names, not ntile, with every tie broken by the accession."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import ranked


def legs(rows: DataFrame, keys: list[str], score: str, tie: str, least: int = 5) -> DataFrame:
    """Rows of the top and bottom fifth by score in each group, with leg 'long' or 'short'; groups under `least` rows have none."""
    r = ranked(rows, keys, score, tie)
    size = F.floor(F.col("_n") / 5)
    leg = F.when(F.col("_pos") >= F.col("_n") - size, "long").when(F.col("_pos") < size, "short")
    return r.withColumn("leg", leg).where((F.col("_n") >= least) & F.col("leg").isNotNull()).drop("_n", "_pos")


def monthly_book(rows: DataFrame, keys: list[str], score: str, ret: str, tie: str, cost_bps, least: int = 5) -> DataFrame:
    """keys and book: the mean of the long leg's return less cost and of the short leg's negated return less cost, halved."""
    cost = cost_bps / 10_000.0
    m = legs(rows.select(*dict.fromkeys([*keys, score, tie, ret])), keys, score, tie, least).groupBy(*keys).agg(
        F.avg(F.when(F.col("leg") == "long", F.col(ret))).alias("_long"), F.avg(F.when(F.col("leg") == "short", -F.col(ret))).alias("_short")
    )
    return m.select(*keys, ((F.col("_long") - cost + F.col("_short") - cost) / 2).alias("book"), (F.col("_long") - cost).alias("long_only"))
