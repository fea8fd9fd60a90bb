"""Stratified sampling by largest remainders, reproducible by a hash of the identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEED = 20260727


def allocation(rows: DataFrame, strata: list[str], total: int) -> DataFrame:
    """strata, n_rows and n_take: the floor of the proportional share, one more for the largest remainders until they add up to total."""
    n = rows.groupBy(*strata).agg(F.count(F.lit(1)).alias("n_rows"))
    every = Window.partitionBy()  # over strata, of which there are few
    share = F.col("n_rows") * total / F.sum("n_rows").over(every)
    n = n.withColumn("_share", F.least(share, F.col("n_rows").cast("double"))).withColumn("_base", F.floor("_share"))
    n = n.withColumn("_r", F.row_number().over(every.orderBy((F.col("_base") - F.col("_share")), *strata))).withColumn("_short", F.least(F.lit(total), F.sum("n_rows").over(every)) - F.sum("_base").over(every))
    return n.select(*strata, "n_rows", (F.col("_base") + (F.col("_r") <= F.col("_short")).cast("int")).cast("long").alias("n_take"))


def stratified(rows: DataFrame, strata: list[str], key: str, total: int, seed: int = SEED) -> DataFrame:
    """n_take rows of each stratum, those with the smallest hash of key and seed. No stratum gives over `total` rows, and that
    bound, a constant, lets each task keep its `total` smallest of a stratum before anything moves (a window group limit, up
    to spark.sql.optimizer.windowGroupLimitThreshold rows: raise it for larger totals)."""
    w = Window.partitionBy(*strata).orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), key)
    few = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= total)
    return few.join(allocation(rows, strata, total), strata).where("_r <= n_take").drop("_r", "n_rows", "n_take")
