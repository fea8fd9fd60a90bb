"""Clusters of purchases: trailing windows over earlier rows, a greedy cooldown, and a filter of routine buyers."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def opportunistic(p: DataFrame, years: int = 3) -> DataFrame:
    """Without rows whose owner bought in that calendar month in `years` or more distinct years, later ones included."""
    seen = p.groupBy(F.col("owner").alias("_o"), F.month("day").alias("_m")).agg(F.count_distinct(F.year("day")).alias("_y")).where(F.col("_y") >= years)
    return p.join(seen, (F.col("owner") == F.col("_o")) & (F.month("day") == F.col("_m")), "left_anti")


def trailing(p: DataFrame, days: int = 30) -> DataFrame:
    """For each purchase the distinct owners and the value of its ticker's rows up to it in source order and at most `days` back.

    Every row adds its value where it stands and takes it off when `days` have passed, and an owner's rows that follow each
    other within `days` are one stay, which counts from its first row until `days` after its last. So both numbers are
    running sums over a ticker's rows and endings: linear in its rows, and no row meets another. Values are added as decimals
    of four places, exactly."""
    a = p.select("ticker", "day", "row_no", "owner", F.col("value").cast("decimal(28,4)").alias("_v"))
    own = Window.partitionBy("ticker", "owner").orderBy("day", "row_no")
    before, after = F.lag("day").over(own), F.lead("day").over(own)
    a = a.withColumn("_first", before.isNull() | (F.col("day") > F.date_add(before, days))).withColumn("_last", after.isNull() | (after > F.date_add("day", days)))
    over = F.date_add("day", days + 1)
    rows = a.select("ticker", "day", F.lit(1).alias("_kind"), "row_no", F.col("_first").cast("int").alias("_o"), "_v")
    ends = a.groupBy("ticker", over.alias("day")).agg(F.lit(0).alias("_kind"), F.lit(None).cast("long").alias("row_no"), (-F.sum(F.col("_last").cast("int"))).cast("int").alias("_o"), (-F.sum("_v")).cast("decimal(28,4)").alias("_v"))
    running = Window.partitionBy("ticker").orderBy("day", "_kind", "row_no").rowsBetween(Window.unboundedPreceding, 0)
    t = rows.unionByName(ends).withColumn("n_owners", F.sum("_o").over(running)).withColumn("total_value", F.sum("_v").over(running).cast("double"))
    return t.where("_kind = 1").select("ticker", "day", "row_no", "n_owners", "total_value")


def fired(candidates: DataFrame, cooldown: int = 30) -> DataFrame:
    """Of each ticker's candidates in order, those at least `cooldown` days after the last that fired. Whether a row fires
    depends on which fired before it, so a task walks its tickers' sorted rows and holds one day; a ticker over many batches
    goes on where the last ended."""
    c = candidates.select("ticker", "day", "row_no", "n_owners", "total_value")

    def walk(batches):
        of, last = None, None
        for b in batches:
            tickers, days, kept = b.column(0).to_pylist(), b.column(1).to_pylist(), []
            for i, (ticker, day) in enumerate(zip(tickers, days)):
                if i and ticker != tickers[i - 1] or not i and ticker != of:
                    last = None
                if last is None or (day - last).days >= cooldown:
                    last = day
                    kept.append(i)
            of = tickers[-1] if tickers else of
            yield b.take(pa.array(kept, pa.int64()))

    return c.repartition("ticker").sortWithinPartitions("ticker", "day", "row_no").mapInArrow(walk, c.schema)


def cluster_events(p: DataFrame, owners: int = 2, value: float = 0.0, days: int = 30, cooldown: int = 30) -> DataFrame:
    t = trailing(p, days).where((F.col("n_owners") >= owners) & (F.col("total_value") >= value))
    return fired(t, cooldown)
