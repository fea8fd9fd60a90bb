"""Ranks, medians and fifths within groups of any size.

Rows are sorted by ranges of (group, order) over all tasks and stored with their place in their range; the counts of a
group's rows in the ranges before are a small table, whose running sums turn places into ranks. No task or buffer holds a
group, whatever its share of the rows. Ties of the whole order stand in any order.

Nulls in a key are a group of their own. Rows whose value is null have no rank among the others: they keep a null.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def ranked(rows: DataFrame, keys: list[str], *order: str | Column, where: Column | None = None) -> DataFrame:
    """rows with _pos, the rank in the group from 0, and _n, the group's size. where: rows that count; others get nulls."""
    counts = F.coalesce(where, F.lit(False)) if where is not None else F.lit(True)
    marked = rows.withColumn("_counts", counts)
    place = [*keys, F.desc("_counts"), *order]
    marked = stored(marked.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("_row", F.monotonically_increasing_id()), "ranks")
    part = F.shiftrightunsigned("_row", 33)
    group = Window.partitionBy(*keys)
    ends = marked.where("_counts").groupBy(part.alias("_part"), *keys).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_k"))
    before = F.coalesce(F.sum("_k").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each range
    ends = ends.select(F.col("_part").alias("_e"), *[F.col(k).alias(f"_e_{k}") for k in keys], (before - F.col("_first")).alias("_shift"), F.sum("_k").over(group).alias("_n"))
    same = functools.reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"_e_{k}")) for k in keys], F.col("_counts") & (part == F.col("_e")))
    return marked.join(ends, same, "left").select(*rows.columns, (F.col("_row") + F.col("_shift")).alias("_pos"), "_n")


def with_middle(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """rows with _mid: whether the row is the middle one of its group by value, or one of the two: their mean is the median."""
    r = ranked(rows, keys, value, where=F.col(value).isNotNull())
    mid = (F.col("_pos") == F.floor((F.col("_n") - 1) / 2)) | (F.col("_pos") == F.floor(F.col("_n") / 2))
    return r.withColumn("_mid", F.coalesce(mid, F.lit(False))).drop("_pos", "_n")


def middle(value: str) -> Column:
    """The median, in an aggregation of what with_middle() returned by the same keys."""
    return F.avg(F.when(F.col("_mid"), F.col(value)))
