"""Validity intervals: membership on a day, overlap, coverage, peers, matching and reconstruction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN_SINCE = "1957-03-04"


def member_on(day: Column, start: Column, end: Column, inclusive: bool = False) -> Column:
    """start <= day < end, or <= end if inclusive; no end: still a member."""
    return (start <= day) & (end.isNull() | ((end >= day) if inclusive else (end > day)))


def overlaps(lo: Column, hi: Column, start: Column, end: Column) -> Column:
    return (start <= hi) & (end.isNull() | (end > lo))


def health(members: DataFrame, first: int, last: int) -> DataFrame:
    """Members on 30 June of each year."""
    spark = members.sparkSession
    days = spark.range(first, last + 1).select(F.col("id").cast("int").alias("year"), F.make_date(F.col("id").cast("int"), F.lit(6), F.lit(30)).alias("day"))
    hit = members.join(F.broadcast(days), member_on(F.col("day"), F.col("start_date"), F.col("end_date")))  # a row for each year
    return days.join(hit.groupBy("year").agg(F.count(F.lit(1)).alias("n_members")), "year", "left").select("year", F.coalesce("n_members", F.lit(0)).alias("n_members"))


def coverage(members: DataFrame, bars: DataFrame, lo, hi, tolerance: int = 21) -> DataFrame:
    """Tickers whose bars span the window, clamped to their membership, within the tolerance in calendar days."""
    m = members.where(overlaps(F.lit(lo).cast("date"), F.lit(hi).cast("date"), F.col("start_date"), F.col("end_date")))
    span = m.groupBy("ticker").agg(F.min("start_date").alias("since"), F.max(F.coalesce("end_date", F.to_date(F.lit("9999-12-31")))).alias("until"))
    have = bars.groupBy("ticker").agg(F.min("day").alias("first_bar"), F.max("day").alias("last_bar"))
    j = span.join(have, "ticker", "left")
    need_from, need_to = F.greatest("since", F.lit(lo).cast("date")), F.least("until", F.lit(hi).cast("date"))
    ok = (F.col("first_bar") <= F.date_add(need_from, tolerance)) & (F.col("last_bar") >= F.date_sub(need_to, tolerance))
    return j.select("ticker", "first_bar", "last_bar", F.coalesce(ok, F.lit(False)).alias("covered"))


def peers(events: DataFrame, industry: DataFrame, members: DataFrame) -> DataFrame:
    """events with a row for each other ticker of the same group that is a member on the event's day (end inclusive)."""
    mine = industry.select(F.col("ticker").alias("_t"), F.col("sic3"))
    other = industry.select(F.col("ticker").alias("peer"), F.col("sic3").alias("_s"))
    m = members.select(F.col("ticker").alias("_m"), "start_date", "end_date")
    j = events.join(mine, events.ticker == F.col("_t")).join(other, (F.col("sic3") == F.col("_s")) & (F.col("peer") != F.col("ticker"))).drop("_t", "_s")
    return j.join(m, (F.col("peer") == F.col("_m")) & member_on(F.col("day"), F.col("start_date"), F.col("end_date"), True), "left_semi")


def match(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows (cik, name_key, day) with the ticker that is a member by cik, the earliest of several, or else by normalised name if just one is.
    No join makes more rows than it is given: a cik's members stand in one list, by start, and of a name only the spells count in
    which one ticker alone has it (alone()). Those that end meet rows by name and year, the one that does not end by name."""
    m = members.where("start_date is not null and (end_date is null or end_date > start_date)")
    listed = m.where("cik is not null").groupBy(F.col("cik").alias("_cik")).agg(F.sort_array(F.collect_list(F.struct("start_date", "ticker", "end_date"))).alias("_listed"))
    spells = alone(m)
    last = spells.where("until is null").select(F.col("name_key").alias("_l_name"), F.col("since").alias("_last"), F.col("ticker").alias("_l_ticker"))
    years = F.explode(F.sequence(F.year("since"), F.year(F.date_sub("until", 1))))
    ended = spells.where("until is not null").select(F.col("name_key").alias("_e_name"), F.col("since").alias("_since"), F.col("until").alias("_until"), F.col("ticker").alias("_e_ticker"), years.alias("_year"))
    out = rows.join(listed, F.col("cik") == F.col("_cik"), "left").join(last, F.col("name_key") == F.col("_l_name"), "left")
    out = out.join(ended, (F.col("name_key") == F.col("_e_name")) & (F.year("day") == F.col("_year")) & member_on(F.col("day"), F.col("_since"), F.col("_until")), "left")
    by_cik = F.get(F.filter("_listed", lambda x: member_on(F.col("day"), x["start_date"], x["end_date"])), F.lit(0))["ticker"]
    return out.select(*[rows[c] for c in rows.columns], F.coalesce(by_cik, "_e_ticker", F.when(F.col("day") >= F.col("_last"), F.col("_l_ticker"))).alias("ticker"))


def alone(members: DataFrame) -> DataFrame:
    """name_key, since, until and ticker: the spells [since, until) in which just one ticker has the name; they do not overlap. A
    sweep over the days on which a ticker takes or leaves a name: running sums give how many have it, and the only one's number."""
    m = members.where("name_key is not null and ticker is not null").select("name_key", "ticker", "start_date", "end_date")
    ends = F.explode(F.array(F.struct(F.col("start_date").alias("day"), F.lit(1).alias("d")), F.struct(F.col("end_date").alias("day"), F.lit(-1).alias("d"))))
    moves = m.select("name_key", "ticker", ends.alias("_m")).where("_m.day is not null").groupBy("name_key", "ticker", F.col("_m.day").alias("day")).agg(F.sum("_m.d").alias("d"))
    own, name = Window.partitionBy("name_key", "ticker").orderBy("day"), Window.partitionBy("name_key")
    held = moves.withColumn("_has", (F.sum("d").over(own) > 0).cast("long"))
    turns = held.withColumn("_turn", F.col("_has") - F.lag("_has", 1, 0).over(own)).where("_turn <> 0")  # overlapping rows of a ticker are one
    turns = turns.withColumn("_no", F.dense_rank().over(name.orderBy("ticker")).cast("long"))
    days = turns.groupBy("name_key", "day").agg(F.sum("_turn").alias("_k"), F.sum(F.col("_turn") * F.col("_no")).alias("_s"))
    by_day = name.orderBy("day")
    days = days.select("name_key", F.col("day").alias("since"), F.lead("day").over(by_day).alias("until"), F.sum("_k").over(by_day).alias("_k"), F.sum("_s").over(by_day).alias("_no"))
    numbers = turns.select("name_key", "_no", "ticker").distinct()
    return days.where("_k = 1").join(numbers, ["name_key", "_no"]).select("name_key", "since", "until", "ticker")


def first_by(rows: DataFrame, keys: list[str], *order) -> DataFrame:
    """One row for each key: INSERT OR IGNORE, and with the order reversed INSERT OR REPLACE. order: a total one within a key,
    or at least among rows that differ; else any of the tied rows stays."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def append_new(new: DataFrame, old: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` whose key is not in `old`: the append-only log never changes a row."""
    return new.join(old.select(*keys), keys, "left_anti")


def reconstruct(current: DataFrame, changes: DataFrame, since: str = OPEN_SINCE, keys: list[str] | None = None) -> DataFrame:
    """Intervals [start_date, end_date) from present members and dated additions and removals, read backward: an addition
    opens, the next removal of the ticker closes. A member without addition is open from `since`; an addition without a later
    removal, of a ticker that is no present member, makes none; empty intervals go. keys: columns of separate universes."""
    keys = keys or []
    moves = F.explode(F.array(F.struct(F.col("added").alias("ticker"), F.lit(1).alias("kind")), F.struct(F.col("removed").alias("ticker"), F.lit(0).alias("kind"))))
    moved = changes.select(*keys, "day", moves.alias("_m")).select(*keys, "_m.ticker", "day", "_m.kind").where("ticker is not null")
    now = current.select(*keys, "ticker", F.lit(None).cast("date").alias("day"), F.lit(2).alias("kind"))
    w = Window.partitionBy(*keys, "ticker").orderBy(F.col("day").asc_nulls_last(), "kind")
    e = moved.unionByName(now).withColumn("p_day", F.lag("day").over(w)).withColumn("p_kind", F.lag("kind").over(w))
    # a removal, or being a present member, closes what came before it: an addition, a removal whose addition is missing, or
    # nothing known; an addition that nothing closes makes no interval
    e = e.where("kind in (0, 2)").select(*keys, "ticker", F.when(F.col("p_kind").isNull(), F.to_date(F.lit(since))).otherwise(F.col("p_day")).alias("start_date"), F.col("day").alias("end_date"))
    return e.where("end_date is null or end_date > start_date")
