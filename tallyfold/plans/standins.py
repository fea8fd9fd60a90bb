"""Event-study tables derived from the driver's star schema, the same way in Spark and in the oracle's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import indexed
from ..operators.returns import on_index

SPLIT = "1998-01-01"
EXPLORE_TO, HOLDOUT_TO = 1997, 1999


class Tables:
    """Lazy tables of one folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def orders(self) -> DataFrame:
        c = self.raw("customer").select("c_custkey", "c_mktsegment", "c_nationkey")
        o = self.raw("orders").withColumn("day", F.col("o_orderdate").cast("date"))
        return o.join(c, o.o_custkey == c.c_custkey)

    def sessions(self) -> DataFrame:
        return indexed(self.raw("orders"), "o_orderdate")

    def bars(self) -> DataFrame:
        """Daily bars of each segment and of all orders (ticker ALL); before SPLIT the adjusted close is half."""
        o = self.orders()
        both = o.select("day", "o_orderkey", "o_totalprice", F.explode(F.array("c_mktsegment", F.lit("ALL"))).alias("ticker"))
        b = both.groupBy("ticker", "day").agg(
            F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.count(F.lit(1)).alias("volume")
        )
        return b.withColumn("adj_close", F.col("close") * F.when(F.col("day") < F.lit(SPLIT).cast("date"), 0.5).otherwise(1.0))

    def bars_i(self) -> DataFrame:
        return on_index(self.bars(), self.sessions())

    def filings(self) -> DataFrame:
        """Orders as events: entry on the next session, a signed score, an item bucket and a partition."""
        e = self.orders().join(self.sessions(), "day")
        probability = 0.5 + (F.col("o_orderkey") % 50) / 100.0
        up = F.col("o_custkey") % 2 == 0
        year = F.year("day")
        return e.select(
            F.col("o_orderkey").alias("accession"), F.col("c_mktsegment").alias("ticker"), "day", "idx", (F.col("idx") + 1).alias("entry_idx"), F.col("o_custkey").alias("cik"),
            probability.alias("probability"), F.when(up, "up").otherwise("down").alias("direction"), F.when(up, probability).otherwise(-probability).alias("score"),
            F.when(F.col("o_orderpriority") == "1-URGENT", "high_impact").when(F.col("o_orderpriority") == "2-HIGH", "earnings").otherwise("routine").alias("bucket"),
            F.when(year <= EXPLORE_TO, "explore").when(year <= HOLDOUT_TO, "holdout").otherwise("forward").alias("part"),
        )

    def purchases(self) -> DataFrame:
        return self.orders().select(F.col("c_nationkey").alias("ticker"), "day", F.col("o_orderkey").alias("row_no"), F.col("o_custkey").alias("owner"), F.col("o_totalprice").alias("value"))

    def universe(self) -> DataFrame:
        """Each nation's customers' span of orders; even keys have no end."""
        u = self.orders().groupBy(F.col("c_nationkey").alias("nation"), F.col("o_custkey").alias("ticker")).agg(F.min("day").alias("start_date"), F.max("day").alias("_e"))
        return u.select("nation", "ticker", "start_date", F.when(F.col("ticker") % 2 == 1, F.col("_e")).alias("end_date"))


BASE = f"""
WITH sessions AS (SELECT day, CAST(row_number() OVER (ORDER BY day) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)),
o AS (SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders JOIN customer ON o_custkey = c_custkey),
both_t AS (SELECT day, o_orderkey, o_totalprice, c_mktsegment AS ticker FROM o UNION ALL SELECT day, o_orderkey, o_totalprice, 'ALL' FROM o),
bars AS (SELECT ticker, day, arg_min(o_totalprice, o_orderkey) AS open, arg_max(o_totalprice, o_orderkey) AS close, count(*) AS volume FROM both_t GROUP BY ticker, day),
bars_i AS (SELECT ticker, idx, day, close, close * CASE WHEN day < DATE '{SPLIT}' THEN 0.5 ELSE 1.0 END AS adj_close,
           open * CASE WHEN close = 0 THEN 1.0 ELSE (close * CASE WHEN day < DATE '{SPLIT}' THEN 0.5 ELSE 1.0 END) / close END AS adj_open FROM bars JOIN sessions USING (day)),
ev AS (SELECT o_orderkey AS accession, c_mktsegment AS ticker, day, idx, idx + 1 AS entry_idx, o_custkey AS cik, 0.5 + (o_orderkey % 50) / 100.0 AS probability,
       CASE WHEN o_custkey % 2 = 0 THEN 'up' ELSE 'down' END AS direction, CASE WHEN o_custkey % 2 = 0 THEN 1 ELSE -1 END * (0.5 + (o_orderkey % 50) / 100.0) AS score,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'high_impact' WHEN '2-HIGH' THEN 'earnings' ELSE 'routine' END AS bucket,
       CASE WHEN year(day) <= {EXPLORE_TO} THEN 'explore' WHEN year(day) <= {HOLDOUT_TO} THEN 'holdout' ELSE 'forward' END AS part FROM o JOIN sessions USING (day)),
hz AS (SELECT unnest([1, 5, 20]) AS horizon),
ret0 AS (SELECT ev.*, horizon, entry_idx + horizon AS exit_idx, p.close AS prior_close, a.ticker AS opened,
         CASE WHEN a.adj_open > 0 THEN b.adj_close / a.adj_open - 1 END AS raw, CASE WHEN ba.adj_open > 0 THEN bb.adj_close / ba.adj_open - 1 END AS bench
         FROM ev CROSS JOIN hz LEFT JOIN bars_i p ON p.ticker = ev.ticker AND p.idx = entry_idx - 1 LEFT JOIN bars_i a ON a.ticker = ev.ticker AND a.idx = entry_idx
         LEFT JOIN bars_i b ON b.ticker = ev.ticker AND b.idx = entry_idx + horizon LEFT JOIN bars_i ba ON ba.ticker = 'ALL' AND ba.idx = entry_idx
         LEFT JOIN bars_i bb ON bb.ticker = 'ALL' AND bb.idx = entry_idx + horizon),
ret AS (SELECT *, CASE WHEN exit_idx > (SELECT max(idx) FROM sessions) THEN 'exit_beyond_calendar' WHEN prior_close IS NULL THEN 'no_prior_close' WHEN prior_close < 5 THEN 'prior_close_below_5_usd'
        WHEN opened IS NULL THEN 'security_did_not_trade_on_entry' WHEN raw IS NULL THEN 'missing_price_in_window' WHEN bench IS NULL THEN 'missing_benchmark_in_window' END AS reason, raw - bench AS excess FROM ret0),
good AS (SELECT *, strftime(e.day, '%Y-%m') AS month FROM (SELECT * EXCLUDE (day) FROM ret WHERE reason IS NULL) g JOIN sessions e ON e.idx = g.entry_idx)
"""
