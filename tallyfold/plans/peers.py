"""Diffusion to peers whose membership changes: nations of a region that come and go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from ..operators import diffusion
from ..operators.returns import window_returns
from .event_books import _NATIONS, COST, HORIZONS, PARTS, book_sql, nations
from .standins import BASE, Tables
from .studies import query


def memberships(t: Tables) -> DataFrame:
    """Two or three intervals for each nation, by its key; every third has no end."""
    k = F.col("n_nationkey").cast("int")
    span = lambda start, end: F.struct(start.alias("start_date"), end.alias("end_date"))
    day = lambda n: F.date_add(F.lit("1995-01-02").cast("date"), n)
    spans = F.array(span(day(k * 20), day(k * 20 + 500)), span(day(k * 20 + 800), F.when(k % 3 > 0, day(k * 20 + 1300 + k * 10))), span(day(k * 20 + 450), day(k * 20 + 460)))
    return t.raw("nation").select(k.cast("string").alias("ticker"), F.inline(spans))


def sums(t: Tables) -> DataFrame:
    """Events on the day after an urgent order, signed by the nation's own excess on that day, and their peers' returns from the next open."""
    bars = nations(t)
    e = t.filings().where("bucket = 'earnings'").join(t.raw("customer").select(F.col("c_custkey").alias("cik"), F.col("c_nationkey").cast("string").alias("nation")), "cik")
    e = e.select("accession", F.col("nation").alias("ticker"), "part", F.col("entry_idx").alias("idx"), (F.col("entry_idx") - 1).alias("prior"), F.lit("ALL").alias("bench"))
    e = window_returns(window_returns(e, bars, "ticker", "prior", "idx", "rs", "adj_close"), bars, "bench", "prior", "idx", "rb", "adj_close")
    e = e.withColumn("sign", F.signum(F.col("rs") - F.col("rb"))).where("sign <> 0").select("accession", "ticker", "part", "idx", "sign")
    r = bars.where("ticker <> 'ALL'").select("ticker", F.col("idx").alias("p_in"), F.lit("ALL").alias("bench"), F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("horizon")).withColumn("p_out", F.col("p_in") + F.col("horizon"))
    r = window_returns(window_returns(r, bars, "ticker", "p_in", "p_out", "po"), bars, "bench", "p_in", "p_out", "pb")
    r = r.select("ticker", (F.col("p_in") - 1).alias("idx"), "horizon", (F.col("po") - F.col("pb")).alias("x"))
    groups = t.raw("nation").select(F.col("n_nationkey").cast("string").alias("ticker"), F.col("n_regionkey").alias("grp"))
    return diffusion.peer_sums(e, r, groups, diffusion.member_sessions(memberships(t), t.sessions()))


_MEMBER_PEERS = BASE + _NATIONS + """, mb AS (SELECT CAST(n_nationkey AS INTEGER) AS k, DATE '1995-01-02' AS z FROM nation),
mi AS (SELECT k, z + k * 20 AS since, z + k * 20 + 500 AS until FROM mb UNION ALL SELECT k, z + k * 20 + 800, CASE WHEN k % 3 > 0 THEN z + k * 20 + 1300 + k * 10 END FROM mb UNION ALL SELECT k, z + k * 20 + 450, z + k * 20 + 460 FROM mb),
fe AS (SELECT ev.accession, c_nationkey AS k, ev.part, ev.entry_idx, es.day AS entry_day, (a.adj_close / p.adj_close - 1) - (ba.adj_close / bp.adj_close - 1) AS reaction FROM ev JOIN customer ON c_custkey = cik JOIN sessions es ON es.idx = ev.entry_idx
 JOIN np a ON a.ticker = c_nationkey AND a.idx = ev.entry_idx JOIN np p ON p.ticker = c_nationkey AND p.idx = ev.entry_idx - 1 JOIN bars_i ba ON ba.ticker = 'ALL' AND ba.idx = ev.entry_idx JOIN bars_i bp ON bp.ticker = 'ALL' AND bp.idx = ev.entry_idx - 1
 WHERE bucket = 'earnings' AND p.adj_close > 0 AND bp.adj_close > 0),
pp AS (SELECT fe.*, j.n_nationkey AS peer FROM fe JOIN nation i ON i.n_nationkey = fe.k JOIN nation j ON j.n_regionkey = i.n_regionkey AND j.n_nationkey <> fe.k WHERE reaction <> 0
 AND EXISTS (SELECT 1 FROM mi WHERE mi.k = j.n_nationkey AND since <= entry_day AND (until IS NULL OR until >= entry_day))),
px AS (SELECT pp.part, pp.accession, h.horizon, strftime(s.day, '%Y-%m') AS month, sign(reaction) * ((b.adj_close / a.adj_open - 1) - (bb.adj_close / ba.adj_open - 1)) AS x FROM pp CROSS JOIN hz h JOIN sessions s ON s.idx = entry_idx + 1
 JOIN np a ON a.ticker = peer AND a.idx = entry_idx + 1 JOIN np b ON b.ticker = peer AND b.idx = entry_idx + 1 + h.horizon JOIN bars_i ba ON ba.ticker = 'ALL' AND ba.idx = entry_idx + 1 JOIN bars_i bb ON bb.ticker = 'ALL' AND bb.idx = entry_idx + 1 + h.horizon
 WHERE a.adj_open > 0 AND ba.adj_open > 0)
"""


@query(
    _MEMBER_PEERS + """, g AS (SELECT part, horizon, count(*) AS n_pairs, count(DISTINCT accession) AS n_events, avg(x) * 1e4 AS mean_bps, CASE WHEN count(*) > 1 AND stddev_samp(x) > 0 THEN avg(x) / (stddev_samp(x) / sqrt(count(*))) ELSE 0 END AS t, avg(CASE WHEN x > 0 THEN 1.0 ELSE 0.0 END) AS hit_rate FROM px GROUP BY ALL)
SELECT part, horizon, coalesce(n_pairs, 0) AS n_pairs, coalesce(n_events, 0) AS n_events, round(coalesce(mean_bps, 0), 4) AS mean_bps, round(coalesce(t, 0), 4) AS t, round(coalesce(hit_rate, 0), 6) AS hit_rate FROM (SELECT unnest(['explore', 'holdout', 'forward']) AS part) CROSS JOIN (SELECT unnest([1, 5, 20]) AS horizon) LEFT JOIN g USING (part, horizon)"""
)
def member_diffusion(t):
    """Every partition and horizon, without pairs too."""
    cells = t.spark.createDataFrame([(p, h) for p in PARTS for h in HORIZONS], "part string, horizon int")
    p = cells.join(diffusion.pooled(sums(t), ["part", "horizon"], "accession"), ["part", "horizon"], "left").na.fill(0)
    return p.withColumns({c: F.round(c, 4) for c in ("mean_bps", "t")})


@query(_MEMBER_PEERS + ", bm AS (SELECT part, month, avg(x - 0.001) AS r FROM px WHERE horizon = 20 GROUP BY ALL) " + book_sql("bm", "part"))
def member_diffusion_book(t):
    s = t.sessions().select((F.col("idx") - 1).alias("idx"), F.date_format("day", "yyyy-MM").alias("month"))
    m = sums(t).where("horizon = 20").join(s, "idx").groupBy("part", "month").agg((F.sum("s") / F.sum("n") - COST / 10_000.0).alias("r"))
    return stats.book_stats(m, ["part"], "month", "r")
