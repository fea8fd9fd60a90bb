"""Returns of the studies: event studies with every cell, monthly books, momentum and trend statistics, staleness reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, stats
from ..operators import allocation, books, clusters
from ..operators.returns import ledger, window_returns
from ..storage import stored
from .standins import BASE, EXPLORE_TO, HOLDOUT_TO, Tables
from .studies import _CHANGE, _ENDS, _STALE, _TRAIL, CHARS, HORIZONS, changed, priced, query, returns, staled

PARTS = ["explore", "holdout", "forward"]
COST = 10


def book_sql(source: str, keys: str, value: str = "r", order: str = "month") -> str:
    """SQL of stats.book_stats."""
    over = f"OVER (PARTITION BY {keys} ORDER BY {order} ROWS UNBOUNDED PRECEDING)"
    two = "count(*) > 1"
    return f"""SELECT {keys}, count(*) AS n_months, round(CASE WHEN {two} THEN avg({value}) ELSE 0 END, 6) AS mean_monthly,
round(CASE WHEN {two} AND stddev_samp({value}) > 0 THEN avg({value}) / stddev_samp({value}) * sqrt(12) ELSE 0 END, 6) AS sharpe, round(CASE WHEN {two} THEN abs(least(0, min(wealth / peak - 1))) ELSE 0 END, 6) AS max_drawdown
FROM (SELECT *, greatest(1.0, max(wealth) {over}) AS peak FROM (SELECT *, product(1 + {value}) {over} AS wealth FROM {source})) GROUP BY {keys}"""


def bps_sql(x: str = "excess") -> str:
    """SQL of stats.bps_summary."""
    return f"""count({x}) AS n, round(coalesce(avg({x}) * 1e4, 0), 6) AS mean_bps, round(coalesce(median({x}) * 1e4, 0), 6) AS median_bps,
round(CASE WHEN count({x}) > 1 AND stddev_samp({x}) > 0 THEN avg({x}) / (stddev_samp({x}) / sqrt(count({x}))) ELSE 0 END, 6) AS t, round(coalesce(avg(CASE WHEN {x} > 0 THEN 1.0 WHEN {x} <= 0 THEN 0.0 END), 0), 6) AS hit_rate"""


def part_of_year(year):
    return F.when(year <= EXPLORE_TO, "explore").when(year <= HOLDOUT_TO, "holdout").otherwise("forward")


_PART = f"CASE WHEN year(day) <= {EXPLORE_TO} THEN 'explore' WHEN year(day) <= {HOLDOUT_TO} THEN 'holdout' ELSE 'forward' END"
_CELLS = "(SELECT unnest(['explore', 'holdout', 'forward']) AS part) CROSS JOIN (SELECT unnest([1, 5, 20]) AS horizon)"

# filings buried before weekends and holidays

_BURIED = """, tn AS (SELECT ev.accession, ev.day, ev.accession % 24 >= 16 AS late, s.day AS nd FROM ev LEFT JOIN sessions s ON s.idx = ev.idx + 1),
bu AS (SELECT accession, isodow(day) >= 6 OR (isodow(day) = 5 AND late) OR (late AND coalesce(list_bool_or([isodow(x) <= 5 FOR x IN generate_series(CAST(day AS TIMESTAMP) + INTERVAL 1 DAY, CAST(nd AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY)]), false)) AS buried FROM tn),
gb AS (SELECT good.*, CASE WHEN buried THEN 'buried' ELSE 'control' END AS grp FROM good JOIN bu USING (accession))
"""


def bucketed(t: Tables) -> DataFrame:
    """Priced events with the bucket of their acceptance: weekend, preholiday or control."""
    at = t.filings().select(F.col("accession").alias("_a"), F.expr("cast(day as timestamp) + make_interval(0, 0, 0, 0, accession % 24)").alias("at"))
    b = calendar.acceptance_bucket(at, t.sessions(), "at", "UTC").select("_a", F.col("bucket").alias("grp"))
    return priced(t).join(b, F.col("accession") == F.col("_a")).drop("_a")


def buried(t: Tables) -> DataFrame:
    """Priced events with grp: buried where the bucket of the acceptance is weekend or preholiday, else control."""
    return bucketed(t).withColumn("grp", F.when(F.col("grp") == "control", "control").otherwise("buried"))


@query(BASE + _BURIED + f"SELECT c.part, c.horizon, g.grp, {bps_sql()} FROM ({_CELLS}) c CROSS JOIN (SELECT unnest(['buried', 'control']) AS grp) g LEFT JOIN gb ON gb.part = c.part AND gb.horizon = c.horizon AND gb.grp = g.grp GROUP BY ALL")
def timing_study(t):
    return stats.every_cell(buried(t).select("part", "horizon", "grp", "excess"), {"part": PARTS, "horizon": list(HORIZONS), "grp": ["buried", "control"]}, "excess", stats.bps_summary("excess"))


@query(
    BASE + _BURIED + f""", bk AS (SELECT accession, CASE WHEN isodow(day) >= 6 OR (isodow(day) = 5 AND late) THEN 'weekend' WHEN buried THEN 'preholiday' ELSE 'control' END AS grp FROM tn JOIN bu USING (accession)),
g3 AS (SELECT good.part, good.horizon, good.excess, bk.grp FROM good JOIN bk USING (accession))
SELECT c.part, c.horizon, g.grp, {bps_sql()} FROM ({_CELLS}) c CROSS JOIN (SELECT unnest(['weekend', 'preholiday', 'control']) AS grp) g LEFT JOIN g3 ON g3.part = c.part AND g3.horizon = c.horizon AND g3.grp = g.grp GROUP BY ALL"""
)
def timing_by_bucket(t):
    """Weekends and days before holidays apart."""
    return stats.every_cell(bucketed(t).select("part", "horizon", "grp", "excess"), {"part": PARTS, "horizon": list(HORIZONS), "grp": ["weekend", "preholiday", "control"]}, "excess", stats.bps_summary("excess"))


@query(
    BASE + _BURIED + """, w AS (SELECT part, horizon, count(a) AS na, count(b) AS nb, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb FROM (SELECT part, horizon, CASE WHEN grp = 'buried' THEN excess END AS a, CASE WHEN grp = 'control' THEN excess END AS b FROM gb) GROUP BY ALL),
tt AS (SELECT *, CASE WHEN na > 1 AND nb > 1 AND va / na + vb / nb > 0 THEN (ma - mb) / sqrt(va / na + vb / nb) ELSE 0 END AS t FROM w), k AS (SELECT *, 1 / (1 + 0.2316419 * abs(t)) AS k FROM tt)
SELECT part, horizon, na AS n_buried, nb AS n_control, round(coalesce((ma - mb) * 1e4, 0), 6) AS diff_bps, round(t, 6) AS t,
round(2 * exp(-t * t / 2) / 2.5066282746310002 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))), 6) AS p FROM k"""
)
def timing_contrast(t):
    a, b = (F.when(F.col("grp") == g, F.col("excess")) for g in ("buried", "control"))
    w = buried(t).withColumn("_a", a).withColumn("_b", b).groupBy("part", "horizon")
    w = w.agg(F.count("_a").alias("n_buried"), F.count("_b").alias("n_control"), F.coalesce((F.avg("_a") - F.avg("_b")) * 1e4, F.lit(0.0)).alias("diff_bps"), stats.welch(F.col("_a"), F.col("_b")).alias("t"))
    return w.withColumn("p", stats.two_sided(F.col("t")))


@query(BASE + _BURIED + ", bm AS (SELECT part, month, avg(-excess - 0.001) AS r FROM gb WHERE grp = 'buried' AND horizon = 20 GROUP BY ALL) " + book_sql("bm", "part"))
def timing_short_book(t):
    """Short what was buried, by month of entry, less cost."""
    b = buried(t).where("grp = 'buried' and horizon = 20").groupBy("part", "month").agg(F.avg(-F.col("excess") - COST / 10_000.0).alias("r"))
    return stats.book_stats(b, ["part"], "month", "r")


# a panel of nations, for studies that need many tickers: the last close is carried on

_NATIONS = """, nb AS (SELECT c_nationkey AS ticker, day, arg_min(o_totalprice, o_orderkey) AS open, arg_max(o_totalprice, o_orderkey) AS close FROM o GROUP BY ALL),
np AS (SELECT *, coalesce(open, adj_close) AS adj_open FROM (SELECT t.ticker, s.idx, s.day, nb.open, last_value(nb.close IGNORE NULLS) OVER (PARTITION BY t.ticker ORDER BY s.idx ROWS UNBOUNDED PRECEDING) AS adj_close
 FROM (SELECT DISTINCT c_nationkey AS ticker FROM customer) t CROSS JOIN sessions s LEFT JOIN nb ON nb.ticker = t.ticker AND nb.day = s.day) WHERE adj_close IS NOT NULL)
"""


def nations(t: Tables) -> DataFrame:
    """Bars with the benchmark as ticker ALL; a nation's last close is carried over sessions without orders."""
    b = t.orders().groupBy(F.col("c_nationkey").cast("string").alias("ticker"), "day").agg(F.min_by("o_totalprice", "o_orderkey").alias("open"), F.max_by("o_totalprice", "o_orderkey").alias("close"))
    every = t.sessions().crossJoin(F.broadcast(t.raw("customer").select(F.col("c_nationkey").cast("string").alias("ticker")).distinct()))  # 25 nations
    carried = F.last("close", ignorenulls=True).over(Window.partitionBy("ticker").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    p = every.join(b, ["ticker", "day"], "left").withColumn("adj_close", carried).where("adj_close is not null")
    p = p.select("ticker", "idx", F.col("adj_close").alias("close"), F.coalesce("open", "adj_close").alias("adj_open"), "adj_close")
    return p.unionByName(t.bars_i().where("ticker = 'ALL'").select("ticker", "idx", "close", "adj_open", "adj_close"))


def with_excess(t: Tables, events: DataFrame, bars: DataFrame, horizons=HORIZONS) -> DataFrame:
    """events (ticker, idx) times horizons with excess from the next session's open, and month and part; rows without a price go."""
    e = events.withColumn("entry_idx", F.col("idx") + 1).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).withColumn("exit_idx", F.col("entry_idx") + F.col("horizon")).withColumn("bench", F.lit("ALL"))
    e = window_returns(window_returns(e, bars, "ticker", "entry_idx", "exit_idx", "r_own"), bars, "bench", "entry_idx", "exit_idx", "r_all")
    s = t.sessions().select(F.col("idx").alias("_i"), F.date_format("day", "yyyy-MM").alias("month"), part_of_year(F.year("day")).alias("part"))
    e = e.withColumn("excess", F.col("r_own") - F.col("r_all")).where("excess is not null")
    return e.join(s, e.entry_idx == F.col("_i")).drop("_i")


_CLUSTERS = (
    BASE.replace("WITH sessions", "WITH RECURSIVE sessions") + _NATIONS + _TRAIL.replace("WITH p", ", p") + """, cand AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day, row_no) AS rn FROM tr WHERE n_owners >= 3 AND total_value >= 500000),
f AS (SELECT ticker, rn, day, true AS fires, day AS last FROM cand WHERE rn = 1 UNION ALL
 SELECT c.ticker, c.rn, c.day, c.day - f.last >= 30, CASE WHEN c.day - f.last >= 30 THEN c.day ELSE f.last END FROM f JOIN cand c ON c.ticker = f.ticker AND c.rn = f.rn + 1),
ce AS (SELECT f.ticker, f.day AS event_day, s.idx + 1 AS entry_idx FROM f JOIN sessions s ON s.day = f.day WHERE fires),
cx AS (SELECT ce.ticker, h.horizon, CASE WHEN year(s.day) <= 1997 THEN 'explore' WHEN year(s.day) <= 1999 THEN 'holdout' ELSE 'forward' END AS part, strftime(s.day, '%Y-%m') AS month, (x.adj_close / a.adj_open - 1) - (bx.adj_close / ba.adj_open - 1) AS excess
 FROM ce CROSS JOIN hz h JOIN sessions s ON s.idx = entry_idx JOIN np a ON a.ticker = ce.ticker AND a.idx = entry_idx JOIN np x ON x.ticker = ce.ticker AND x.idx = entry_idx + h.horizon
 JOIN bars_i ba ON ba.ticker = 'ALL' AND ba.idx = entry_idx JOIN bars_i bx ON bx.ticker = 'ALL' AND bx.idx = entry_idx + h.horizon WHERE a.adj_open > 0 AND ba.adj_open > 0)
"""
)


def cluster_returns(t: Tables) -> DataFrame:
    c = clusters.cluster_events(t.purchases(), 3, 500_000.0).select(F.col("ticker").cast("string").alias("ticker"), "day")
    return with_excess(t, c.join(t.sessions(), "day"), nations(t))


@query(_CLUSTERS + f"SELECT c.part, c.horizon, {bps_sql()} FROM ({_CELLS}) c LEFT JOIN cx ON cx.part = c.part AND cx.horizon = c.horizon GROUP BY ALL")
def insider_study(t):
    return stats.every_cell(cluster_returns(t).select("part", "horizon", "excess"), {"part": PARTS, "horizon": list(HORIZONS)}, "excess", stats.bps_summary("excess"))


@query(_CLUSTERS + ", bm AS (SELECT part, month, avg(excess - 0.001) AS r FROM cx WHERE horizon = 20 GROUP BY ALL) " + book_sql("bm", "part"))
def insider_long_book(t):
    b = cluster_returns(t).where("horizon = 20").groupBy("part", "month").agg(F.avg(F.col("excess") - COST / 10_000.0).alias("r"))
    return stats.book_stats(b, ["part"], "month", "r")


# diffusion by horizon: the peers of a group are summed once for each day, and the filer is taken off

_PEERS = """, ind AS (SELECT DISTINCT ticker, length(ticker) % 2 AS g FROM ev), fr AS (SELECT ev.accession, ev.ticker, entry_idx, part, (a.adj_close / p.adj_close - 1) - (ba.adj_close / bp.adj_close - 1) AS reaction FROM ev
 JOIN bars_i a ON a.ticker = ev.ticker AND a.idx = entry_idx JOIN bars_i p ON p.ticker = ev.ticker AND p.idx = entry_idx - 1 JOIN bars_i ba ON ba.ticker = 'ALL' AND ba.idx = entry_idx JOIN bars_i bp ON bp.ticker = 'ALL' AND bp.idx = entry_idx - 1 WHERE bucket = 'earnings'),
px AS (SELECT fr.part, fr.accession, h.horizon, strftime(s.day, '%Y-%m') AS month, sign(reaction) * ((b.adj_close / a.adj_open - 1) - (bb.adj_close / ba.adj_open - 1)) AS x FROM fr JOIN ind i ON i.ticker = fr.ticker JOIN ind j ON j.g = i.g AND j.ticker <> fr.ticker CROSS JOIN hz h
 JOIN sessions s ON s.idx = entry_idx + 1 JOIN bars_i a ON a.ticker = j.ticker AND a.idx = entry_idx + 1 JOIN bars_i b ON b.ticker = j.ticker AND b.idx = entry_idx + 1 + h.horizon
 JOIN bars_i ba ON ba.ticker = 'ALL' AND ba.idx = entry_idx + 1 JOIN bars_i bb ON bb.ticker = 'ALL' AND bb.idx = entry_idx + 1 + h.horizon WHERE reaction <> 0 AND a.adj_open > 0 AND ba.adj_open > 0)
"""


def peer_sums(t: Tables) -> DataFrame:
    """For each event and horizon: sign of the filer's reaction, and n, sum and sum of squares of its peers' excess returns.
    Returns are summed over a group for each entry session, so an event never meets its peers one by one."""
    b = t.bars_i()
    e = t.filings().where("bucket = 'earnings'").withColumn("bench", F.lit("ALL")).withColumn("prior", F.col("entry_idx") - 1)
    e = window_returns(window_returns(e, b, "ticker", "prior", "entry_idx", "rs", "adj_close"), b, "bench", "prior", "entry_idx", "rb", "adj_close")
    e = e.withColumn("sign", F.signum(F.col("rs") - F.col("rb"))).where("sign <> 0").select("accession", "ticker", "part", "sign", (F.col("entry_idx") + 1).alias("p_in"))
    group = t.filings().select("ticker").distinct().withColumn("grp", F.length("ticker") % 2)
    day = b.join(group, "ticker").select("ticker", "grp", F.col("idx").alias("p_in"), F.lit("ALL").alias("bench"), F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("horizon")).withColumn("p_out", F.col("p_in") + F.col("horizon"))
    day = window_returns(window_returns(day, b, "ticker", "p_in", "p_out", "po"), b, "bench", "p_in", "p_out", "pb")
    day = day.withColumn("x", F.col("po") - F.col("pb")).where("x is not null").select("ticker", "grp", "p_in", "horizon", "x")
    every = day.groupBy("grp", "p_in", "horizon").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"))
    own = day.select(F.col("ticker").alias("_t"), F.col("p_in").alias("_p"), F.col("horizon").alias("_h"), F.col("x").alias("own"))
    j = e.join(group, "ticker").join(every, ["grp", "p_in"]).join(own, (F.col("ticker") == F.col("_t")) & (F.col("p_in") == F.col("_p")) & (F.col("horizon") == F.col("_h")), "left")
    mine = F.col("own").isNotNull()
    zero = F.coalesce("own", F.lit(0.0))
    j = j.select("accession", "part", "horizon", "p_in", "sign", (F.col("n") - mine.cast("int")).alias("n"), (F.col("s") - zero).alias("s"), (F.col("q") - zero * zero).alias("q"))
    return j.where("n > 0")


@query(BASE + _PEERS + "SELECT part, horizon, count(*) AS n_pairs, count(DISTINCT accession) AS n_events, round(avg(x) * 1e4, 4) AS mean_bps, round(CASE WHEN count(*) > 1 AND stddev_samp(x) > 0 THEN avg(x) / (stddev_samp(x) / sqrt(count(*))) ELSE 0 END, 4) AS t FROM px GROUP BY ALL")
def diffusion_study(t):
    n, s, q = F.sum("n"), F.sum(F.col("sign") * F.col("s")), F.sum("q")
    sd = F.sqrt((q - s * s / n) / (n - 1))
    p = peer_sums(t).groupBy("part", "horizon").agg(n.alias("n_pairs"), F.count_distinct("accession").alias("n_events"), (s / n * 1e4).alias("mean_bps"), F.when((n > 1) & (sd > 0), s / n / (sd / F.sqrt(n))).otherwise(0.0).alias("t"))
    return p.withColumns({c: F.round(c, 4) for c in ("mean_bps", "t")})


@query(BASE + _PEERS + ", bm AS (SELECT part, month, avg(x - 0.001) AS r FROM px WHERE horizon = 20 GROUP BY ALL) " + book_sql("bm", "part"))
def diffusion_book(t):
    s = t.sessions().select(F.col("idx").alias("p_in"), F.date_format("day", "yyyy-MM").alias("month"))
    m = peer_sums(t).where("horizon = 20").join(s, "p_in").groupBy("part", "month").agg((F.sum(F.col("sign") * F.col("s")) / F.sum("n") - COST / 10_000.0).alias("r"))
    return stats.book_stats(m, ["part"], "month", "r")


# momentum and trend

_MOMENTUM = (
    BASE + _NATIONS + _ENDS + """, mo AS (SELECT a.ticker, e.idx, e.day, a.adj_close / b.adj_close - 1 AS momentum FROM ends e JOIN np a ON a.idx = e.idx - 5 JOIN np b ON b.ticker = a.ticker AND b.idx = e.idx - 60 WHERE e.idx >= 60 AND e.idx + 22 < (SELECT count(*) FROM sessions) AND b.adj_close > 0),
mx AS (SELECT mo.*, (x.adj_close / a.adj_open - 1) - (bx.adj_close / ba.adj_open - 1) AS excess FROM mo JOIN np a ON a.ticker = mo.ticker AND a.idx = mo.idx + 1 JOIN np x ON x.ticker = mo.ticker AND x.idx = mo.idx + 21
 JOIN bars_i ba ON ba.ticker = 'ALL' AND ba.idx = mo.idx + 1 JOIN bars_i bx ON bx.ticker = 'ALL' AND bx.idx = mo.idx + 21 WHERE a.adj_open > 0 AND ba.adj_open > 0),
mr AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY momentum, CAST(ticker AS VARCHAR)) AS rn, count(*) OVER (PARTITION BY idx) AS n FROM mx),
ml AS (SELECT idx, day, avg(excess) FILTER (rn > n - n // 5) AS lo, avg(-excess) FILTER (rn <= n // 5) AS sh FROM mr WHERE n >= 10 GROUP BY ALL),
mb AS (SELECT """ + _PART + """ AS part, c.cost_bps, day AS month, (lo + sh) / 2 - c.cost_bps / 10000.0 AS r, lo - c.cost_bps / 10000.0 AS l FROM ml, (SELECT unnest([10, 25]) AS cost_bps) c) """
)


@query(_MOMENTUM + "SELECT a.part, a.cost_bps, a.n_months, a.mean_monthly AS ls_mean_monthly, a.sharpe AS ls_sharpe, b.sharpe AS long_only_sharpe, a.max_drawdown AS ls_max_drawdown FROM (" + book_sql("mb", "part, cost_bps") + ") a JOIN (" + book_sql("mb", "part, cost_bps", "l") + ") b ON a.part = b.part AND a.cost_bps = b.cost_bps")
def momentum_study(t):
    """Winners less losers of each month, fifths of ten names or more, held twenty sessions."""
    bars = nations(t)
    m = allocation.momentum(bars.where("ticker <> 'ALL'"), t.sessions(), 60, 5, 20).withColumnRenamed("day", "formed")
    x = with_excess(t, m, bars, (20,))
    b = books.monthly_book(x, ["formed"], "momentum", "excess", "ticker", 0, 10)
    b = b.withColumn("part", part_of_year(F.year("formed"))).withColumn("cost_bps", F.explode(F.array(F.lit(10), F.lit(25)))).withColumn("c", F.col("cost_bps") / 10_000.0)
    ls, lo = (stats.book_stats(b.withColumn("r", F.col(c) - F.col("c")), ["part", "cost_bps"], "formed", "r") for c in ("book", "long_only"))
    lo = lo.select("part", "cost_bps", F.col("sharpe").alias("long_only_sharpe"))
    return ls.join(lo, ["part", "cost_bps"]).select("part", "cost_bps", "n_months", F.col("mean_monthly").alias("ls_mean_monthly"), F.col("sharpe").alias("ls_sharpe"), "long_only_sharpe", F.col("max_drawdown").alias("ls_max_drawdown"))


_TREND = (
    BASE + _ENDS + """, en AS (SELECT idx, lead(idx) OVER (ORDER BY idx) AS nx, lead(day) OVER (ORDER BY idx) AS month FROM ends), sl AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS sleeve),
g AS (SELECT en.*, sleeve, CASE WHEN t.adj_close > 0 AND n.adj_close / t.adj_close - 1 > 0 THEN sleeve ELSE 'ALL' END AS held FROM en CROSS JOIN sl LEFT JOIN bars_i n ON n.ticker = sleeve AND n.idx = en.idx LEFT JOIN bars_i t ON t.ticker = sleeve AND t.idx = en.idx - 60 WHERE nx IS NOT NULL AND en.idx >= 60),
h AS (SELECT g.*, b.adj_close / a.adj_close - 1 AS r, count(b.adj_close / a.adj_close - 1) OVER (PARTITION BY month) AS k FROM g LEFT JOIN bars_i a ON a.ticker = held AND a.idx = g.idx AND a.adj_close > 0 LEFT JOIN bars_i b ON b.ticker = held AND b.idx = nx),
c AS (SELECT *, CASE WHEN held IS DISTINCT FROM lag(held) OVER (PARTITION BY sleeve ORDER BY month) THEN 1 ELSE 0 END AS ch FROM h WHERE k = 5),
tr AS (SELECT idx, nx, month, avg(r) - sum(ch) / 5.0 * 2 * 10 / 10000.0 AS r FROM c GROUP BY ALL),
al AS (SELECT tr.*, sb.adj_close / sa.adj_close - 1 AS s, bb.adj_close / ba.adj_close - 1 AS b FROM tr JOIN bars_i sa ON sa.ticker = 'ALL' AND sa.idx = tr.idx JOIN bars_i sb ON sb.ticker = 'ALL' AND sb.idx = nx JOIN bars_i ba ON ba.ticker = 'BUILDING' AND ba.idx = tr.idx JOIN bars_i bb ON bb.ticker = 'BUILDING' AND bb.idx = nx WHERE sa.adj_close > 0 AND ba.adj_close > 0),
lg AS (SELECT month, CASE WHEN year(month) <= 1999 THEN 'backtest' ELSE 'forward' END AS period, unnest(['trend', 'hold', 'mixed']) AS label, unnest([r, s, 0.6 * s + 0.4 * b]) AS x FROM al),
lw AS (SELECT *, product(1 + x) OVER (PARTITION BY period, label ORDER BY month ROWS UNBOUNDED PRECEDING) AS wealth FROM lg),
lp AS (SELECT *, greatest(1.0, max(wealth) OVER (PARTITION BY period, label ORDER BY month ROWS UNBOUNDED PRECEDING)) AS peak FROM lw) """
)


@query(_TREND + "SELECT label, period, count(*) AS n_months, round(CASE WHEN count(*) > 1 THEN pow(product(1 + x), 12.0 / count(*)) - 1 ELSE 0 END, 6) AS cagr, round(CASE WHEN count(*) > 1 THEN stddev_samp(x) * sqrt(12) ELSE 0 END, 6) AS volatility, round(CASE WHEN count(*) > 1 THEN avg(x) / stddev_samp(x) * sqrt(12) ELSE 0 END, 6) AS sharpe, round(CASE WHEN count(*) > 1 THEN abs(least(0, min(wealth / peak - 1))) ELSE 0 END, 6) AS max_drawdown FROM lp GROUP BY label, period")
def trend_stats(t):
    """The allocation beside holding the benchmark and a static 60/40, on the months that all three have."""
    tr = allocation.trend(t.bars_i(), t.sessions(), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "ALL", 60)
    period = F.when(F.year("month") <= HOLDOUT_TO, "backtest").otherwise("forward")
    return allocation.compared(tr, t.bars_i(), t.sessions(), "ALL", "BUILDING", period)


# novelty, drift, staleness


@query(
    BASE + ", " + _CHANGE + """, nq AS (SELECT g.accession, g.excess, substr(month, 1, 4) || 'Q' || CAST(ceil(CAST(substr(month, 6, 2) AS INTEGER) / 3.0) AS INTEGER) AS quarter, -round(change, 9) AS calm FROM good g JOIN ch ON ch.doc_id = g.accession WHERE horizon = 5),
r AS (SELECT *, row_number() OVER (PARTITION BY quarter ORDER BY calm, accession) AS rn, count(*) OVER (PARTITION BY quarter) AS n FROM nq), q AS (SELECT *, CASE WHEN rn > n - n // 5 THEN 'long' WHEN rn <= n // 5 THEN 'short' END AS leg FROM r WHERE n >= 5)
SELECT quarter, round((avg(excess) FILTER (leg = 'long') - 0.001 + avg(-excess) FILTER (leg = 'short') - 0.001) / 2, 6) AS book, round(avg(excess) FILTER (leg = 'long') - 0.001, 6) AS long_only FROM q WHERE leg IS NOT NULL GROUP BY quarter"""
)
def novelty_book(t):
    """Long the least changed documents, short the most changed, by quarter; a document stands for the order of its number, and its
    first CHARS characters for its text."""
    x = priced(t, (5,)).join(changed(t, CHARS), F.col("accession") == F.col("doc_id")).withColumn("quarter", F.concat(F.substring("month", 1, 4), F.lit("Q"), F.quarter(F.to_date(F.concat("month", F.lit("-01"))))))
    return books.monthly_book(x.withColumn("calm", -F.round("change", 9)), ["quarter"], "calm", "excess", "accession", COST)


@query(
    BASE + _STALE + """, su AS (SELECT accession, pre AS surprise, post, strftime(s.day, '%Y-%m') AS month FROM (SELECT * EXCLUDE (day) FROM fr WHERE bucket = 'earnings') f JOIN sessions s ON s.idx = entry_idx),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY surprise, accession) AS rn, count(*) OVER (PARTITION BY month) AS n FROM su),
m AS (SELECT month, avg(post) FILTER (rn > n - n // 5) AS lo, avg(-post) FILTER (rn <= n // 5) AS sh FROM r WHERE n >= 5 GROUP BY month),
bm AS (SELECT c.cost_bps, month, (lo + sh) / 2 - c.cost_bps / 10000.0 AS r FROM m, (SELECT unnest([0, 10, 25]) AS cost_bps) c) """ + book_sql("bm", "cost_bps")
)
def drift_stats(t):
    s = t.sessions().select(F.col("idx").alias("_i"), F.date_format("day", "yyyy-MM").alias("month"))
    e = staled(t).where("bucket = 'earnings'").join(s, F.col("entry_idx") == F.col("_i"))
    b = books.monthly_book(e, ["month"], "pre", "post", "accession", 0).withColumn("cost_bps", F.explode(F.array(*[F.lit(c) for c in (0, 10, 25)])))
    return stats.book_stats(b.withColumn("r", F.col("book") - F.col("cost_bps") / 10_000.0), ["cost_bps"], "month", "r")


HOLDS, PRIMARY = (5, 10, 20), 20
_HELD = _STALE.replace("entry_idx + 5", "entry_idx + hold").replace("SELECT se.*, (a.adj_open", "SELECT se.*, hold, (a.adj_open").replace("AS post FROM se\n", f"AS post FROM se CROSS JOIN (SELECT unnest({list(HOLDS)}) AS hold)\n")


@query(
    BASE + _HELD + """, su AS (SELECT hold, accession, pre AS surprise, post, strftime(s.day, '%Y-%m') AS month FROM (SELECT * EXCLUDE (day) FROM fr WHERE bucket = 'earnings' AND part = 'explore') f JOIN sessions s ON s.idx = entry_idx),
r AS (SELECT *, row_number() OVER (PARTITION BY hold, month ORDER BY surprise, accession) AS rn, count(*) OVER (PARTITION BY hold, month) AS n FROM su),
m AS (SELECT hold, month, avg(post) FILTER (rn > n - n // 5) AS lo, avg(-post) FILTER (rn <= n // 5) AS sh FROM r WHERE n >= 5 GROUP BY ALL),
c AS (SELECT hold, c.cost_bps, month, (lo + sh) / 2 - c.cost_bps / 10000.0 AS ls, lo - c.cost_bps / 10000.0 AS lo FROM m, (SELECT unnest([0, 10, 25]) AS cost_bps) c),
g AS (SELECT CASE WHEN cost_bps = 10 THEN 'book' END AS book, CASE WHEN hold = 20 THEN 'cost' END AS cost, hold, cost_bps, count(*) AS n, avg(ls) AS ls_mean, avg(lo) AS lo_mean,
 CASE WHEN count(*) > 1 AND stddev_samp(ls) > 0 THEN avg(ls) / stddev_samp(ls) * sqrt(12) ELSE 0 END AS ls_sharpe, CASE WHEN count(*) > 1 AND stddev_samp(lo) > 0 THEN avg(lo) / stddev_samp(lo) * sqrt(12) ELSE 0 END AS lo_sharpe FROM c GROUP BY hold, cost_bps),
y AS (SELECT substr(month, 1, 4) AS year, count(*) AS n, avg(lo) AS lo_mean, CASE WHEN count(*) > 1 AND stddev_samp(lo) > 0 THEN avg(lo) / stddev_samp(lo) * sqrt(12) ELSE 0 END AS lo_sharpe FROM c WHERE hold = 20 AND cost_bps = 10 GROUP BY 1)
SELECT 'books' AS section, CAST(hold AS VARCHAR) AS of, n, round(ls_mean, 6) AS ls_mean, round(ls_sharpe, 6) AS ls_sharpe, round(lo_mean, 6) AS lo_mean, round(lo_sharpe, 6) AS lo_sharpe FROM g WHERE book IS NOT NULL
UNION ALL SELECT 'costs', CAST(cost_bps AS VARCHAR), n, round(ls_mean, 6), round(ls_sharpe, 6), round(lo_mean, 6), round(lo_sharpe, 6) FROM g WHERE cost IS NOT NULL
UNION ALL SELECT 'years', year, n, NULL, NULL, round(lo_mean, 6), round(lo_sharpe, 6) FROM y"""
)
def drift_robustness(t):
    """On the exploration years: the long-short and the long-only book by holding period at the base cost, by cost at the primary
    one, and the long-only book by year. Each book is made once, before costs."""
    s = t.sessions().select(F.col("idx").alias("_i"), F.date_format("day", "yyyy-MM").alias("month"))
    e = None
    for hold in HOLDS:
        h = staled(t, hold).where("bucket = 'earnings' and part = 'explore'").select("accession", "entry_idx", "pre", "post", F.lit(hold).alias("hold"))
        e = h if e is None else e.unionByName(h)
    b = stored(books.monthly_book(e.join(s, F.col("entry_idx") == F.col("_i")), ["hold", "month"], "pre", "post", "accession", 0), "books")
    c = b.withColumn("cost_bps", F.explode(F.array(*[F.lit(k) for k in (0, 10, 25)]))).withColumns({"ls": F.col("book") - F.col("cost_bps") / 10_000.0, "lo": F.col("long_only") - F.col("cost_bps") / 10_000.0})

    def part(rows: DataFrame, section: str, of: Column, both: bool = True) -> DataFrame:
        mean = lambda x: [F.avg(x).alias(f"{x}_mean"), F.when((F.count(x) > 1) & (F.stddev_samp(x) > 0), F.avg(x) / F.stddev_samp(x) * F.sqrt(F.lit(12.0))).otherwise(0.0).alias(f"{x}_sharpe")]
        g = rows.groupBy(of.cast("string").alias("of")).agg(F.count(F.lit(1)).alias("n"), *mean("ls"), *mean("lo"))
        none = F.lit(None).cast("double")
        return g.select(F.lit(section).alias("section"), "of", "n", *[(F.col(x) if both else none).alias(x) for x in ("ls_mean", "ls_sharpe")], "lo_mean", "lo_sharpe")

    base = c.where(F.col("cost_bps") == COST)
    primary = F.col("hold") == PRIMARY
    return part(base, "books", F.col("hold")).unionByName(part(c.where(primary), "costs", F.col("cost_bps"))).unionByName(part(base.where(primary), "years", F.substring("month", 1, 4), False))


_REASONS = """, pd AS (SELECT *, CASE WHEN accession % 13 = 0 THEN NULL WHEN accession % 17 = 0 THEN 'March 3' WHEN accession % 19 = 0 THEN strftime(day + 9, '%Y-%m-%d') ELSE strftime(day - 7, '%Y-%m-%dT00:00') END AS period FROM ev),
dd AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM sessions), (SELECT max(day) FROM sessions), INTERVAL 1 DAY)) AS DATE) AS d), onx AS (SELECT d, (SELECT min(idx) FROM sessions WHERE day >= d) AS on_idx FROM dd),
se AS (SELECT pd.*, TRY_CAST(substr(period, 1, 10) AS DATE) AS event_day, on_idx - 1 AS pre_idx FROM pd LEFT JOIN onx ON d = TRY_CAST(substr(period, 1, 10) AS DATE)),
st AS (SELECT se.accession, se.period, se.event_day, se.pre_idx, se.entry_idx, pc.close AS prior_close, (a.adj_open / p.adj_close - 1) - (ba.adj_open / bp.adj_close - 1) AS pre, (x.adj_close / a.adj_open - 1) - (bx.adj_close / ba.adj_open - 1) AS post FROM se
 LEFT JOIN bars_i pc ON pc.ticker = se.ticker AND pc.idx = se.entry_idx - 1 LEFT JOIN bars_i p ON p.ticker = se.ticker AND p.idx = pre_idx AND p.adj_close > 0 LEFT JOIN bars_i a ON a.ticker = se.ticker AND a.idx = entry_idx AND a.adj_open > 0 LEFT JOIN bars_i x ON x.ticker = se.ticker AND x.idx = entry_idx + 5
 LEFT JOIN bars_i bp ON bp.ticker = 'ALL' AND bp.idx = pre_idx AND bp.adj_close > 0 LEFT JOIN bars_i ba ON ba.ticker = 'ALL' AND ba.idx = entry_idx AND ba.adj_open > 0 LEFT JOIN bars_i bx ON bx.ticker = 'ALL' AND bx.idx = entry_idx + 5)
SELECT reason, count(*) AS n FROM (SELECT CASE WHEN period IS NULL THEN 'no_event_date' WHEN event_day IS NULL THEN 'unparseable_event_date' WHEN pre_idx IS NULL OR pre_idx < 0 OR entry_idx + 5 > (SELECT max(idx) FROM sessions) THEN 'calendar_edge' WHEN pre_idx >= entry_idx THEN 'event_not_before_entry'
 WHEN prior_close IS NULL OR prior_close < 5 THEN 'no_prior_close_or_penny' WHEN pre IS NULL THEN 'missing_pre_window_price' WHEN post IS NULL THEN 'missing_post_window_price' ELSE 'kept' END AS reason FROM st) GROUP BY reason"""


@query(BASE + _REASONS)
def staleness_ledger(t):
    """The ordered reasons of events without a staleness, and those kept; the period of report is text that may be missing,
    not a date, or after entry."""
    a, day = F.col("accession"), F.col("day")
    period = F.when(a % 13 == 0, F.lit(None)).when(a % 17 == 0, "March 3").when(a % 19 == 0, F.date_format(F.date_add("day", 9), "yyyy-MM-dd")).otherwise(F.concat(F.date_format(F.date_sub("day", 7), "yyyy-MM-dd"), F.lit("T00:00")))
    return reasoned(t, t.filings().withColumn("period", period)).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def reasoned(t: Tables, events: DataFrame, after: int = 5, penny: float = 5.0) -> DataFrame:
    """events (accession, ticker, entry_idx, period) with pre, post and the first reason that leaves one out, or 'kept'."""
    b, last = t.bars_i(), t.sessions().agg(F.max("idx").alias("last_idx"))
    d = calendar.day_table(t.sessions()).select(F.col("day").alias("_d"), "on_idx")
    e = events.withColumn("event_day", F.expr("try_cast(substring(period, 1, 10) as date)"))
    e = e.join(d, e.event_day == F.col("_d"), "left").withColumn("pre_idx", F.col("on_idx") - 1).withColumn("exit_idx", F.col("entry_idx") + after).withColumn("bench", F.lit("ALL")).crossJoin(F.broadcast(last))  # one row
    known = b.select(F.col("ticker").alias("_cov")).distinct()
    prior = b.select(F.col("ticker").alias("_pt"), (F.col("idx") + 1).alias("_pi"), F.col("close").alias("prior_close"))
    e = e.join(known, e.ticker == F.col("_cov"), "left").join(prior, (F.col("ticker") == F.col("_pt")) & (F.col("entry_idx") == F.col("_pi")), "left")

    def before(df, ticker, out):
        p = b.where("adj_close > 0").select(F.col("ticker").alias("_t"), F.col("idx").alias("_i"), F.col("adj_close").alias("_a"))
        q = b.where("adj_open > 0").select(F.col("ticker").alias("_u"), F.col("idx").alias("_j"), F.col("adj_open").alias("_b"))
        df = df.join(p, (F.col(ticker) == F.col("_t")) & (F.col("pre_idx") == F.col("_i")), "left").join(q, (F.col(ticker) == F.col("_u")) & (F.col("entry_idx") == F.col("_j")), "left")
        return df.withColumn(out, F.col("_b") / F.col("_a") - 1).drop("_t", "_i", "_a", "_u", "_j", "_b")

    e = before(before(e, "ticker", "pre_s"), "bench", "pre_b")
    e = window_returns(window_returns(e, b, "ticker", "entry_idx", "exit_idx", "post_s"), b, "bench", "entry_idx", "exit_idx", "post_b")
    e = e.withColumn("pre", F.col("pre_s") - F.col("pre_b")).withColumn("post", F.col("post_s") - F.col("post_b"))
    reason = (
        F.when(F.coalesce("period", F.lit("")) == "", "no_event_date")
        .when(F.col("event_day").isNull(), "unparseable_event_date")
        .when(F.col("pre_idx").isNull() | (F.col("pre_idx") < 0) | (F.col("exit_idx") > F.col("last_idx")), "calendar_edge")
        .when(F.col("pre_idx") >= F.col("entry_idx"), "event_not_before_entry")
        .when(F.col("_cov").isNull(), "no_price_coverage_for_ticker")
        .when(F.col("prior_close").isNull() | (F.col("prior_close") < penny), "no_prior_close_or_penny")
        .when(F.col("pre").isNull(), "missing_pre_window_price")
        .when(F.col("post").isNull(), "missing_post_window_price")
        .otherwise("kept")
    )
    return e.withColumn("reason", reason)


@query(BASE + "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN accession % 11 = 0 THEN 'prediction_is_null' ELSE reason END AS reason FROM ret) WHERE reason IS NOT NULL GROUP BY reason")
def prediction_ledger(t):
    """All eight reasons of a prediction without a return; every eleventh prediction is null."""
    from ..operators.returns import event_returns

    f = t.filings().withColumn("direction", F.when(F.col("accession") % 11 != 0, F.col("direction")))
    return ledger(event_returns(f, t.bars_i(), t.sessions(), "ALL", HORIZONS), [], examples=1).select("reason", "n")


@query(BASE + "SELECT accession, horizon, round(CASE WHEN direction = 'up' THEN excess ELSE -excess END, 6) AS signed, round(CASE WHEN direction = 'up' THEN excess ELSE -excess END - 0.001, 6) AS net FROM good")
def net_returns(t):
    from ..operators.returns import net_return, signed_excess

    r = priced(t).withColumn("signed", signed_excess(F.col("direction"), F.col("excess")))
    return r.select("accession", "horizon", "signed", net_return(F.col("signed"), COST).alias("net"))


__all__ = ["buried", "nations", "peer_sums", "reasoned", "returns", "with_excess"]
