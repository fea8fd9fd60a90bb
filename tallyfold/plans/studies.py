"""The studies and table queries: each is a function of (spark, folder) to a DataFrame, with SQL for an independent engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, stats, text
from ..operators import allocation, books, calibration, clusters, intervals, novelty, ranks, sampling
from ..operators.returns import event_returns, ledger, window_returns
from .standins import BASE, EXPLORE_TO, Tables

HORIZONS, COSTS = (1, 5, 20), (0, 10, 25)
QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: stats.rounded(f(Tables(spark, sf_dir)))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def returns(t: Tables, horizons=HORIZONS) -> DataFrame:
    return event_returns(t.filings(), t.bars_i(), t.sessions(), "ALL", horizons)


def priced(t: Tables, horizons=HORIZONS) -> DataFrame:
    """Events with a return, and the month of their entry."""
    r = returns(t, horizons).where("reason is null")
    s = t.sessions().select(F.col("idx").alias("_i"), F.date_format("day", "yyyy-MM").alias("month"))
    return r.join(s, r.entry_idx == F.col("_i")).drop("_i")


# returns and their ledger


@query(BASE + "SELECT accession, horizon, entry_idx, exit_idx, round(raw, 6) AS raw, round(bench, 6) AS bench, round(excess, 6) AS excess, reason FROM (SELECT * REPLACE (CASE WHEN reason IS NULL THEN excess END AS excess) FROM ret)")
def filing_returns(t):
    return returns(t).select("accession", "horizon", "entry_idx", "exit_idx", "raw", "bench", "excess", "reason")


@query(BASE + "SELECT horizon, reason, count(*) AS n, min(accession) AS first_example FROM ret WHERE reason IS NOT NULL GROUP BY ALL")
def exclusion_ledger(t):
    return ledger(returns(t), ["horizon"], examples=1)


# books

_BOOK = """, r AS (SELECT *, row_number() OVER (PARTITION BY horizon, month ORDER BY score, accession) AS rn, count(*) OVER (PARTITION BY horizon, month) AS n FROM good),
l AS (SELECT *, CASE WHEN rn > n - n // 5 THEN 'long' WHEN rn <= n // 5 THEN 'short' END AS leg FROM r WHERE n >= 5),
m AS (SELECT horizon, month, avg(excess) FILTER (leg = 'long') AS lo, avg(-excess) FILTER (leg = 'short') AS sh FROM l WHERE leg IS NOT NULL GROUP BY ALL)
"""


@query(BASE + _BOOK + "SELECT horizon, month, round((lo - 0.001 + sh - 0.001) / 2, 6) AS book, round(lo - 0.001, 6) AS long_only FROM m")
def quintile_book(t):
    return books.monthly_book(priced(t), ["horizon", "month"], "score", "excess", "accession", 10)


@query(
    BASE + _BOOK + """, c AS (SELECT horizon, cost_bps, month, (lo + sh) / 2 - cost_bps / 10000.0 AS r FROM m, (SELECT unnest([0, 10, 25]) AS cost_bps)),
w AS (SELECT *, product(1 + r) OVER (PARTITION BY horizon, cost_bps ORDER BY month ROWS UNBOUNDED PRECEDING) AS wealth FROM c),
p AS (SELECT *, greatest(1.0, max(wealth) OVER (PARTITION BY horizon, cost_bps ORDER BY month ROWS UNBOUNDED PRECEDING)) AS peak FROM w)
SELECT horizon, cost_bps, count(r) AS n_periods, round(avg(r), 6) AS mean, round(CASE WHEN count(r) > 1 AND stddev_samp(r) > 0 THEN avg(r) / (stddev_samp(r) / sqrt(count(r))) ELSE 0 END, 6) AS t,
round(CASE WHEN count(r) > 1 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(12) ELSE 0 END, 6) AS sharpe, round(abs(least(0, min(wealth / peak - 1))), 6) AS max_drawdown,
round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM p GROUP BY horizon, cost_bps"""
)
def portfolio_grid(t):
    b = books.monthly_book(priced(t), ["horizon", "month"], "score", "excess", "accession", 0)
    c = b.withColumn("cost_bps", F.explode(F.array(*[F.lit(c) for c in COSTS]))).withColumn("r", F.col("book") - F.col("cost_bps") / 10_000.0)
    return stats.series_stats(c, ["horizon", "cost_bps"], "month", "r")


@query(
    BASE + _BOOK + """, y AS (SELECT horizon, substr(month, 1, 4) AS year, (lo + sh) / 2 AS r FROM m)
SELECT horizon, year, count(*) AS n, round(avg(r), 6) AS mean, round(CASE WHEN count(*) > 1 AND stddev_samp(r) > 0 THEN avg(r) / stddev_samp(r) * sqrt(12) ELSE 0 END, 6) AS sharpe FROM y GROUP BY ALL"""
)
def book_by_year(t):
    b = books.monthly_book(priced(t), ["horizon", "month"], "score", "excess", "accession", 0)
    sd = F.stddev_samp("book")
    return b.groupBy("horizon", F.substring("month", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"), F.avg("book").alias("mean"), F.when((F.count("book") > 1) & (sd > 0), F.avg("book") / sd * F.sqrt(F.lit(12.0))).otherwise(0.0).alias("sharpe"))


# calibration

_RIGHT = ", q AS (SELECT *, CASE WHEN direction = 'up' THEN excess ELSE -excess END > 0 AS correct FROM good)"


def judged(t):
    signed = F.when(F.col("direction") == "up", F.col("excess")).otherwise(-F.col("excess"))
    return priced(t).withColumn("correct", signed > 0)


@query(
    BASE + _RIGHT + """, b AS (SELECT h.horizon, CAST(g.bin AS INTEGER) AS bin FROM (SELECT DISTINCT horizon FROM q) h, (SELECT unnest(range(10)) AS bin) g),
x AS (SELECT horizon, CAST(least(floor(probability * 10 + 1e-9), 9) AS INTEGER) AS bin, count(*) AS n, avg(probability) AS mp, avg(CAST(correct AS INT)) AS ob FROM q GROUP BY ALL)
SELECT horizon, bin, coalesce(n, 0) AS n, round(coalesce(mp, 0), 6) AS mean_probability, round(coalesce(ob, 0), 6) AS observed, round(coalesce(ob - mp, 0), 6) AS gap FROM b LEFT JOIN x USING (horizon, bin)"""
)
def reliability_bins(t):
    return calibration.reliability(judged(t), ["horizon"], "probability", "correct")


@query(BASE + _RIGHT + "SELECT horizon, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS hit_rate, round(avg(pow(probability - CAST(correct AS INT), 2)), 6) AS brier, round(avg(probability) - avg(CAST(correct AS INT)), 6) AS overconfidence FROM q GROUP BY horizon")
def calibration_scores(t):
    return calibration.scores(judged(t), ["horizon"], "probability", "correct")


# event studies

_SUMMARY = "count(excess) AS n, round(coalesce(avg(excess), 0), 6) AS mean, round(coalesce(stddev_samp(excess), 0), 6) AS stdev, round(coalesce(median(excess), 0), 6) AS median"


@query(BASE + f"SELECT part, horizon, bucket, {_SUMMARY} FROM good GROUP BY ALL")
def event_type_stats(t):
    return stats.summarised(priced(t), ["part", "horizon", "bucket"], "excess", stats.summary("excess"))


@query(
    BASE + """, w AS (SELECT part, horizon, count(a) AS na, count(b) AS nb, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb FROM
(SELECT part, horizon, CASE WHEN bucket = 'high_impact' THEN excess END AS a, CASE WHEN bucket = 'routine' THEN excess END AS b FROM good) GROUP BY ALL),
tt AS (SELECT part, horizon, na, nb, CASE WHEN na > 1 AND nb > 1 AND va / na + vb / nb > 0 THEN (ma - mb) / sqrt(va / na + vb / nb) ELSE 0 END AS t FROM w),
k AS (SELECT *, 1 / (1 + 0.2316419 * abs(t)) AS k FROM tt)
SELECT part, horizon, na AS n_high, nb AS n_routine, round(t, 6) AS t,
round(2 * exp(-t * t / 2) / 2.5066282746310002 * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429)))), 6) AS p FROM k"""
)
def event_type_contrast(t):
    a, b = (F.when(F.col("bucket") == k, F.col("excess")) for k in ("high_impact", "routine"))
    w = priced(t).withColumn("_a", a).withColumn("_b", b).groupBy("part", "horizon").agg(F.count("_a").alias("n_high"), F.count("_b").alias("n_routine"), stats.welch(F.col("_a"), F.col("_b")).alias("t"))
    return w.withColumn("p", stats.two_sided(F.col("t")))


def staled(t, hold: int = 5):
    """Moves before and after entry, in excess: from the session before the event's day, seven days back, to the entry's open, and from there `hold` sessions on."""
    e = t.filings().withColumn("event_day", F.date_sub("day", 7))
    d = calendar.day_table(t.sessions()).select(F.col("day").alias("_d"), "on_idx")
    e = e.join(d, e.event_day == F.col("_d"), "left").withColumn("pre_idx", F.col("on_idx") - 1).drop("_d", "on_idx")
    b = t.bars_i().withColumn("one", F.lit(1))
    e = e.withColumn("bench_t", F.lit("ALL")).withColumn("exit_idx", F.col("entry_idx") + hold)

    def pre(df, ticker, out):
        p = b.select(F.col("ticker").alias("_t"), F.col("idx").alias("_i"), F.col("adj_close").alias("_a"))
        q = b.select(F.col("ticker").alias("_u"), F.col("idx").alias("_j"), F.col("adj_open").alias("_b"))
        df = df.join(p, (F.col(ticker) == F.col("_t")) & (F.col("pre_idx") == F.col("_i")), "left").join(q, (F.col(ticker) == F.col("_u")) & (F.col("entry_idx") == F.col("_j")), "left")
        return df.withColumn(out, F.when(F.col("_a") > 0, F.col("_b") / F.col("_a") - 1)).drop("_t", "_i", "_a", "_u", "_j", "_b")

    e = pre(pre(e, "ticker", "pre_s"), "bench_t", "pre_b")
    e = window_returns(window_returns(e, b, "ticker", "entry_idx", "exit_idx", "post_s"), b, "bench_t", "entry_idx", "exit_idx", "post_b")
    e = e.withColumn("pre", F.col("pre_s") - F.col("pre_b")).withColumn("post", F.col("post_s") - F.col("post_b")).where("pre is not null and post is not null and pre_idx < entry_idx")
    total = F.abs("pre") + F.abs("post")
    return e.withColumn("fraction", F.when(total > 0, F.abs("pre") / total).otherwise(0.0))


_STALE = """, dd AS (SELECT CAST(unnest(generate_series((SELECT min(day) FROM sessions), (SELECT max(day) FROM sessions), INTERVAL 1 DAY)) AS DATE) AS d),
onx AS (SELECT d, (SELECT min(idx) FROM sessions WHERE day >= d) AS on_idx FROM dd),
se AS (SELECT ev.*, on_idx - 1 AS pre_idx FROM ev JOIN onx ON d = CAST(ev.day - INTERVAL 7 DAY AS DATE)),
st AS (SELECT se.*, (a.adj_open / p.adj_close - 1) - (ba.adj_open / bp.adj_close - 1) AS pre, (x.adj_close / a.adj_open - 1) - (bx.adj_close / ba.adj_open - 1) AS post FROM se
 JOIN bars_i p ON p.ticker = se.ticker AND p.idx = pre_idx JOIN bars_i a ON a.ticker = se.ticker AND a.idx = entry_idx JOIN bars_i x ON x.ticker = se.ticker AND x.idx = entry_idx + 5
 JOIN bars_i bp ON bp.ticker = 'ALL' AND bp.idx = pre_idx JOIN bars_i ba ON ba.ticker = 'ALL' AND ba.idx = entry_idx JOIN bars_i bx ON bx.ticker = 'ALL' AND bx.idx = entry_idx + 5
 WHERE p.adj_close > 0 AND a.adj_open > 0 AND bp.adj_close > 0 AND ba.adj_open > 0 AND pre_idx < entry_idx),
fr AS (SELECT *, CASE WHEN abs(pre) + abs(post) > 0 THEN abs(pre) / (abs(pre) + abs(post)) ELSE 0 END AS fraction FROM st)
"""


@query(BASE + _STALE + "SELECT part, bucket, count(*) AS n, round(median(fraction), 6) AS median, round(avg(fraction), 6) AS mean, round(avg(CASE WHEN fraction > 0.5 THEN 1.0 ELSE 0.0 END), 6) AS share_stale FROM fr GROUP BY ALL HAVING count(*) >= 150")
def staleness(t):
    """Groups of 150 events or more."""
    s = stats.summarised(staled(t), ["part", "bucket"], "fraction", [F.count(F.lit(1)).alias("n"), ranks.middle("fraction").alias("median"), F.avg("fraction").alias("mean"), F.avg((F.col("fraction") > 0.5).cast("double")).alias("share_stale")])
    return s.where("n >= 150")


@query(
    BASE + _STALE + """, su AS (SELECT accession, pre AS surprise, post, strftime(s.day, '%Y-%m') AS month FROM (SELECT * EXCLUDE (day) FROM fr WHERE bucket = 'earnings') f JOIN sessions s ON s.idx = entry_idx),
r AS (SELECT *, row_number() OVER (PARTITION BY month ORDER BY surprise, accession) AS rn, count(*) OVER (PARTITION BY month) AS n FROM su),
l AS (SELECT *, CASE WHEN rn > n - n // 5 THEN 'long' WHEN rn <= n // 5 THEN 'short' END AS leg FROM r WHERE n >= 5)
SELECT month, round((avg(post) FILTER (leg = 'long') - 0.001 + avg(-post) FILTER (leg = 'short') - 0.001) / 2, 6) AS book, round(avg(post) FILTER (leg = 'long') - 0.001, 6) AS long_only FROM l WHERE leg IS NOT NULL GROUP BY month"""
)
def earnings_drift(t):
    """Long the largest surprises (moves before entry), short the smallest."""
    s = t.sessions().select(F.col("idx").alias("_i"), F.date_format("day", "yyyy-MM").alias("month"))
    e = staled(t).where("bucket = 'earnings'").join(s, F.col("entry_idx") == F.col("_i"))
    return books.monthly_book(e, ["month"], "pre", "post", "accession", 10)


# timing

_TIMED = """, fe AS (SELECT event_id, event_type, ts - INTERVAL 25 YEAR AS at, CAST(ts - INTERVAL 25 YEAR AS DATE) AS d, hour(ts) >= 16 AS late FROM events),
nx AS (SELECT fe.*, (SELECT min(day) FROM sessions WHERE day > d) AS nd, d IN (SELECT day FROM sessions) AS is_s FROM fe),
tb AS (SELECT *, CASE WHEN isodow(d) >= 6 OR (isodow(d) = 5 AND late) THEN 'weekend'
 WHEN (late OR NOT is_s) AND list_bool_or([isodow(x) <= 5 FOR x IN generate_series(CAST(d AS TIMESTAMP) + INTERVAL 1 DAY, CAST(nd AS TIMESTAMP) - INTERVAL 1 DAY, INTERVAL 1 DAY)]) THEN 'preholiday' ELSE 'control' END AS bucket FROM nx)
"""


def timed(t):
    e = t.raw("events").select("event_id", "event_type", F.expr("cast(ts as timestamp) - make_interval(25)").alias("accepted_at"))
    return calendar.acceptance_bucket(e, t.sessions(), "accepted_at", "UTC")


@query(BASE + _TIMED + "SELECT bucket, late AS after_hours, event_type, count(*) AS n FROM tb GROUP BY ALL")
def timing_buckets(t):
    return timed(t).groupBy("bucket", "after_hours", "event_type").agg(F.count(F.lit(1)).alias("n"))


@query(BASE + _TIMED + "SELECT g, count(*) AS n FROM (SELECT unnest(CASE WHEN bucket = 'control' AND late THEN ['control', 'control_after_hours'] ELSE [bucket] END) AS g FROM tb) GROUP BY g")
def timing_groups(t):
    """The overlapping group counts its rows twice."""
    both = F.when((F.col("bucket") == "control") & F.col("after_hours"), F.array(F.lit("control"), F.lit("control_after_hours"))).otherwise(F.array("bucket"))
    return timed(t).select(F.explode(both).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("n"))


@query(
    BASE + """, fe AS (SELECT event_id, ts - INTERVAL 25 YEAR AS ta FROM events), x AS (SELECT *, CAST(ta AS DATE) AS d FROM fe),
y AS (SELECT *, (SELECT min(idx) FROM sessions WHERE day > d) AS nx, d IN (SELECT day FROM sessions) AS is_s FROM x)
SELECT event_id, CASE WHEN is_s AND hour(ta) < 16 THEN nx ELSE nx + 1 END AS entry_idx FROM y"""
)
def entry_sessions(t):
    e = t.raw("events").select("event_id", F.expr("cast(ts as timestamp) - make_interval(25)").alias("accepted_at"))
    return calendar.entry_index(e, t.sessions(), "accepted_at", "UTC").select("event_id", "entry_idx")


# clusters

_TRAIL = """WITH p AS (SELECT c_nationkey AS ticker, CAST(o_orderdate AS DATE) AS day, o_orderkey AS row_no, o_custkey AS owner, o_totalprice AS value FROM orders JOIN customer ON o_custkey = c_custkey),
tr AS (SELECT a.ticker, a.day, a.row_no, count(DISTINCT b.owner) AS n_owners, sum(b.value) AS total_value FROM p a JOIN p b ON a.ticker = b.ticker AND b.day >= a.day - 30 AND (b.day < a.day OR (b.day = a.day AND b.row_no <= a.row_no)) GROUP BY ALL)
"""


@query(_TRAIL + "SELECT ticker, day, row_no, n_owners, round(total_value, 6) AS total_value FROM tr")
def trailing_windows(t):
    return clusters.trailing(t.purchases())


_CLUSTERS_SQL = (
    _TRAIL.replace("WITH p", "WITH RECURSIVE p") + """, cand AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY day, row_no) AS rn FROM tr WHERE n_owners >= 3 AND total_value >= 500000),
f AS (SELECT ticker, rn, day, row_no, n_owners, total_value, true AS fires, day AS last FROM cand WHERE rn = 1 UNION ALL
 SELECT c.ticker, c.rn, c.day, c.row_no, c.n_owners, c.total_value, c.day - f.last >= 30, CASE WHEN c.day - f.last >= 30 THEN c.day ELSE f.last END FROM f JOIN cand c ON c.ticker = f.ticker AND c.rn = f.rn + 1)
SELECT ticker, day, row_no, n_owners, round(total_value, 6) AS total_value FROM f WHERE fires"""
)


@query(_CLUSTERS_SQL)
def purchase_clusters(t):
    return clusters.cluster_events(t.purchases(), 3, 500_000.0)


@query(_TRAIL + ", y AS (SELECT owner, month(day) AS m FROM p GROUP BY ALL HAVING count(DISTINCT year(day)) >= 2) SELECT count(*) AS n, round(sum(value), 2) AS value FROM p WHERE NOT EXISTS (SELECT 1 FROM y WHERE y.owner = p.owner AND y.m = month(p.day))")
def opportunistic_total(t):
    o = clusters.opportunistic(t.purchases(), 2).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
    return o.select("n", F.round("value", 2).alias("value"))


@query(
    BASE + """, u AS (SELECT accession, ticker, entry_idx FROM ev WHERE bucket = 'high_impact'), xs AS (SELECT u.*, entry_idx + k AS i FROM u, (SELECT unnest(range(1, 6)) AS k)),
dr AS (SELECT accession, i, (b.adj_close / a.adj_close - 1) - (bb.adj_close / ba.adj_close - 1) AS r FROM xs JOIN bars_i b ON b.ticker = xs.ticker AND b.idx = i JOIN bars_i a ON a.ticker = xs.ticker AND a.idx = i - 1
 JOIN bars_i bb ON bb.ticker = 'ALL' AND bb.idx = i JOIN bars_i ba ON ba.ticker = 'ALL' AND ba.idx = i - 1),
ch AS (SELECT i, r - CASE WHEN row_number() OVER (PARTITION BY accession ORDER BY i) = 1 THEN 0.001 ELSE 0 END AS r FROM dr), da AS (SELECT i, avg(r) AS r FROM ch GROUP BY i)
SELECT count(*) AS n_days, round(avg(r), 6) AS mean, round(avg(r) / stddev_samp(r) * sqrt(252), 6) AS sharpe FROM da"""
)
def overlapping_daily_book(t):
    """Close to close in excess, each event held five sessions, its cost charged on the first that is priced."""
    b = t.bars_i().select("ticker", "idx", "adj_close")

    def daily(df, ticker, out):
        p, q = (b.select(F.col("ticker").alias(f"_t{k}"), F.col("idx").alias(f"_i{k}"), F.col("adj_close").alias(f"_p{k}")) for k in (0, 1))
        df = df.join(p, (F.col(ticker) == F.col("_t0")) & (F.col("i") == F.col("_i0"))).join(q, (F.col(ticker) == F.col("_t1")) & (F.col("i") - 1 == F.col("_i1")))
        return df.withColumn(out, F.col("_p0") / F.col("_p1") - 1).drop("_t0", "_i0", "_p0", "_t1", "_i1", "_p1")

    e = t.filings().where("bucket = 'high_impact'").select("accession", "ticker", F.lit("ALL").alias("bench"), F.explode(F.sequence(F.col("entry_idx") + 1, F.col("entry_idx") + 5)).alias("i"))
    d = daily(daily(e, "ticker", "s"), "bench", "m")
    first = F.row_number().over(Window.partitionBy("accession").orderBy("i")) == 1
    d = d.withColumn("r", F.col("s") - F.col("m") - F.when(first, 0.001).otherwise(0.0)).groupBy("i").agg(F.avg("r").alias("r"))
    return d.agg(F.count(F.lit(1)).alias("n_days"), F.avg("r").alias("mean"), (F.avg("r") / F.stddev_samp("r") * F.sqrt(F.lit(252.0))).alias("sharpe"))


# diffusion, momentum, trend


@query(
    BASE + """, ind AS (SELECT DISTINCT ticker, length(ticker) % 2 AS g FROM ev), fr AS (SELECT ev.accession, ev.ticker, entry_idx, part, (a.adj_close / p.adj_close - 1) - (ba.adj_close / bp.adj_close - 1) AS reaction FROM ev
 JOIN bars_i a ON a.ticker = ev.ticker AND a.idx = entry_idx JOIN bars_i p ON p.ticker = ev.ticker AND p.idx = entry_idx - 1 JOIN bars_i ba ON ba.ticker = 'ALL' AND ba.idx = entry_idx JOIN bars_i bp ON bp.ticker = 'ALL' AND bp.idx = entry_idx - 1 WHERE bucket = 'earnings'),
pr AS (SELECT fr.*, j.ticker AS peer FROM fr JOIN ind i ON i.ticker = fr.ticker JOIN ind j ON j.g = i.g AND j.ticker <> fr.ticker WHERE reaction <> 0),
px AS (SELECT part, accession, sign(reaction) * ((b.adj_close / a.adj_open - 1) - (bb.adj_close / ba.adj_open - 1)) AS x FROM pr JOIN bars_i a ON a.ticker = peer AND a.idx = entry_idx + 1 JOIN bars_i b ON b.ticker = peer AND b.idx = entry_idx + 6
 JOIN bars_i ba ON ba.ticker = 'ALL' AND ba.idx = entry_idx + 1 JOIN bars_i bb ON bb.ticker = 'ALL' AND bb.idx = entry_idx + 6 WHERE a.adj_open > 0 AND ba.adj_open > 0)
SELECT part, count(*) AS n_pairs, count(DISTINCT accession) AS n_events, round(avg(x), 6) AS mean FROM px GROUP BY part"""
)
def peer_diffusion(t):
    """Peers' excess five sessions from the session after the filer's entry, signed by the filer's reaction (adjusted prices on both sides)."""
    b = t.bars_i()
    e = t.filings().where("bucket = 'earnings'").withColumn("bench", F.lit("ALL")).withColumn("prior", F.col("entry_idx") - 1)
    e = window_returns(e, b, "ticker", "prior", "entry_idx", "rs", "adj_close")
    e = window_returns(e, b, "bench", "prior", "entry_idx", "rb", "adj_close").withColumn("reaction", F.col("rs") - F.col("rb")).where("reaction <> 0")
    ind = t.filings().select("ticker").distinct().withColumn("sic3", F.length("ticker") % 2)
    p = intervals.peers(e, ind, ind.select("ticker", F.lit("1957-03-04").cast("date").alias("start_date"), F.lit(None).cast("date").alias("end_date")))
    p = p.withColumn("p_in", F.col("entry_idx") + 1).withColumn("p_out", F.col("entry_idx") + 6)
    p = window_returns(window_returns(p, b, "peer", "p_in", "p_out", "ps"), b, "bench", "p_in", "p_out", "pb").where("ps is not null and pb is not null")
    x = F.signum("reaction") * (F.col("ps") - F.col("pb"))
    return p.groupBy("part").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_distinct("accession").alias("n_events"), F.avg(x).alias("mean"))


_ENDS = ", ends AS (SELECT day, idx FROM (SELECT *, lead(day) OVER (ORDER BY idx) AS nd FROM sessions) WHERE date_trunc('month', nd) > date_trunc('month', day))"


@query(BASE + _ENDS + "SELECT a.ticker, e.idx, e.day, round(a.adj_close / b.adj_close - 1, 6) AS momentum FROM ends e JOIN bars_i a ON a.idx = e.idx - 5 JOIN bars_i b ON b.ticker = a.ticker AND b.idx = e.idx - 60 WHERE e.idx >= 60 AND e.idx + 7 < (SELECT count(*) FROM sessions) AND b.adj_close > 0")
def momentum(t):
    return allocation.momentum(t.bars_i(), t.sessions(), 60, 5, 5)


@query(
    BASE + _ENDS + """, en AS (SELECT idx, lead(idx) OVER (ORDER BY idx) AS nx, lead(day) OVER (ORDER BY idx) AS month FROM ends), sl AS (SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS sleeve),
g AS (SELECT en.*, sleeve, CASE WHEN t.adj_close > 0 AND n.adj_close / t.adj_close - 1 > 0 THEN sleeve ELSE 'ALL' END AS held FROM en CROSS JOIN sl LEFT JOIN bars_i n ON n.ticker = sleeve AND n.idx = en.idx LEFT JOIN bars_i t ON t.ticker = sleeve AND t.idx = en.idx - 60 WHERE nx IS NOT NULL AND en.idx >= 60),
h AS (SELECT g.*, b.adj_close / a.adj_close - 1 AS r, count(b.adj_close / a.adj_close - 1) OVER (PARTITION BY month) AS k FROM g LEFT JOIN bars_i a ON a.ticker = held AND a.idx = g.idx AND a.adj_close > 0 LEFT JOIN bars_i b ON b.ticker = held AND b.idx = nx),
c AS (SELECT *, CASE WHEN held IS DISTINCT FROM lag(held) OVER (PARTITION BY sleeve ORDER BY month) THEN 1 ELSE 0 END AS ch FROM h WHERE k = 5)
SELECT month, sum(ch)::BIGINT AS n_changed, round(avg(r) - sum(ch) / 5.0 * 2 * 10 / 10000.0, 6) AS ret FROM c GROUP BY month"""
)
def trend_allocation(t):
    return allocation.trend(t.bars_i(), t.sessions(), ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"], "ALL", 60)


# text

_TOKENS = "list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda t: NOT list_contains([" + ", ".join(f"'{w}'" for w in novelty.STOPWORDS) + "], t))"


_WHOLE_CHANGE = f"""d AS (SELECT doc_id, source, {_TOKENS} AS ts FROM documents), h AS (SELECT * FROM d WHERE doc_id <= (SELECT max(doc_id) / 2 FROM documents)),
df AS (SELECT token, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest(ts) AS token FROM h) GROUP BY token),
v AS (SELECT token, ln((SELECT count(*) FROM h)::DOUBLE / df) AS idf FROM df WHERE df >= 5 AND df <= floor(0.5 * (SELECT count(*) FROM h)) ORDER BY df DESC, token LIMIT 50000),
l AS (SELECT doc_id, len(ts) AS n, unnest(ts) AS token FROM d), c AS (SELECT doc_id, token, count(*)::DOUBLE / n * idf AS w FROM l JOIN v USING (token) GROUP BY doc_id, n, token, idf),
nn AS (SELECT doc_id, sqrt(sum(w * w)) AS l FROM c GROUP BY doc_id), u AS (SELECT doc_id, token, w / l AS w FROM c JOIN nn USING (doc_id) WHERE l > 0),
pr AS (SELECT doc_id, lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id) AS prev FROM d),
dt AS (SELECT pr.doc_id, sum(a.w * b.w) AS dot FROM pr JOIN u a ON a.doc_id = pr.doc_id JOIN u b ON b.doc_id = pr.prev AND b.token = a.token GROUP BY pr.doc_id),
ch AS (SELECT pr.doc_id, prev, 1 - coalesce(dot, 0) AS change FROM pr LEFT JOIN dt USING (doc_id) WHERE prev IS NOT NULL)
"""
#: The change as novelty_book defines it, by the first CHARS characters of a text.
CHARS = 20_000
_CHANGE = _WHOLE_CHANGE.replace("lower(text)", f"substr(lower(text), 1, {CHARS})")


def changed(t, chars: int | None = None) -> DataFrame:
    """Change of every document against the one before it of its source, by whole texts or by their first `chars` characters; the
    vocabulary is that of the first half."""
    d = t.raw("documents").select("doc_id", "source", "text")
    half = F.broadcast(d.agg((F.max("doc_id") / 2).alias("half")))  # one row
    counted = novelty.terms(d.where("text is not null"), "doc_id", "text", chars)
    early = lambda df: df.crossJoin(half).where("doc_id <= half")
    vocab = novelty.vocabulary(early(counted), early(d).agg(F.count(F.lit(1))))
    return novelty.change(d, "doc_id", "text", ["source"], "doc_id", counted, vocab)


@query("WITH " + _WHOLE_CHANGE + "SELECT doc_id, prev, round(change, 6) AS change FROM ch")
def novelty_change(t):
    return changed(t)


POSITIVE, NEGATIVE = ["GOOD", "GREAT", "GAIN", "WITH", "FOR"], ["BAD", "LOSS", "WEAK", "WAS", "BY"]
_LEX = "WITH d AS (SELECT doc_id, list_transform(regexp_extract_all(regexp_replace(text, '\\[[A-Z]+\\]', ' ', 'g'), '[A-Za-z]+'), lambda x: upper(x)) AS w FROM documents), s AS (SELECT doc_id, len(w) AS n_words, len(list_filter(w, lambda x: list_contains(['GOOD', 'GREAT', 'GAIN', 'WITH', 'FOR'], x))) AS p, len(list_filter(w, lambda x: list_contains(['BAD', 'LOSS', 'WEAK', 'WAS', 'BY'], x))) AS n FROM d) "


@query(_LEX + "SELECT doc_id, CAST(n_words AS INTEGER) AS n_words, CAST(p AS INTEGER) AS n_positive, CAST(n AS INTEGER) AS n_negative, round(CASE WHEN n_words > 0 THEN (p - n) / n_words ELSE 0 END, 6) AS score, CASE WHEN p > n THEN 'up' ELSE 'down' END AS direction, round(0.5 + 0.5 * least(abs(CASE WHEN n_words > 0 THEN (p - n) / n_words ELSE 0 END) / 0.02, 1), 6) AS probability FROM s")
def lexicon_scores(t):
    s = t.raw("documents").select("doc_id", text.lexicon_score(text.lexicon_tokens(F.col("text")), POSITIVE, NEGATIVE).alias("s")).select("doc_id", "s.*")
    return s.withColumn("direction", F.when(F.col("score") > 0, "up").otherwise("down")).withColumn("probability", text.score_to_probability(F.col("score")))


@query()
def redacted_documents(t):
    r = t.raw("documents").select("doc_id", text.redaction(F.col("text")).alias("r")).select("doc_id", "r.*")
    counts = F.array_sort(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))))
    return r.select("doc_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), F.array_join(counts, ",").alias("counts"), F.array_join(text.find_leaks(F.col("text")), "|").alias("leaks"))


@query("SELECT doc_id, len(regexp_extract_all(text, '\\b\\d{2}-\\d{7}\\b')) AS irs, len(regexp_extract_all(text, '\\b(?:19|20)\\d{2}-\\d{2}-\\d{2}\\b')) AS iso_date FROM documents")
def redaction_tallies(t):
    """Numbers and dates in the texts as given, before any step."""
    patterns = {n: "(?U)" + p for n, p, _ in text.REDACTIONS}
    return t.raw("documents").select("doc_id", F.regexp_count("text", F.lit(patterns["irs_number"])).cast("long").alias("irs"), F.regexp_count("text", F.lit(r"(?U)\b(?:19|20)\d{2}-\d{2}-\d{2}\b")).cast("long").alias("iso_date"))


_NAMED = "WITH n AS (SELECT c_custkey, c_name, 'Acme_' || c_custkey || '/North & Sons Holdings' AS name FROM customer) "


@query(
    _NAMED + """SELECT c_custkey, CAST(3 AS INTEGER) AS company_name, CAST(1 AS INTEGER) AS url, CAST(NULL AS INTEGER) AS date_iso, CAST(1 AS INTEGER) AS date_numeric,
'[COMPANY] rose. [COMPANY], as [COMPANY] said on [DATE]: [ID] is what we saw.' AS redacted FROM n"""
)
def redacted_names(t):
    """Counts of what each step replaced in texts that name their company in full and in part: the date inside the address
    belongs to the address. The second name is followed by a mark that ends the first step's address. A small file of rows that
    cost much is dealt out first, or a task or two would have them all."""
    k = F.col("c_custkey").cast("string")
    name = F.concat(F.lit("Acme_"), k, F.lit("/North & Sons Holdings"))
    said = F.concat(name, F.lit(" rose. Acme_"), k, F.lit("/North & Sons, as ACME_"), k, F.lit("/NORTH said on 1/5/2018: https://x.example/2018-01-05/Acme_"), k, F.lit(" is what we saw."))
    dealt = t.raw("customer").select("c_custkey").repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), "c_custkey")
    r = dealt.select("c_custkey", text.redaction(said, text.name_variants(name)).alias("r"))
    return r.select("c_custkey", *[F.col("r.counts")[c].alias(c) for c in ("company_name", "url", "date_iso", "date_numeric")], F.col("r.text").alias("redacted"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY ALL")
def json_fields(t):
    return t.raw("events").groupBy("event_type", F.from_json("props", "k int")["k"].alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT event_id, CASE WHEN value >= 0 AND event_id % 3 <> 0 THEN 'up' END AS direction, CASE WHEN value >= 0 AND event_id % 3 <> 0 THEN CAST(0.75 AS DOUBLE) END AS probability FROM events")
def parsed_answers(t):
    """Answers made of events: fenced, with prose around, and for every third a probability out of range."""
    p = F.when(F.col("event_id") % 3 == 0, "0.25").otherwise("0.75")
    d = F.when(F.col("value") >= 0, "up").otherwise("sideways")
    raw = F.concat(F.lit('Sure. ```json\n{"direction": "'), d, F.lit('", "probability": '), p, F.lit(', "rationale": "because"}\n``` done'))
    return t.raw("events").select("event_id", text.parse_answer(raw).alias("a")).select("event_id", F.col("a.direction").alias("direction"), F.col("a.probability").alias("probability"))


@query("SELECT c_custkey, regexp_replace(regexp_replace(upper(c_name), '\\b(?:INC|CORP|CORPORATION|COMPANY|CO|LTD|LIMITED|PLC|LP|LLC|HOLDINGS?|GROUP|INTERNATIONAL|THE|NEW|CLASS\\s+[A-C]|COM|SA|NV|AG)\\b', ' ', 'g'), '[^A-Z0-9]', '', 'g') AS name_key FROM customer")
def company_keys(t):
    return t.raw("customer").select("c_custkey", text.normalise_company(F.col("c_name")).alias("name_key"))


@query(
    """WITH w AS (SELECT item_id, list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) >= 8)) AS ws FROM benchmark),
t AS (SELECT item_id, unnest(ws) AS token FROM w), d AS (SELECT DISTINCT doc_id, unnest(list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda x: length(x) >= 8)) AS token FROM documents)
SELECT item_id, count(DISTINCT doc_id) AS n_docs FROM t JOIN d USING (token) GROUP BY item_id"""
)
def identified_items(t):
    """Documents that share a distinctive token, of eight characters or more, with an item."""
    long = lambda c: F.filter(text.distinctive_tokens(F.col(c)), lambda w: F.length(w) >= 8)
    a = t.raw("benchmark").select("item_id", F.explode(long("text")).alias("token"))
    b = t.raw("documents").select("doc_id", F.explode(long("text")).alias("token"))
    return a.join(b, "token").groupBy("item_id").agg(F.count_distinct("doc_id").alias("n_docs"))


# intervals, keys and sets

_UNI = "WITH u AS (SELECT c_nationkey AS nation, o_custkey AS ticker, min(CAST(o_orderdate AS DATE)) AS start_date, CASE WHEN o_custkey % 2 = 1 THEN max(CAST(o_orderdate AS DATE)) END AS end_date FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey, o_custkey) "


@query(_UNI + "SELECT y::INTEGER AS year, (SELECT count(*) FROM u WHERE start_date <= make_date(y, 6, 30) AND (end_date IS NULL OR end_date > make_date(y, 6, 30))) AS n_members FROM (SELECT unnest(range(1995, 2002)) AS y)")
def membership_health(t):
    return intervals.health(t.universe(), 1995, 2001)


@query(_UNI + "SELECT nation, ticker FROM u WHERE start_date <= DATE '1998-03-15' AND (end_date IS NULL OR end_date > DATE '1998-03-15')")
def members_on_day(t):
    return t.universe().where(intervals.member_on(F.lit("1998-03-15").cast("date"), F.col("start_date"), F.col("end_date"))).select("nation", "ticker")


@query(_UNI + "SELECT DISTINCT nation FROM u WHERE start_date <= DATE '1996-01-10' AND (end_date IS NULL OR end_date > DATE '1995-12-01') AND ticker % 2 = 1")
def overlapping_members(t):
    d = lambda s: F.lit(s).cast("date")
    return t.universe().where(intervals.overlaps(d("1995-12-01"), d("1996-01-10"), F.col("start_date"), F.col("end_date")) & (F.col("ticker") % 2 == 1)).select("nation").distinct()


@query(
    _UNI + """, b AS (SELECT o_custkey AS ticker, min(CAST(o_orderdate AS DATE)) AS f, max(CAST(o_orderdate AS DATE)) AS l FROM orders WHERE year(o_orderdate) BETWEEN 1996 AND 1998 GROUP BY o_custkey)
SELECT u.ticker, f AS first_bar, l AS last_bar, coalesce(f <= greatest(start_date, DATE '1996-01-01') + 21 AND l >= least(coalesce(end_date, DATE '9999-12-31'), DATE '1998-12-31') - 21, false) AS covered
FROM u LEFT JOIN b USING (ticker) WHERE start_date <= DATE '1998-12-31' AND (end_date IS NULL OR end_date > DATE '1996-01-01')"""
)
def price_coverage(t):
    bars = t.orders().where(F.year("day").between(1996, 1998)).select(F.col("o_custkey").alias("ticker"), "day")
    return intervals.coverage(t.universe(), bars, "1996-01-01", "1998-12-31")


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) = 1")
def first_by_key(t):
    return intervals.first_by(t.raw("lineitem"), ["l_orderkey"], "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("SELECT user_id, event_type, event_id, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(t):
    e = t.raw("events")
    return intervals.first_by(e, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unscored_keys(t):
    """Customers without a filled order."""
    return intervals.append_new(t.raw("customer").select("c_custkey"), t.raw("orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT 'wanted_not_have' AS op, count(*) AS n FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'both', count(*) FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier)")
def set_operations(t):
    a, b = t.raw("customer").select(F.col("c_nationkey").alias("k")), t.raw("supplier").select(F.col("s_nationkey").alias("k"))
    n = lambda op, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(op).alias("op"), "n")
    return n("wanted_not_have", a.subtract(b)).unionByName(n("both", a.intersect(b))).unionByName(n("either", a.union(b).distinct()))


# rollups


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(DISTINCT o_custkey) AS n_tickers FROM orders GROUP BY 1")
def monthly_rollup(t):
    return t.raw("orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_tickers"))


@query("SELECT year(o_orderdate)::INTEGER AS year, count(*) AS n, count(DISTINCT o_custkey) AS n_tickers, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders GROUP BY 1")
def yearly_rollup(t):
    o = t.raw("orders")
    return o.groupBy(F.year("o_orderdate").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("n_tickers"), F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"))


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 200")
def latest_predictions(t):
    """The report's 200 rows."""
    o, c = t.raw("orders"), t.raw("customer")
    return o.where("o_orderstatus = 'O'").join(c, o.o_custkey == c.c_custkey).orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200).select("o_orderkey", "c_name", "o_totalprice")


@query(" UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM {n}" for n in ("orders", "lineitem", "customer", "events", "documents")))
def table_counts(t):
    out = None
    for n in ("orders", "lineitem", "customer", "events", "documents"):
        c = t.raw(n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("name"), "n")
        out = c if out is None else out.unionByName(c)
    return out


_STRATA = """WITH n AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n_rows FROM orders GROUP BY ALL), s AS (SELECT *, least(n_rows * 100 / (SELECT sum(n_rows) FROM n), n_rows) AS sh FROM n), b AS (SELECT *, floor(sh) AS ba FROM s),
r AS (SELECT *, row_number() OVER (ORDER BY ba - sh, o_orderpriority, o_orderstatus) AS rn, 100 - sum(ba) OVER () AS short FROM b), a AS (SELECT o_orderpriority, o_orderstatus, CAST(ba + CASE WHEN rn <= short THEN 1 ELSE 0 END AS BIGINT) AS n_take FROM r)
"""


@query(_STRATA + "SELECT o_orderkey, o_orderpriority, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus ORDER BY md5(o_orderkey || '-20260727'), o_orderkey) AS rn FROM orders) o JOIN a USING (o_orderpriority, o_orderstatus) WHERE rn <= n_take")
def stratified_sample(t):
    """A sampling operator: 100 rows over the strata."""
    return sampling.stratified(t.raw("orders"), ["o_orderpriority", "o_orderstatus"], "o_orderkey", 100).select("o_orderkey", "o_orderpriority", "o_orderstatus")
