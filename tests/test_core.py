"""Golden cases and traps of the event-study operators."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tallyfold import schema
from tallyfold.functions import calendar, html, stats, text
from tallyfold.operators import allocation, books, calibration, clusters, intervals, sampling
from tallyfold.operators.returns import event_returns, ledger, on_index
from tallyfold.sources import readers, sinks
from tallyfold.streaming import live

D = dt.date


@pytest.fixture(scope="module")
def sessions(spark):
    return calendar.exchange_sessions(spark, 2017, 2020)


def test_calendar(sessions):
    days = [r.day for r in sessions.orderBy("idx").collect()]
    assert sum(d.year == 2018 for d in days) == 251
    assert D(2018, 12, 5) not in days and D(2018, 3, 30) not in days and D(2018, 11, 22) not in days
    ends = {r.day for r in calendar.month_ends(sessions).collect()}
    assert D(2018, 3, 29) in ends and max(days) not in ends


def test_entry_rule(spark, sessions):
    # (UTC instant, entry): before, at and after the cutoff in New York, Friday night, weekend, the day before Thanksgiving
    cases = [
        ("2018-02-05 20:59:00", D(2018, 2, 6)), ("2018-02-05 21:00:00", D(2018, 2, 7)), ("2018-02-05 21:01:00", D(2018, 2, 7)), ("2018-02-09 21:01:00", D(2018, 2, 13)),
        ("2018-02-10 15:00:00", D(2018, 2, 13)), ("2018-02-11 15:00:00", D(2018, 2, 13)), ("2018-11-21 21:01:00", D(2018, 11, 26)), ("2018-07-05 19:59:00", D(2018, 7, 6)), ("2018-07-05 20:00:00", D(2018, 7, 9)),
    ]
    df = spark.createDataFrame(cases, "at string, want date").withColumn("at", F.col("at").cast("timestamp"))
    got = calendar.shifted(calendar.entry_index(df, sessions, "at"), sessions, F.col("entry_idx"), "entry").collect()
    assert len(got) == len(cases) and all(r.entry == r.want for r in got)


def test_buckets(spark, sessions):
    cases = [("2018-02-09 21:00:00", "weekend"), ("2018-02-10 15:00:00", "weekend"), ("2018-11-21 21:01:00", "preholiday"), ("2018-02-06 22:00:00", "control"), ("2018-02-06 15:00:00", "control")]
    df = spark.createDataFrame(cases, "at string, want string").withColumn("at", F.col("at").cast("timestamp"))
    assert all(r.bucket == r.want for r in calendar.acceptance_bucket(df, sessions, "at").collect())


def test_dates(spark):
    r = spark.createDataFrame([("on March 5, 2018 and", "05-JAN-2018", "2019-12-31 23:30:00")], "a string, b string, c string").select(
        calendar.long_date(F.col("a")).alias("a"), calendar.insider_date(F.col("b")).alias("b"), calendar.partition_of(F.col("c").cast("timestamp")).alias("c")
    ).first()
    assert (r.a, r.b, r.c) == (D(2018, 3, 5), D(2018, 1, 5), "explore")


def test_returns_and_reasons(spark):
    s = spark.createDataFrame([(D(2018, 1, 1 + i), i) for i in range(8)], "day date, idx int")
    bar = lambda t, i, o, c, a=None: (t, D(2018, 1, 1 + i), float(o), float(c), a)
    rows = [bar("B", i, 100, 100) for i in range(8)] + [bar("A", i, 10, 10) for i in range(8)] + [bar("P", i, 4, 4) for i in range(8)] + [bar("G", 0, 9, 9), bar("G", 2, 9, 9), bar("G", 3, 9, 9)]
    rows += [bar("S", 0, 6, 6), bar("S", 1, 10, 15, 14.0), bar("S", 3, 20, 19, 19.0)]
    b = on_index(spark.createDataFrame(rows, "ticker string, day date, open double, close double, adj_close double"), s)
    ev = spark.createDataFrame([(1, "A", 1), (2, "P", 1), (3, "G", 2), (4, "Z", 1), (5, "A", 6), (6, "S", 1), (7, "G", 1), (8, "G", 3)], "accession long, ticker string, entry_idx int")
    got = {r.accession: r for r in event_returns(ev, b, s, "B", (2,)).collect()}
    want = {1: None, 2: "prior_close_below_5_usd", 3: "no_prior_close", 4: "no_price_coverage_for_ticker", 5: "exit_beyond_calendar", 6: None, 7: "security_did_not_trade_on_entry", 8: "missing_price_in_window"}
    assert {k: r.reason for k, r in got.items()} == want
    assert got[6].raw == pytest.approx(19.0 / (10.0 * 14 / 15) - 1)  # the open is adjusted by the same factor as the close
    assert sum(r.n for r in ledger(event_returns(ev, b, s, "B", (2,)), ["horizon"]).collect()) == 6


def test_quintiles_are_not_ntiles(spark):
    rows = [("m", i, float(i // 2), 1.0) for i in range(13)] + [("few", i, 1.0, 1.0) for i in range(4)]
    got = books.legs(spark.createDataFrame(rows, "month string, acc long, score double, ret double"), ["month"], "score", "acc").collect()
    assert sorted(r.acc for r in got if r.leg == "short") == [0, 1] and sorted(r.acc for r in got if r.leg == "long") == [11, 12]
    assert {r.month for r in got} == {"m"}


def test_drawdown_and_conventions(spark):
    df = spark.createDataFrame([("a", 1, 0.5), ("a", 2, -0.5), ("b", 1, 0.1)], "k string, o int, r double")
    got = {r.k: r for r in stats.series_stats(df, ["k"], "o", "r").collect()}
    assert got["a"].max_drawdown == pytest.approx(0.5) and got["b"].sharpe == 0 and got["b"].t == 0
    one = spark.range(1).select(stats.normal_cdf(F.lit(1.96)).alias("p"), stats.normal_cdf(F.lit(-1.0)).alias("q")).first()
    assert one.p == pytest.approx(0.9750021, abs=1e-6) and one.q == pytest.approx(0.1586553, abs=1e-6)
    assert stats.summarised(df.where("false"), [], "r", stats.summary("r")).first().asDict() == {"n": 0, "mean": 0.0, "stdev": 0.0, "median": 0.0}


def test_empty_bins_are_there(spark):
    df = spark.createDataFrame([("x", 0.5, True), ("x", 1.0, False), ("x", 0.95, True)], "k string, p double, y boolean")
    got = {r.bin: r.n for r in calibration.reliability(df, ["k"], "p", "y").collect()}
    assert got == {**dict.fromkeys(range(10), 0), 5: 1, 9: 2}


def test_interval_edges(spark):
    r = spark.range(1).select(*[intervals.member_on(F.lit(d).cast("date"), F.lit("2014-01-01").cast("date"), F.lit("2018-01-01").cast("date"), inc).alias(n) for d, inc, n in (("2018-01-01", False, "a"), ("2017-12-31", False, "b"), ("2018-01-01", True, "c"))]).first()
    assert (r.a, r.b, r.c) == (False, True, True)


def test_reconstruction(spark):
    now = spark.createDataFrame([("A",), ("B",)], "ticker string")
    ch = spark.createDataFrame([(D(2010, 1, 1), "B", "C"), (D(2005, 1, 1), "C", "B"), (D(2012, 1, 1), "D", None), (D(2013, 1, 1), None, "D"), (D(2014, 1, 1), "E", "E")], "day date, added string, removed string")
    got = {(r.ticker, r.start_date, r.end_date) for r in intervals.reconstruct(now, ch).collect() if r.ticker != "E"}
    o = D(1957, 3, 4)
    assert got == {("A", o, None), ("B", o, D(2005, 1, 1)), ("B", D(2010, 1, 1), None), ("C", D(2005, 1, 1), D(2010, 1, 1)), ("D", D(2012, 1, 1), D(2013, 1, 1))}


def test_matching(spark):
    m = spark.createDataFrame([("T1", 1, "ACME", D(2010, 1, 1), None), ("T2", 2, "BETA", D(2010, 1, 1), None), ("T3", 3, "BETA", D(2010, 1, 1), None)], "ticker string, cik long, name_key string, start_date date, end_date date")
    r = spark.createDataFrame([(1, "X", D(2015, 1, 1)), (9, "ACME", D(2015, 1, 1)), (9, "BETA", D(2015, 1, 1)), (1, "X", D(2009, 1, 1))], "cik long, name_key string, day date")
    got = {(x.cik, x.name_key, x.day.year): x.ticker for x in intervals.match(r, m).collect()}
    assert got == {(1, "X", 2015): "T1", (9, "ACME", 2015): "T1", (9, "BETA", 2015): None, (1, "X", 2009): None}


def test_matching_meets_each_name_once(spark):
    """Many members of one name, with overlapping, touching, repeated and empty intervals, against the definition: the spells in
    which one alone has the name never overlap, so a row meets one at most."""
    rng = random.Random(7)
    at = lambda: D(2010, 1, 1) + dt.timedelta(rng.randrange(0, 1500, 30))
    m = [(f"T{rng.randrange(8)}" if i % 9 else None, rng.choice([None, 1, 2, 3]), rng.choice([None, "A", "B"]), at(), rng.choice([None, at(), at(), at()])) for i in range(60) if i < 30 or i % 3]
    m = [x if i % 2 else (x[0], x[1], f"N{i % 20}", x[3], x[4]) for i, x in enumerate(m)]
    rows = [(i, rng.choice([None, 1, 2, 3, 9]), rng.choice([None, "A", "B", *(f"N{k}" for k in range(0, 20, 2))]), rng.choice([None, at(), at(), at(), at()])) for i in range(800)]

    def want(cik, name, day):
        on = [x for x in m if day and x[3] <= day and (x[4] is None or x[4] > day)]
        own = sorted((x for x in on if x[1] == cik and cik is not None), key=lambda x: (x[3], x[0] or ""))
        named = {x[0] for x in on if x[2] == name and name is not None and x[0]}
        return (own and own[0][0]) or (named.pop() if len(named) == 1 else None)

    members = spark.createDataFrame(m, "ticker string, cik long, name_key string, start_date date, end_date date")
    got = intervals.match(spark.createDataFrame(rows, "id long, cik long, name_key string, day date"), members).collect()
    assert {r.id: r.ticker for r in got} == {r[0]: want(*r[1:]) for r in rows} and len(got) == len(rows)
    assert 0 < sum(r.ticker is not None for r in got) < len(rows)
    spells = sorted((r.name_key, r.since, r.until or D(9999, 1, 1)) for r in intervals.alone(members).collect())
    assert all(a[0] != b[0] or a[2] <= b[1] for a, b in zip(spells, spells[1:])) and any(s[2] < D(9999, 1, 1) for s in spells)


def test_cooldown_is_greedy(spark):
    rows = [("t", D(2018, 1, 1) + dt.timedelta(days=d), i, f"o{i}", 10.0) for i, d in enumerate((0, 1, 20, 31, 32, 62, 63))]
    p = spark.createDataFrame(rows, "ticker string, day date, row_no long, owner string, value double")
    assert sorted(r.row_no for r in clusters.cluster_events(p, 2).collect()) == [1, 3, 5]
    t = {r.row_no: (r.n_owners, r.total_value) for r in clusters.trailing(p).collect()}
    assert t[1] == (2, 20.0) and t[3] == (3, 30.0)


def test_text(spark):
    raw = "Acme Corp (NYSE: ACM) on January 5, 2018 wrote to bob@acme.com, see https://acme.com/x. Call (212) 555-1234. Mr. John Smith\n/s/ John Smith"
    r = spark.createDataFrame([(raw, "Acme Corp", "ACM")], "t string, n string, k string")
    v = text.name_variants(F.col("n"))
    out = r.select(v.alias("v"), text.redact(F.col("t"), v, F.col("k")).alias("x"), text.find_leaks(F.col("t"), v, F.col("k")).alias("l0"), text.find_leaks(text.redact(F.col("t"), v, F.col("k")), v, F.col("k")).alias("l1")).first()
    assert out.v == ["Acme Corp", "Acme"] and out.l1 == [] and len(out.l0) >= 5
    assert not any(w in out.x for w in ("Acme", "2018", "Smith", "555", "bob"))
    one = spark.range(1).select(
        text.primary_item(F.lit(" , 2.02,9.01")).alias("a"), text.primary_item(F.lit(" ,")).alias("b"), text.clean_ticker(F.lit("NYSE: BRK.B")).alias("c"), text.item_list(F.lit("9.01,2.02, 9.01")).alias("d"),
        text.normalise_company(F.lit("The Acme Holdings, Inc.")).alias("e"), F.length(text.scoring_text(F.repeat(F.lit("word "), F.lit(4000)))).alias("f"), html.html_to_text(F.lit("<p>a&nbsp;b</p><script>x<y</script>\n\n\n\nc")).alias("g"),
    ).first()
    assert (one.a, one.b, one.c, one.d, one.e, one.f, one.g) == ("2.02", "NA", "BRK.B", "2.02,9.01", "ACME", 11_999, "a b\n\nc")


def test_answers(spark):
    cases = [('{"direction":"up","probability":0.5,"rationale":"r"}', True), ('```json\n{"direction":"down","probability":1.0,"rationale":"r"}\n``` x {"a":1}', True), ('{"direction":"up","probability":0.4', False), ('{"direction":"flat","probability":0.7,"rationale":"r"}', False), ("no", False), (None, False)]
    got = spark.createDataFrame(cases, "raw string, ok boolean").select((text.parse_answer(F.col("raw")).isNotNull()).alias("got"), "ok").collect()
    assert all(r.got == r.ok for r in got)


def test_sources(spark, tmp_path):
    lines = spark.createDataFrame([("1|ACME|8-K|2018-01-05|edgar/data/1/0000000001-18-000001.txt",), ("2|B|8-K/A|2018-01-05|x",), ("x|B|8-K|2018-01-05|x",), ("a|b",)], "value string")
    got = readers.master_index(lines).collect()
    assert [(r.cik, r.accession_no) for r in got] == [(1, "0000000001-18-000001")]
    head = "<ACCEPTANCE-DATETIME>20180201163017\nACCESSION NUMBER: 1-2\nITEM INFORMATION: Results\nCOMPANY CONFORMED NAME: ACME\n<TYPE>8-K\n<SEQUENCE>1\n"
    r = spark.createDataFrame([(head,)], "t string").select(readers.filing_header(F.col("t")).alias("h")).first().h
    assert r.accepted_at == dt.datetime(2018, 2, 1, 21, 30, 17) and r.documents[0].type == "8-K"
    body = '[{"date":"2018-01-02T00:00:00Z","open":1,"high":2,"low":1,"close":1.5,"adjClose":1.4,"volume":9}]'
    bodies = spark.createDataFrame([("A", body), ("B", '{"detail":"no"}'), ("C", "[] quota exceeded")], "ticker string, body string")
    assert [(b.ticker, b.adj_close) for b in readers.bars_json(bodies).collect()] == [("A", 1.4)]
    (tmp_path / "m.csv").write_text("ticker,name,cik,start_date,end_date\nA,Acme,1,2010-01-01,\n")
    assert readers.membership_csv(spark, str(tmp_path / "m.csv")).first().end_date is None
    old, new = (spark.createDataFrame(x, "k int, v string, at int") for x in ([(1, "a", 1), (2, "b", 1)], [(2, "c", 2), (3, "d", 2)]))
    assert sorted(r.v for r in sinks.upsert(old, new, ["k"], "at").collect()) == ["a", "c", "d"]
    sinks.append_log(new, str(tmp_path / "log"), ["k"], old)
    assert [r.v for r in spark.read.parquet(str(tmp_path / "log")).collect()] == ["d"]
    sinks.bundle_csv(old, str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).count() == 2


def test_rules(spark):
    df = spark.createDataFrame([("up", 0.6, "live"), ("up", None, "live"), ("flat", 0.6, "live"), ("up", 0.25, "live"), ("up", 0.6, "backtest")], "direction string, probability double, run_mode string")
    assert [r.violation for r in schema.violations(df, "predictions").collect()] == [None, None, "direction", "probability", "run_mode"]
    with pytest.raises(ValueError):
        schema.checked_version(schema.VERSION + 1)


def test_allocation(spark):
    rows = [(f"s{i % 3}", i) for i in range(10)] + [("s9", 99)]
    df = spark.createDataFrame(rows, "s string, k int")
    assert sum(r.n_take for r in sampling.allocation(df, ["s"], 7).collect()) == 7
    assert sampling.stratified(df, ["s"], "k", 7).count() == 7


def test_trend_skips_months_with_a_missing_sleeve(spark):
    s = calendar.exchange_sessions(spark, 2018, 2018)
    days = s.orderBy("idx").collect()
    rows = [(t, r.idx, 100.0 + r.idx * (1 if t == "X" else 0)) for t in ("X", "CASH") for r in days if not (t == "X" and r.idx == days[-1].idx)]
    b = spark.createDataFrame(rows, "ticker string, idx int, adj_close double").withColumn("adj_open", F.col("adj_close")).withColumn("close", F.col("adj_close"))
    got = allocation.trend(b, s, ["X"], "CASH", 40).orderBy("month").collect()
    assert [r.n_changed for r in got] == [1] + [0] * (len(got) - 1) and all(r.ret < 0.2 for r in got)


def test_live_entries(spark, tmp_path, sessions):
    src = spark.createDataFrame([("a", "2018-02-05 20:59:00"), ("a", "2018-02-05 20:59:00"), ("b", "2018-02-05 21:00:00")], "accession_no string, at string").select("accession_no", F.col("at").cast("timestamp").alias("accepted_at"))
    src.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.schema).parquet(str(tmp_path / "in"))
    q = live.live_entries(stream, sessions).writeStream.format("memory").queryName("live").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("live").collect()
    assert sorted(r.accession_no for r in got) == ["a", "b"] and len({r.entry_idx for r in got}) == 2
