"""Registered queries against their SQL in another engine, and sources and sinks that have no query."""

import collections
import datetime as dt
import json
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyfold.functions import text
from tallyfold.operators import audit, clusters
from tallyfold.plans import event_books, ingest_checks, keyed, live, pages, peers, studies
from tallyfold.sources import readers, sinks

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = sorted({f.__name__ for m in (event_books, ingest_checks, keyed, live, pages, peers, studies) for f in vars(m).values() if callable(f) and getattr(f, "__module__", "") == m.__name__} & set(__spark_entry__.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def test_the_queries_are_found():
    assert len(OWN) > 40


@pytest.mark.parametrize("name", OWN)
def test_query_against_its_sql(spark, duck, sf_dir, name):
    df = __spark_entry__.queries()[name](spark, sf_dir)
    found = duck.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    plain = lambda x: round(float(x), 5) + 0.0 if isinstance(x, float) or type(x).__name__ == "Decimal" else x
    got, want = (collections.Counter(tuple(map(plain, r)) for r in rows) for rows in (df.select(*names).collect(), found.fetchall()))
    assert got == want


def test_trailing_sums_by_brute_force(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.choice("ab"), dt.date(2018, 1, 1) + dt.timedelta(days=rng.randint(0, 150)), i, f"o{rng.randint(0, 6)}", float(rng.randint(1, 9))) for i in range(200)]
    rows.append(("c", dt.date(2018, 1, 1), 999, None, 1.0))
    got = {(r.ticker, r.day, r.row_no): (r.n_owners, r.total_value) for r in clusters.trailing(spark.createDataFrame(rows, "ticker string, day date, row_no long, owner string, value double"), 30).collect()}
    for t, d, n, _, _ in rows[:-1]:
        near = [r for r in rows if r[0] == t and dt.timedelta(0) <= d - r[1] <= dt.timedelta(days=30) and (r[1], r[2]) <= (d, n)]
        assert got[t, d, n] == (len({r[3] for r in near}), sum(r[4] for r in near))


def test_text_rules(spark):
    one = spark.range(1).select(
        *[text.clean_ticker(F.lit(x)).alias(f"t{i}") for i, x in enumerate(("OTCBB:BDCG", "[NYSE: DM]", "VZX:TSXV", "N/A", "ISCA, ISCB", "-BRK.B.", "ABCDEFGHI"))],
        text.looks_like_markup(F.lit("a.HTM"), F.lit("x <b>")).alias("m"), text.looks_like_markup(F.lit("a.txt"), F.lit("<b>")).alias("n"),
        text.p_value(F.lit(0.0004)).alias("p"), text.p_value(F.lit(0.0456)).alias("q"), text.normalise_company(F.lit("New Acme Class A Holding Co., S.A.")).alias("c"),
        text.rendered("{a} and {b}", a=F.lit("x"), b=F.lit(None).cast("string")).alias("r"), readers.is_quota_error(F.lit("You have run over your limit")).alias("u"), readers.is_quota_error(F.lit("[1, 'exceeded']")).alias("v"),
    ).first()
    assert [one[f"t{i}"] for i in range(7)] == ["BDCG", "DM", "VZX", None, "ISCA", "BRK.B", None]
    assert (one.m, one.n, one.p, one.q, one.c, one.r, one.u, one.v) == (True, False, "<0.001", "0.046", "ACMESA", "x and ", True, False)


def test_answers_that_are_not_json_as_a_whole(spark):
    rows = [('{"company": "A"}', False, "A"), ('so {"company": "A"}  ', False, "A"), ('{"company": "A"} done', True, None), ('{"company": "A"}, {"company": "B"}', True, None), ("none", False, None), ('{"company": ', True, None)]
    df = spark.createDataFrame([r[:1] for r in rows], "raw string").select(audit.parsed_guess(F.col("raw")).alias("g"))
    assert [(r.g.failed, r.g.company) for r in df.collect()] == [r[1:] for r in rows]


def test_the_text_gate(spark):
    df = spark.createDataFrame([("fine words", "v2")], "t string, v string")
    assert df.select(text.anonymized_or_raise(F.col("t"), F.col("v"), "v2").alias("x")).first().x == "fine words"
    for t, v in (("fine words", "v1"), ("write to bob@acme.com", "v2")):
        with pytest.raises(Exception, match="version|leaks"):
            spark.createDataFrame([(t, v)], "t string, v string").select(text.anonymized_or_raise(F.col("t"), F.col("v"), "v2")).collect()


def test_sources_without_a_query(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "q1.zip", "w") as z:
        z.writestr("SUBMISSION.tsv", "ACCESSION_NUMBER\tX\tFILING_DATE\n1\ty\t05-JAN-2018\n2\ty\n")
        z.writestr("OTHER.tsv", "A\n1\n")
    got = readers.zipped_tsv(spark, str(tmp_path), "SUBMISSION.tsv", "ACCESSION_NUMBER string, FILING_DATE string").collect()
    assert [tuple(r) for r in got] == [(0, "1", "05-JAN-2018"), (1, "2", None)]
    (tmp_path / "ids.csv").write_text("accession_no,x\n 1 ,a\n,b\n1,c\n")
    assert [r.accession_no for r in readers.sample_accessions(spark, str(tmp_path / "ids.csv")).collect()] == ["1"]
    (tmp_path / "none.csv").write_text("accession_no\n")
    with pytest.raises(ValueError):
        readers.sample_accessions(spark, str(tmp_path / "none.csv"))
    (tmp_path / "trades.csv").write_text("accession_no,excess\n1,0.5\n")
    assert readers.trades(spark, "no_such_table", str(tmp_path / "trades.csv"), "accession_no string, excess double").first().excess == 0.5
    raw = "<DOCUMENT><FILENAME>a.htm\n<TEXT>one</TEXT><DOCUMENT><FILENAME>b.txt\n<TEXT>two</TEXT><DOCUMENT><FILENAME>a.htm\n<TEXT>three</TEXT></SEC-DOCUMENT>"
    m = spark.createDataFrame([(raw,)], "t string").select(readers.submission_bodies(F.col("t")).alias("m")).first().m
    assert m == {"b.txt": "two", "a.htm": "three"}
    url = spark.range(1).select(readers.quarter_index_url(F.lit(2018), F.lit(2)).alias("q"), readers.headers_url(F.lit(7), F.lit("0-1-2")).alias("h")).first()
    assert url.q.endswith("/full-index/2018/QTR2/master.idx") and url.h.endswith("/data/7/012/0-1-2-index-headers.html")


def test_sinks_without_a_query(spark, tmp_path):
    df = spark.createDataFrame([("B",), ("A",), ("B",), (None,)], "ticker string")
    sinks.write_tickers(df, str(tmp_path / "t"))
    assert sorted(r.value for r in spark.read.text(str(tmp_path / "t")).collect()) == ["A", "B"]
    sinks.replaced(df, str(tmp_path / "r"))
    sinks.replaced(df.limit(1), str(tmp_path / "r"))
    assert spark.read.parquet(str(tmp_path / "r")).count() == 1
    t = spark.createDataFrame([("1", dt.datetime(2018, 2, 1), "x"), ("2", dt.datetime(2019, 2, 1), "y")], "accession_no string, accepted_at timestamp, text string")
    sinks.write_texts(t, str(tmp_path / "x"))
    assert {r.year for r in spark.read.parquet(str(tmp_path / "x")).collect()} == {2018, 2019}
    with pytest.raises(RuntimeError), sinks.RunManifest(spark, "run", str(tmp_path / "m"), limit=3) as m:
        m.count("rows", 2)
        m.add_ledger(spark.createDataFrame([("why", 4, ["a"])], "reason string, n long, ex array<string>"), "ex")
        raise RuntimeError("stop")
    got = json.loads(spark.read.text(str(tmp_path / "m")).first().value)
    assert got["counts"] == {"rows": 2} and got["exclusions"] == {"why": 4} and got["examples"] == {"why": ["a"]} and "stop" in got["failed"]
