"""Keyed tables: rules at every write, snapshots behind a pointer, and ledgers counted in one pass."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tallyfold.sources.sinks import RunManifest
from tallyfold.sources.tables import KeyedTable

PRICES = "ticker string, day date, open double, high double, low double, close double, adj_close double, volume double"
D = dt.date


def bars(spark, *rows):
    return spark.createDataFrame([(t, D(2018, 1, d) if d else None, None, None, None, c, None, None) for t, d, c in rows], PRICES)


def test_upsert_replaces_by_key_and_keeps_rejected_rows_apart(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "prices"), "prices")
    assert t.version() == 0 and t.read().count() == 0 and t.rejected().count() == 0
    assert t.upsert(bars(spark, ("A", 1, 1.0), ("B", 1, 2.0), (None, 1, 3.0), ("C", None, 4.0)), "close") == 1
    assert t.upsert(bars(spark, ("A", 1, 9.0), ("A", 1, 8.0), ("A", 2, 5.0)), F.desc("close")) == 2
    assert sorted((r.ticker, r.day.day, r.close) for r in t.read().collect()) == [("A", 1, 9.0), ("A", 2, 5.0), ("B", 1, 2.0)]
    assert t.rejected().count() == 0
    t.upsert(bars(spark, (None, 3, 1.0), ("Z", None, 1.0)), "close")
    assert sorted(r.violation for r in t.rejected().collect()) == ["day_is_null", "ticker_is_null"] and t.read().count() == 3
    assert t.replace(bars(spark, ("Q", 1, 1.0)), "close") == 4
    assert [r.ticker for r in t.read().collect()] == ["Q"]
    assert sorted(p.name for p in (tmp_path / "prices").iterdir() if p.name.startswith("snapshot")) == ["snapshot-3", "snapshot-4"]


def test_a_lost_job_leaves_the_old_table(spark, tmp_path):
    t = KeyedTable(spark, str(tmp_path / "prices"), "prices")
    t.upsert(bars(spark, ("A", 1, 1.0)), "close")
    # the next snapshot was written in part, and its pointer never
    bars(spark, ("half", 1, 1.0)).write.parquet(t.at(2))
    assert [r.ticker for r in t.read().collect()] == ["A"]
    broken = bars(spark, ("B", 1, 1.0)).withColumn("close", F.raise_error(F.lit("lost")).cast("double"))
    with pytest.raises(Exception, match="lost"):
        t.upsert(broken, "ticker")
    assert t.version() == 1 and [r.ticker for r in KeyedTable(spark, t.path, "prices").read().collect()] == ["A"]
    t.upsert(bars(spark, ("B", 1, 1.0)), "close")
    assert sorted(r.ticker for r in t.read().collect()) == ["A", "B"]


def test_checks_parents_and_immutable_rows(spark, tmp_path):
    filings = spark.createDataFrame([("f1",), ("f2",)], "accession_no string")
    t = KeyedTable(spark, str(tmp_path / "p"), "predictions", {"filings": filings})
    schema = "id long, accession_no string, model_id string, prompt_version string, direction string, probability double, rationale string, created_at timestamp, run_mode string"
    row = lambda i, f="f1", d="up", p=0.7, m="live": (i, f, "m", "v", d, p, "r", None, m)
    t.upsert(spark.createDataFrame([row(1), row(2, "none"), row(3, d="flat"), row(4, p=0.4), row(5, m="test"), row(6, d=None), row(None)], schema), "id")
    assert sorted(r.id for r in t.read().collect()) == [1, 6]
    assert {r.id: r.violation for r in t.rejected().collect()} == {2: "accession_no_without_filings", 3: "direction", 4: "probability", 5: "run_mode", None: "id_is_null"}
    t.upsert(spark.createDataFrame([row(1, "f2"), row(7, "f2")], schema), "id")
    assert {r.id: r.accession_no for r in t.read().collect()} == {1: "f1", 6: "f1", 7: "f2"}
    assert [(r.id, r.violation) for r in t.rejected().collect()] == [(1, "immutable")]
    with pytest.raises(ValueError):
        t.replace(spark.createDataFrame([row(8)], schema), "id")
    e = KeyedTable(spark, str(tmp_path / "e"), "evaluations", {"predictions": t})
    one = "prediction_id long, horizon int, entry_date date, exit_date date, raw_return double, excess_return double, cost_bps double, net_return double"
    e.upsert(spark.createDataFrame([(1, 5, None, None, 0.1, 0.1, 0.0, 0.1), (1, 5, None, None, 0.1, 0.1, 10.0, 0.099), (9, 5, None, None, 0.1, 0.1, 0.0, 0.1), (1, 0, None, None, 0.1, 0.1, 0.0, 0.1)], one), "raw_return")
    assert e.read().count() == 2 and sorted(r.violation for r in e.rejected().collect()) == ["horizon", "prediction_id_without_predictions"]


def test_counts_of_the_one_pass(spark, tmp_path):
    df = spark.createDataFrame([(i, [None, "a", "b", "c"][i % 4]) for i in range(41)], "i int, why string")
    with RunManifest(spark, "run", str(tmp_path / "m")) as m:
        m.written(df, str(tmp_path / "rows"), "why", ["a", "b", "never"])
    got = json.loads(spark.read.text(str(tmp_path / "m")).first().value)
    assert got["counts"] == {"read": 41, "written": 11} and got["exclusions"] == {"a": 10, "b": 10, "other": 10}
    assert spark.read.parquet(str(tmp_path / "rows")).columns == ["i"] and spark.read.parquet(str(tmp_path / "rows")).count() == 11


def test_keys_of_parents_stay_with_the_executors(spark):
    """A parent's keys meet the rows by sorting, however small its files look."""
    from tallyfold.sources.tables import KeyedTable

    parents = spark.range(10)
    rows = spark.range(20).selectExpr("id as prediction_id", "1 as horizon", "cast(null as date) as entry_date", "cast(null as date) as exit_date", "0D as raw_return", "0D as excess_return", "10D as cost_bps", "0D as net_return")
    judged = KeyedTable(spark, "/nowhere", "evaluations", {"predictions": parents}).judged(rows)
    assert judged.where("violation = 'prediction_id_without_predictions'").count() == 10
    assert "Broadcast" not in judged._jdf.queryExecution().executedPlan().toString()
