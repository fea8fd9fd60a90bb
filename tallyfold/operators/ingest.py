"""Ingest steps as joins: duplicate index rows, missing identifiers, insider purchases, back-filled dates, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar, text
from ..sources.readers import role
from .intervals import match, member_on


def deduplicated_index(rows: DataFrame, members: DataFrame) -> DataFrame:
    """rows (accession_no, row_no, cik, name_key, day) with ticker, one row for each accession: the first that is a member's,
    or else the first of all."""
    w = Window.partitionBy("accession_no").orderBy(F.col("ticker").isNull(), "row_no")
    return match(rows, members).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def ingested(rows: DataFrame, members: DataFrame, existing: DataFrame, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """New filings of members, at most `most` of the first by day and accession, and the ledger of the others: known already,
    no member, or outside the hours of acceptance."""
    known = existing.select(F.col("accession_no").alias("_k")).distinct()
    r = deduplicated_index(rows, members).join(known, F.col("accession_no") == F.col("_k"), "left")
    reason = (
        F.when(F.col("_k").isNotNull(), "already_ingested").when(F.col("ticker").isNull(), "not_a_member").when(~calendar.in_acceptance_window(F.col("accepted_at")), "outside_acceptance_window")
    )
    r = r.withColumn("reason", reason).drop("_k")
    new = r.where("reason is null").drop("reason")
    return (new if most is None else new.orderBy("day", "accession_no").limit(most)), r.where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def resolved_ciks(members: DataFrame, mapping: DataFrame) -> DataFrame:
    """members with cik filled from a ticker map (ticker, cik) where it is missing, and whether it is known now. Tickers are
    compared in their normal form, and of repeated ones the greatest cik counts; nobody is dropped."""
    m = mapping.groupBy(text.normalise_ticker(F.col("ticker")).alias("_t")).agg(F.max("cik").alias("_c"))
    j = members.join(m, members.ticker == F.col("_t"), "left")
    return j.withColumn("cik", F.coalesce("cik", "_c")).withColumn("resolved", F.col("cik").isNotNull()).drop("_t", "_c")


def insider_purchases(submissions: DataFrame, owners: DataFrame, transactions: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """Open-market purchases (code P, acquired) of officers and directors, one row for each transaction, with reason for
    those that are left out after the joins. Of an accession's owners the first qualifying one counts. With members, the
    issuer must be one on the filing day, by cik before ticker; without, any ticker that can be cleaned will do."""
    s = submissions.where((F.trim("document_type") == "4") & (F.trim("issuer_cik") != "")).withColumn("filing_date", calendar.insider_date(F.trim("filing_date"))).where("filing_date is not null")
    s = s.select("accession", F.trim("issuer_cik").cast("long").alias("issuer_cik"), F.trim("symbol").alias("symbol"), "filing_date")
    o = owners.withColumn("role", role(F.col("relationship"))).where(F.col("role") != "other")
    o = o.groupBy("accession").agg(F.min_by(F.struct(F.trim("owner_cik").alias("owner_cik"), "role"), "row_no").alias("_o")).select("accession", "_o.*")
    t = transactions.where((F.trim("code") == "P") & (F.trim("acquired") == "A"))
    j = t.join(s, "accession").join(o, "accession")
    if members is None:
        j = j.withColumn("ticker", text.clean_ticker(F.col("symbol"))).withColumn("_missing", F.lit("issuer_no_usable_ticker"))
    else:
        m = members.select(F.upper("ticker").alias("_t"), F.col("cik").alias("_c"), F.col("start_date").alias("_s"), F.col("end_date").alias("_e"), F.col("ticker").alias("_n"))
        on_day = member_on(F.col("filing_date"), F.col("_s"), F.col("_e"), True)
        key = ["accession", "row_no"]
        by_cik = j.join(m, (F.col("issuer_cik") == F.col("_c")) & on_day).groupBy(*key).agg(F.min_by("_n", F.struct("_s", "_n")).alias("t_cik"))
        by_ticker = j.join(m, (F.upper("symbol") == F.col("_t")) & on_day).groupBy(*key).agg(F.min(F.col("_t")).alias("t_symbol"))
        j = j.join(by_cik, key, "left").join(by_ticker, key, "left").withColumn("ticker", F.coalesce("t_cik", "t_symbol")).drop("t_cik", "t_symbol")
        j = j.withColumn("_missing", F.lit("issuer_not_universe_member_at_filing"))
    number = lambda c: F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(0.0)).otherwise(F.expr(f"try_cast(trim({c}) as double)"))
    j = j.withColumn("_q", number("shares")).withColumn("_p", number("price"))
    reason = F.when(F.col("ticker").isNull(), F.col("_missing")).when(F.col("_q").isNull() | F.col("_p").isNull(), "unparseable_shares_or_price")
    return j.select(
        "accession", "row_no", "issuer_cik", "ticker", "filing_date", calendar.insider_date(F.trim("trans_date")).alias("trans_date"), "owner_cik", "role",
        F.round("_q", 2).alias("shares"), F.round("_p", 4).alias("price"), F.round(F.col("_q") * F.col("_p"), 2).alias("value"), reason.alias("reason"),
    )


def backfilled(filings: DataFrame, body: Column, period: str = "period") -> DataFrame:
    """filings with a blank or missing period (text, yyyy-mm-dd) taken from the first long date of the body, and what came of
    it: null where the period was there, else parsed, raw_file_missing or no_event_date_in_text."""
    blank = F.coalesce(F.col(period), F.lit("")) == ""
    found = calendar.long_date(body)
    outcome = F.when(~blank, F.lit(None)).when(body.isNull(), "raw_file_missing").when(found.isNull(), "no_event_date_in_text").otherwise("parsed")
    return filings.withColumn("outcome", outcome).withColumn(period, F.when(blank, F.date_format(found, "yyyy-MM-dd")).otherwise(F.col(period)))


def coverage_report(bars: DataFrame, sessions: DataFrame, lo: str, hi: str, benchmark: str, thinnest: int = 10) -> DataFrame:
    """One row: sessions expected, tickers, tickers with 98 % of them or more, the benchmark's, and the thinnest tickers."""
    inside = F.col("day").between(F.lit(lo).cast("date"), F.lit(hi).cast("date"))
    expected = sessions.where(inside).agg(F.count(F.lit(1)).alias("expected_sessions"))
    n = bars.where(inside).groupBy("ticker").agg(F.count(F.lit(1)).alias("n"))
    all_ = n.crossJoin(F.broadcast(expected)).agg(  # one row
        F.count(F.lit(1)).alias("tickers_with_prices"), F.coalesce(F.sum((F.col("n") >= F.col("expected_sessions") * 0.98).cast("long")), F.lit(0)).alias("tickers_near_full_coverage"),
        F.coalesce(F.max(F.when(F.col("ticker") == benchmark, F.col("n"))), F.lit(0)).alias("benchmark_sessions"),
    )
    few = n.orderBy("n", "ticker").limit(thinnest).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", "ticker"))), lambda x: F.concat_ws(":", x["ticker"], x["n"].cast("string"))), ",").alias("thinnest"))
    return expected.crossJoin(F.broadcast(all_)).crossJoin(F.broadcast(few))  # one row each
