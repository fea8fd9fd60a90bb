"""Ingest, audit, scoring costs and the small table queries, on stand-ins made of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import calendar, stats, text
from ..operators import audit, books, ingest, intervals
from ..sources import readers
from .event_books import book_sql
from .standins import BASE
from .studies import _BOOK, _UNI, judged, priced, query

# item codes

CODE_SETS = ("2.02,9.01", "5.02", "1.01, 9.01", "8.01", " 4.02 ,2.02", "", "1.02,5.02", "7.01")
_CODES = "WITH c AS (SELECT o_orderkey, CASE o_orderkey % 8 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(CODE_SETS)) + " END AS codes FROM orders), l AS (SELECT *, list_transform(string_split(codes, ','), lambda x: trim(x)) AS cs FROM c) "


def coded(t):
    codes = F.element_at(F.array(*[F.lit(c) for c in CODE_SETS]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    return t.raw("orders").select("o_orderkey", codes.alias("codes"))


@query(
    _CODES + """SELECT CASE WHEN list_has_any(cs, ['1.03', '2.06', '4.02', '5.02']) THEN 'high-impact' WHEN list_contains(cs, '2.02') THEN 'earnings' ELSE 'routine' END AS bucket,
CASE WHEN list_contains(cs, '2.02') THEN 'earnings' WHEN list_contains(cs, '5.02') THEN 'management' WHEN list_has_any(cs, ['1.01', '1.02']) THEN 'agreement' ELSE 'other' END AS item_group, list_contains(cs, '2.02') AS is_earnings, count(*) AS n FROM l GROUP BY ALL"""
)
def item_buckets(t):
    c = F.col("codes")
    return coded(t).groupBy(text.bucket_for(c).alias("bucket"), text.item_group(c).alias("item_group"), text.is_earnings(c).alias("is_earnings")).agg(F.count(F.lit(1)).alias("n"))


PHRASES = (("Results of Operations and Financial Condition", "2.02"), ("Other Events", "8.01"), ("Departure of Directors; Election of Directors", "5.02"), ("Regulation FD Disclosure", "7.01"), ("Something Else", None))


@query(
    "WITH c AS (SELECT c_custkey, [" + ", ".join(f"'{k}'" if k else "NULL" for _, k in PHRASES) + "] AS k FROM customer) SELECT c_custkey, coalesce(array_to_string(list_sort(list_distinct(list_filter([k[1 + c_custkey % 5], k[1 + c_custkey % 3]], lambda x: x IS NOT NULL))), ','), '') AS codes FROM c"
)
def described_items(t):
    lines = F.array(*[F.lit(p) for p, _ in PHRASES])
    at = lambda n: F.concat(F.lit("ITEM INFORMATION: "), F.element_at(lines, (F.col("c_custkey") % n + 1).cast("int")), F.lit("\n"))
    header = F.concat(F.lit("ACCESSION NUMBER: 1\n"), at(5), at(3))
    return t.raw("customer").select("c_custkey", F.array_join(readers.filing_header(header)["item_codes"], ",").alias("codes"))


# index rows, identifiers, purchases


def index_rows(t):
    """Line items as index rows: an order's lines share its accession, suppliers are the registrants."""
    r = t.raw("lineitem").groupBy(F.col("l_orderkey").alias("accession_no"), (F.col("l_linenumber") * 1_000_000 + F.col("l_suppkey")).cast("long").alias("row_no"), F.col("l_suppkey").alias("cik")).agg(F.min(F.col("l_shipdate").cast("date")).alias("day"))
    return r.withColumn("name_key", F.concat(F.lit("N"), (F.col("cik") % 50).cast("string")))


def registrants(t):
    """A third of the suppliers, members from a day on; some share a normal name."""
    s = t.raw("supplier").where("s_suppkey % 3 = 0")
    return s.select(F.concat(F.lit("T"), F.col("s_suppkey").cast("string")).alias("ticker"), F.col("s_suppkey").alias("cik"), F.concat(F.lit("N"), (F.col("s_suppkey") % 50).cast("string")).alias("name_key"), F.expr("date_add(date'1995-01-01', cast(s_suppkey % 900 as int))").alias("start_date"), F.lit(None).cast("date").alias("end_date"))


_INDEX = """WITH r AS (SELECT l_orderkey AS accession_no, CAST(l_linenumber * 1000000 + l_suppkey AS BIGINT) AS row_no, l_suppkey AS cik, min(CAST(l_shipdate AS DATE)) AS day, 'N' || (l_suppkey % 50) AS name_key FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey),
m AS (SELECT 'T' || s_suppkey AS ticker, s_suppkey AS cik, 'N' || (s_suppkey % 50) AS name_key, DATE '1995-01-01' + CAST(s_suppkey % 900 AS INTEGER) AS start_date FROM supplier WHERE s_suppkey % 3 = 0),
n AS (SELECT r.accession_no, r.row_no, min(m.ticker) AS ticker FROM r JOIN m ON m.name_key = r.name_key AND m.start_date <= r.day GROUP BY ALL HAVING count(DISTINCT m.ticker) = 1),
x AS (SELECT r.*, coalesce(m.ticker, n.ticker) AS ticker FROM r LEFT JOIN m ON m.cik = r.cik AND m.start_date <= r.day LEFT JOIN n ON n.accession_no = r.accession_no AND n.row_no = r.row_no),
d AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY accession_no ORDER BY ticker IS NULL, row_no) = 1) """


@query(_INDEX + "SELECT accession_no, row_no, cik, ticker FROM d")
def deduplicated_index(t):
    return ingest.deduplicated_index(index_rows(t), registrants(t)).select("accession_no", "row_no", "cik", "ticker")


@query(_INDEX + "SELECT reason, count(*) AS n FROM (SELECT CASE WHEN accession_no % 4 = 0 THEN 'already_ingested' WHEN ticker IS NULL THEN 'not_a_member' WHEN accession_no % 5 = 0 THEN 'outside_acceptance_window' END AS reason FROM d) WHERE reason IS NOT NULL GROUP BY reason")
def ingest_ledger(t):
    """A quarter's ingest: known filings, strangers and those outside the hours of acceptance, counted."""
    at = F.when(F.col("accession_no") % 5 == 0, F.lit("2018-03-01 03:00:00")).otherwise(F.lit("2018-03-01 17:00:00")).cast("timestamp")
    existing = t.raw("orders").where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("accession_no"))
    return ingest.ingested(index_rows(t).withColumn("accepted_at", at), registrants(t), existing)[1]


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN c_custkey WHEN c_custkey % 3 <> 0 THEN c_custkey + 1000000 END AS cik, c_custkey % 4 = 0 OR c_custkey % 3 <> 0 AS resolved FROM customer")
def resolved_ciks(t):
    c = t.raw("customer")
    members = c.select("c_custkey", F.concat(F.lit("C-"), F.col("c_custkey").cast("string")).alias("ticker"), F.when(F.col("c_custkey") % 4 == 0, F.col("c_custkey")).alias("cik"))
    mapping = c.where("c_custkey % 3 <> 0").select(F.concat(F.lit(" c."), F.col("c_custkey").cast("string")).alias("ticker"), (F.col("c_custkey") + 1_000_000).alias("cik"))
    return ingest.resolved_ciks(members, mapping).select("c_custkey", "cik", "resolved")


@query(
    """WITH s AS (SELECT o_orderkey AS accession, o_custkey AS issuer_cik, CAST(o_orderdate AS DATE) AS filing_date FROM orders WHERE o_orderstatus <> 'P'),
t AS (SELECT l_orderkey AS accession, l_linenumber AS row_no, l_quantity AS q, l_extendedprice AS p FROM lineitem WHERE l_returnflag <> 'R')
SELECT accession, row_no, issuer_cik, CASE WHEN accession % 7 <> 0 THEN 'T' || (issuer_cik % 1000) END AS ticker, filing_date, CAST(accession % 5 AS VARCHAR) AS owner_cik, CASE WHEN accession % 2 = 0 THEN 'officer' ELSE 'director' END AS role,
round(CASE WHEN row_no = 2 THEN NULL WHEN row_no = 3 THEN 0 ELSE q END, 2) AS shares, CASE WHEN accession % 7 = 0 THEN 'issuer_no_usable_ticker' WHEN row_no = 2 THEN 'unparseable_shares_or_price' END AS reason FROM s JOIN t USING (accession)"""
)
def insider_rows(t):
    """Submissions, owners and transactions of free text: other forms, other owners first, sales, and amounts that do not parse."""
    o, li = t.raw("orders"), t.raw("lineitem")
    key = F.col("o_orderkey")
    sub = o.select(
        key.alias("accession"), F.when(F.col("o_orderstatus") == "P", "4/A").otherwise(" 4 ").alias("document_type"), F.col("o_custkey").cast("string").alias("issuer_cik"),
        F.when(key % 7 == 0, "N/A none").otherwise(F.concat(F.lit('NYSE: "T'), (F.col("o_custkey") % 1000).cast("string"), F.lit('"'))).alias("symbol"), F.upper(F.date_format("o_orderdate", "dd-MMM-yyyy")).alias("filing_date"),
    )
    own = o.select(key.alias("accession"), F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("row_no"), r.alias("relationship"), c.cast("string").alias("owner_cik")) for i, r, c in (
        (0, F.lit("TenPercentOwner"), F.lit(99)), (1, F.when(key % 2 == 0, "Officer,Director").otherwise("Director"), key % 5), (2, F.lit("Officer"), F.lit(98)))])).alias("x")).select("accession", "x.*")
    amount = F.when(F.col("l_linenumber") == 2, "n.a.").when(F.col("l_linenumber") == 3, "").otherwise(F.col("l_quantity").cast("string"))
    tr = li.select(F.col("l_orderkey").alias("accession"), F.col("l_linenumber").cast("long").alias("row_no"), F.when(F.col("l_returnflag") == "R", "S").otherwise("P").alias("code"), F.lit("A").alias("acquired"), F.lit("05-JAN-2018").alias("trans_date"), amount.alias("shares"), F.col("l_extendedprice").cast("string").alias("price"))
    return ingest.insider_purchases(sub, own, tr).select("accession", "row_no", "issuer_cik", "ticker", "filing_date", "owner_cik", "role", "shares", "reason")


# coverage, back-filled dates

_LO, _HI = "1996-01-01", "1996-12-31"


@query(
    BASE + f""", n AS (SELECT ticker, count(*) AS n FROM bars WHERE day BETWEEN DATE '{_LO}' AND DATE '{_HI}' GROUP BY ticker), e AS (SELECT count(*) AS x FROM sessions WHERE day BETWEEN DATE '{_LO}' AND DATE '{_HI}')
SELECT (SELECT x FROM e) AS expected_sessions, count(*) AS tickers_with_prices, CAST(count(*) FILTER (n >= (SELECT x FROM e) * 0.98) AS BIGINT) AS tickers_near_full_coverage, max(n) FILTER (ticker = 'ALL') AS benchmark_sessions,
(SELECT string_agg(ticker || ':' || n, ',' ORDER BY n, ticker) FROM (SELECT * FROM n ORDER BY n, ticker LIMIT 3)) AS thinnest FROM n"""
)
def bar_coverage(t):
    """The thinnest three are the report's feature."""
    return ingest.coverage_report(t.bars(), t.sessions(), _LO, _HI, "ALL", 3)


@query(
    """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2001-01-01' WHEN o_orderkey % 5 IN (0, 1) THEN NULL ELSE strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d') END AS period,
CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'raw_file_missing' WHEN o_orderkey % 5 = 1 THEN 'no_event_date_in_text' ELSE 'parsed' END AS outcome FROM orders"""
)
def backfilled_dates(t):
    key = F.col("o_orderkey")
    body = F.when(key % 5 == 0, F.lit(None)).when(key % 5 == 1, "nothing here").otherwise(F.concat(F.lit("Date of Report: "), F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit(" (earliest event)")))
    blank = F.when(key % 3 == 0, "2001-01-01").when(key % 2 == 0, "").otherwise(F.lit(None))
    return ingest.backfilled(t.raw("orders").select("o_orderkey", "o_orderdate", blank.alias("period")), body).select("o_orderkey", "period", "outcome")


# audit and scoring

_AUDIT = """WITH a AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS correct, c_custkey % 6 = 4 AS failed FROM customer) """


def audited(t):
    """Answers to the audit prompt: the ticker, the name with another form, unknown, a stranger, broken JSON, and prose before the brace."""
    c = t.raw("customer").select("c_custkey", F.concat(F.lit("TK"), F.col("c_custkey").cast("string")).alias("ticker"), F.concat(F.lit("Zephyr"), F.col("c_custkey").cast("string"), F.lit(" Holdings, Inc.")).alias("name"))
    answer = lambda company, ticker: F.concat(F.lit('{"company": "'), company, F.lit('", "ticker": "'), ticker, F.lit('", "confidence": 0.5}'))
    none = F.lit("")
    kinds = (
        answer(none, F.lower("ticker")), answer(F.concat(F.lit("The Zephyr"), F.col("c_custkey").cast("string"), F.lit(" Corp")), none), answer(F.lit("Unknown"), none),
        answer(F.lit("First National Bank"), F.lit("FNB")), F.concat(answer(F.col("name"), none), F.lit(" done")), F.concat(F.lit("I think: "), answer(F.col("name"), F.lit("X"))),
    )
    raw = F.element_at(F.array(*kinds), (F.col("c_custkey") % 6 + 1).cast("int"))
    g = c.withColumn("g", audit.parsed_guess(raw))
    return g.select("c_custkey", audit.is_correct(F.col("g.company"), F.col("g.ticker"), F.col("ticker"), F.col("name")).alias("correct"), F.col("g.failed").alias("failed"))


@query(_AUDIT + "SELECT c_custkey, correct, failed FROM a")
def audited_answers(t):
    return audited(t)


@query(_AUDIT + "SELECT count(*) AS attempted, CAST(sum(CAST(correct AS INT)) AS BIGINT) AS identified, CAST(sum(CAST(failed AS INT)) AS BIGINT) AS parse_failures, round(avg(CAST(correct AS INT)), 4) AS identification_rate, avg(CAST(correct AS INT)) > 0.2 AS exceeds_threshold FROM a")
def contamination_audit(t):
    return audit.identification(audited(t))


@query(BASE + ", q AS (SELECT *, CASE WHEN direction = 'up' THEN excess ELSE -excess END > 0 AS correct FROM good WHERE cik % 6 IN (2, 3, 4)) SELECT horizon, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS hit_rate, round(avg(pow(probability - CAST(correct AS INT), 2)), 6) AS brier FROM q GROUP BY horizon")
def unidentified_scores(t):
    """The calibration again, on issuers that the audit did not identify."""
    from ..operators import calibration

    rows = audit.unidentified(judged(t).withColumn("c_custkey", F.col("cik")), audited(t), "c_custkey")
    return calibration.scores(rows, ["horizon"], "probability", "correct").select("horizon", "n", "hit_rate", "brier")


@query("SELECT event_type, count(*) AS calls, round(sum(event_id % 1000) / 1e6 * 3 + sum(event_id % 100) / 1e6 * 15, 6) AS cost_usd, round((sum(event_id % 1000) / 1e6 * 3 + sum(event_id % 100) / 1e6 * 15) / count(*), 6) AS cost_per_filing, round(avg(CASE WHEN event_id % 13 = 0 THEN 1.0 ELSE 0.0 END), 5) AS parse_failure_rate FROM events GROUP BY event_type")
def scoring_cost(t):
    calls = t.raw("events").select("event_type", (F.col("event_id") % 1000).alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens"), (F.col("event_id") % 13 == 0).alias("failed"))
    return audit.scoring_cost(calls, ["event_type"], 3.0, 15.0)


@query(
    BASE.replace("good AS (", "good0 AS (") + ", good AS (SELECT * EXCLUDE (horizon), 'model' || horizon AS horizon FROM good0)" + _BOOK + """, bm AS (SELECT horizon AS model, month, (lo - 0.001 + sh - 0.001) / 2 AS r FROM m),
q AS (SELECT horizon AS model, probability, CASE WHEN direction = 'up' THEN excess ELSE -excess END > 0 AS correct FROM good),
c AS (SELECT model, count(*) AS n, round(avg(CAST(correct AS INT)), 6) AS hit_rate, round(avg(pow(probability - CAST(correct AS INT), 2)), 6) AS brier, round(avg(probability) - avg(CAST(correct AS INT)), 6) AS overconfidence FROM q GROUP BY model)
SELECT * FROM c LEFT JOIN (""" + book_sql("bm", "model") + ") USING (model)"
)
def head_to_head(t):
    """Models side by side; the horizons stand for them."""
    rows = judged(t).withColumn("model", F.concat(F.lit("model"), F.col("horizon").cast("string")))
    return audit.head_to_head(rows, ["model"], books.monthly_book(rows, ["model", "month"], "score", "excess", "accession", 10))


# small shapes


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'O' AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 3, 5)) ORDER BY o_orderdate, o_orderkey LIMIT 50")
def pending_filings(t):
    """The next 50 to score, of a sample's ids: the caller's limit."""
    ids = t.raw("customer").where(F.col("c_nationkey").isin(1, 3, 5)).select(F.col("c_custkey").alias("o_custkey"))
    return t.raw("orders").where("o_orderstatus = 'O'").join(ids, "o_custkey", "left_semi").orderBy("o_orderdate", "o_orderkey").limit(50).select("o_orderkey", "o_custkey")


@query("SELECT o_custkey, count(*) AS n, row_number() OVER (ORDER BY count(*), o_custkey) AS place FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1996-06-30' GROUP BY o_custkey QUALIFY place <= 100")
def thinnest_customers(t):
    """Counts between two days, ascending: a report's first hundred."""
    from pyspark.sql import Window

    day = F.col("o_orderdate").cast("date")
    n = t.raw("orders").where(day.between(F.lit("1996-01-01").cast("date"), F.lit("1996-06-30").cast("date"))).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return n.orderBy("n", "o_custkey").limit(100).withColumn("place", F.row_number().over(Window.orderBy("n", "o_custkey")))


@query("SELECT event_type, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, event_type) AS place FROM events GROUP BY event_type")
def counts_descending(t):
    from pyspark.sql import Window

    n = t.raw("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n"), "event_type")))  # a row for each type


@query("SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O' AND o_totalprice IS NOT NULL")
def filtered_count(t):
    return t.raw("orders").where("o_orderstatus = 'O' and o_totalprice is not null").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT DISTINCT c_nationkey, c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL")
def distinct_pairs(t):
    return t.raw("customer").where("c_mktsegment is not null").select("c_nationkey", "c_mktsegment").distinct()


@query("SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS year FROM orders")
def distinct_years(t):
    return t.raw("orders").select(F.year("o_orderdate").alias("year")).distinct()


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders")
def updated_by_key(t):
    """UPDATE by key: the changes' values where they have one."""
    o = t.raw("orders").select("o_orderkey", "o_totalprice")
    changes = t.raw("orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("_k"), (F.col("o_totalprice") + 1).alias("_v"))
    return o.join(changes, F.col("o_orderkey") == F.col("_k"), "left").select("o_orderkey", F.coalesce("_v", "o_totalprice").alias("o_totalprice"))


@query("SELECT DISTINCT c_mktsegment AS ticker, row_number() OVER (ORDER BY c_mktsegment <> 'BUILDING', c_mktsegment) AS place FROM (SELECT DISTINCT c_mktsegment FROM customer)")
def benchmark_first(t):
    from pyspark.sql import Window

    return t.raw("customer").select(F.col("c_mktsegment").alias("ticker")).distinct().withColumn("place", F.row_number().over(Window.orderBy(F.col("ticker") != "BUILDING", "ticker")))  # a row for each segment


@query(BASE + "SELECT day, idx, lag(day) OVER (ORDER BY idx) AS previous FROM sessions QUALIFY day BETWEEN DATE '1996-03-01' AND DATE '1997-02-28'")
def trading_days(t):
    s = t.sessions()
    p = s.select((F.col("idx") + 1).alias("idx"), F.col("day").alias("previous"))
    return s.join(p, "idx", "left").where(F.col("day").between(F.lit("1996-03-01").cast("date"), F.lit("1997-02-28").cast("date"))).select("day", "idx", "previous")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS sic, CAST(NULL AS VARCHAR) AS sic_description FROM events")
def submission_fields(t):
    """Two fields of a JSON body, the second of which these bodies lack."""
    body = F.replace("props", F.lit('"k"'), F.lit('"sic"'))
    return t.raw("events").select("event_id", readers.submission_company(body).alias("c")).select("event_id", "c.*")


@query(BASE + "SELECT accession, CAST(json_object('horizon', horizon, 'reason', coalesce(reason, 'none')) AS VARCHAR) AS shaped FROM ret")
def shaped_rows(t):
    from .studies import returns

    r = returns(t).withColumn("reason", F.coalesce("reason", F.lit("none")))
    return r.select("accession", F.to_json(F.struct("horizon", "reason")).alias("shaped"))


@query("SELECT item_id, 'Item ' || item_id || ', p ' || CASE WHEN item_id / 200000.0 < 0.001 THEN '<0.001' ELSE printf('%.3f', item_id / 200000.0) END AS line FROM benchmark")
def rendered_lines(t):
    p = F.col("item_id") / 200_000.0
    return t.raw("benchmark").select("item_id", text.rendered("Item {id}, p {p}", id=F.col("item_id"), p=text.p_value(p)).alias("line"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'refused' ELSE 'kept' END AS outcome FROM part")
def refused_bodies(t):
    """Vendor bodies: every third is a refusal sent as data, and a bar list that says 'exceeded' is none."""
    body = F.when(F.col("p_partkey") % 3 == 0, "Error: You have run over your 500 symbol look up for this month").otherwise('[{"note": "expectations exceeded"}]')
    kept, bad = readers.purged(t.raw("part").select("p_partkey", body.alias("body")))
    return kept.select("p_partkey", F.lit("kept").alias("outcome")).unionByName(bad.select("p_partkey", F.lit("refused").alias("outcome")))


@query("SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '18000001/' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') || '-18-000001.txt' AS url FROM orders")
def filing_urls(t):
    accession = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 10, "0"), F.lit("-18-000001"))
    return t.raw("orders").select("o_orderkey", readers.submission_url(F.col("o_custkey"), accession).alias("url"))


@query("SELECT c_custkey, 0 AS table_no, CAST(g AS INTEGER) AS row_no, CASE WHEN g = 0 THEN 'Symbol|Security' ELSE 'T' || c_custkey || '|' || c_name END AS cells FROM customer, (SELECT unnest([0, 1]) AS g)")
def html_tables(t):
    """Rows of membership tables in HTML: a header, nested markup in cells, an attribute on the row."""
    html = F.concat(F.lit("<p>x</p><TABLE class='a'><tr><th>Symbol</th><th> Security </th></tr>\n<tr id=1><td><a href='#'>T"), F.col("c_custkey").cast("string"), F.lit("</a></td><td>"), F.col("c_name"), F.lit("</td></tr></table>"))
    r = readers.html_rows(t.raw("customer").select("c_custkey", html.alias("html")), "c_custkey", "html")
    return r.select("c_custkey", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


@query(_UNI + ", r AS (SELECT o_custkey AS ticker, CAST(o_orderdate AS DATE) AS day, o_orderkey FROM orders) SELECT o_orderkey FROM r JOIN u USING (ticker) WHERE start_date <= day AND (end_date IS NULL OR end_date >= day)")
def member_orders(t):
    """Orders on a day of membership, the last included."""
    u = t.universe()
    r = t.raw("orders").select("o_orderkey", F.col("o_custkey").alias("ticker"), F.col("o_orderdate").cast("date").alias("day"))
    return r.join(u, "ticker").where(intervals.member_on(F.col("day"), F.col("start_date"), F.col("end_date"), True)).select("o_orderkey")


@query("SELECT event_id, CASE WHEN year(ts) <= 2019 THEN 'explore' WHEN year(ts) <= 2024 THEN 'holdout' ELSE 'forward' END AS part, (hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts))) BETWEEN 14400 AND 72000 AS in_window FROM events")
def acceptance_windows(t):
    at = F.col("ts").cast("timestamp")
    return t.raw("events").select("event_id", calendar.partition_of(at).alias("part"), calendar.in_acceptance_window(at, "UTC").alias("in_window"))


@query(BASE + "SELECT horizon, bucket, part, count(*) AS n FROM good GROUP BY CUBE (bucket, part), horizon")
def sample_tallies(t):
    """Counts by group, by partition and by both; null stands for all."""
    p = priced(t)
    every = None
    for keys in (["bucket", "part"], ["bucket"], ["part"], []):
        c = p.groupBy("horizon", *keys).agg(F.count(F.lit(1)).alias("n"))
        c = c.select("horizon", *[F.col(k) if k in keys else F.lit(None).cast("string").alias(k) for k in ("bucket", "part")], "n")
        every = c if every is None else every.unionByName(c)
    return every


__all__ = ["audited", "coded", "index_rows", "registrants", "stats"]
