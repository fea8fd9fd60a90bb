"""Every redaction step and leak scan of SURVEY I2 and I5."""

import pytest
from pyspark.sql import functions as F

from tallyfold.functions import text

CASES = [
    ("at Voorhees, NJ 08043 now", "at [ADDRESS], [STATE] [ID] now", "city_state:Voorhees, NJ"), ("in Los Gatos, California x", "in [ADDRESS], [STATE] x", None), ("on Jan 5, 2018 x", "on [DATE] x", "date:Jan 5, 2018"),
    ("on 1-5-2018 x", "on [DATE] x", "date:1-5-2018"), ("in Sept. 2018 x", "in [PERIOD] x", "year:2018"), ("Q1 quarter 2018 x", "the relevant quarter x", "year:2018"), ("fiscal year 2018 x", "the relevant fiscal year x", "year:2018"),
    ("at One Apple Park Way x", "at [ADDRESS] x", "street:One Apple Park Way"), ("at 100 Winchester Circle x", "at [ADDRESS] x", "street:100 Winchester Circle"), ("Jane Q. Smith, Chief Executive Officer said", "[PERSON], [TITLE] said", None),
    ("our President Jane Smith said", "our [TITLE] [PERSON] said", None), ("by kpmg and Computershare x", "by [AUDITOR] and [AUDITOR] x", None), ("in West Virginia x", "in West [STATE] x", None), ("near D.C., x", "near [STATE], x", None),
    ("see aapl-20180201.htm x", "see [ID] x", "filename:aapl-20180201.htm"), ("a@b.org wrote", "[ID] wrote", "email:a@b.org"), ("zip 12345 x", "zip [ID] x", None), ("number 0000320193 and AAPL", "number [ID] and [TICKER]", "cik:320193"), ("(NYSE: AAPL) x", "([TICKER]) x", "ticker:AAPL"),
]


def test_redaction_steps_and_scans(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(CASES)], "i int, t string")
    k, c = F.lit("AAPL"), F.lit(320193)
    done = text.redact(F.col("t"), None, k, c)
    for r in df.select("i", done.alias("x"), text.find_leaks(F.col("t"), None, k, c).alias("before"), text.find_leaks(done, None, k, c).alias("after")).collect():
        raw, want, leak = CASES[r.i]
        assert r.x == want and (leak is None or leak in r.before), (raw, r)
        assert [x for x in r.after if not x.startswith("city_state:")] == [], (raw, r)


@pytest.mark.parametrize("name,want", [("General Electric Company", ["General Electric"]), ("Wells Fargo & Company", ["Wells Fargo"])])
def test_generic_heads_stay(spark, name, want):
    got = spark.range(1).select(text.name_variants(F.lit(name)).alias("v")).first().v
    assert set(want) <= set(got) and "General" not in got


@pytest.mark.parametrize(
    "name,want",
    [
        ("BANK OF AMERICA CORP /DE/", ["BANK OF AMERICA CORP /DE/", "BANK AMERICA /DE/", "BANK AMERICA"]), ("Smith/Jones Inc", ["Smith/Jones Inc", "Smith/Jones"]), ("A_B Widgets, Inc.", ["A_B Widgets  Inc", "A_B Widgets"]),
        ("Wells Fargo & Company", ["Wells Fargo & Company", "Wells Fargo &", "Wells Fargo", "Wells"]), ("", []), (None, []), ("The Co", ["The Co"]), ("IBM", ["IBM"]), ("Élan Ärzte-Haus plc", ["Élan Ärzte-Haus plc", "Élan Ärzte-Haus", "Élan"]),
    ],
)
def test_names_keep_their_marks(spark, name, want):
    assert spark.range(1).select(text.name_variants(F.lit(name).cast("string")).alias("v")).first().v == want


def by_hand(raw, variants=(), ticker="", cik=None):
    """The same steps one after the other in another regular expression engine."""
    import collections
    import re

    counts, out = collections.Counter(), raw or ""

    def sub(key, pattern, placeholder):
        nonlocal out
        flags = re.I if pattern.startswith("(?i)") else 0
        out, n = re.subn(pattern.removeprefix("(?i)").replace(r"\z", r"\Z"), lambda m: placeholder, out, flags=flags)
        if n:
            counts[key] += n

    for step in text.REDACTIONS:
        sub(*step)
    for v in variants:
        sub("company_name", rf"(?i)\b{re.escape(v)}\b", "[COMPANY]")
    if ticker:
        sub("ticker_with_exchange", rf"\b(?:NYSE|NASDAQ|Nasdaq|AMEX)\s*:\s*{re.escape(ticker)}\b", "[TICKER]")
        sub("ticker", rf"\b{re.escape(ticker)}\b", "[TICKER]")
    if cik is not None:
        sub("cik_number", rf"\b0*{cik}\b", "[ID]")
    for step in text.LATE_REDACTIONS:
        sub(*step)
    out = re.sub(text.RUN, lambda m: m[1] + " ", out)
    return re.sub(r"[ \t]{2,}", " ", out).strip(), dict(counts)


def test_counts_are_of_replacements(spark, sf_dir):
    special = [
        "see https://acme.com/2018-01-05/a and 2018-02-01", "Acme Corp (NYSE: ACM) and ACME; ACM rose. CIK 0000320193, number 00320193", "Mr. John Smith of KPMG, Los Gatos, California on Jan 5, 2018, Q1 quarter 2018; /s/ Jane Roe", None, "", "Dr. A at 12 Long Lake Drive, Voorhees, NJ 08043 (212) 555-1234",
    ]
    rows = [(i, t) for i, t in enumerate(special)] + [(100 + r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").where("length(text) < 5000").select("doc_id", "text").collect()]
    variants = ["Acme Corp", "Acme"]
    v = F.array(*[F.lit(x) for x in variants])
    got = {r.i: (r.r.text, r.r.counts) for r in spark.createDataFrame(rows, "i long, t string").select("i", text.redaction(F.col("t"), v, F.lit("ACM"), F.lit(320193)).alias("r")).collect()}
    for i, t in rows:
        assert got[i] == by_hand(t, variants, "ACM", 320193), t
    assert got[0][1] == {"url": 1, "date_iso": 1} and got[1][1]["company_name"] == 2


def test_needs_are_necessary(spark):
    """Every match of a step holds what the step needs, in any case and any script's digits; the steps under one test need digits."""
    found = ["WWW.x", "HTTPS://x", "http://y", "a@b.c", "file.HTM", "x.y.Zip", "abc.jpeg", "CIK 00001234", "Central Index Key: ١٢٣٤٥", "12-3456789", "(212) 555-1234", "/s/ Jo Do", "Q1 quarter of 2018", "fiscal ٢٠١٨", "May 5, 2018", "5 MAY 2018", "\u017fept. 2018", "1/5/18", "2018-01-05", "12345-6789", "1999"]
    step = {n: p for n, p, _ in (*text.REDACTIONS, *text.LATE_REDACTIONS)}
    df = spark.createDataFrame([(x,) for x in found], "t string")
    r = df.select(*[F.sum((F.regexp_like("t", F.lit("(?U)" + step[n])) & ~F.regexp_like("t", F.lit(need))).cast("int")).alias(n) for n, need in text.NEEDS.items()], *[F.sum(F.regexp_like("t", F.lit("(?U)" + step[n])).cast("int")).alias(f"n_{n}") for n in text.NEEDS]).first()
    assert all(r[n] == 0 and r[f"n_{n}"] > 0 for n in text.NEEDS)
    late = [text.NEEDS.get(n) == text.DIGIT for n, _, _ in text.LATE_REDACTIONS]
    assert late == sorted(late)
    assert all(not any(c.isdigit() for c in placeholder) for _, _, placeholder in (*text.REDACTIONS, *text.LATE_REDACTIONS))
