"""HTML as text and tables, submissions, and membership read backward: against the standard library and brute force."""

import datetime as dt
import html as standard
import html.entities
import random

from pyspark.sql import functions as F

from tallyfold.functions import calendar, html
from tallyfold.operators import intervals
from tallyfold.sources import readers

D = dt.date


def test_references_as_the_standard_library_reads_them(spark):
    rng = random.Random(1)
    names = list(standard.entities.html5)
    rows = ["&amp;lt;", "It&#8217;s &ldquo;x&rdquo; &copy;", "&notit; &copy2020 &", "&& &#; &#x; &#xZ; &#0; &#x80; &#150; &#55296; &#1114112; &#99999999999999999999; &#128512;", "&#000000000065;&#X41", "&nosuch; &Ouml &ouml1", "plain", "&", ""]
    rows += ["".join(rng.choice(["&", ";", "#", " ", "x", "é"] + ["&" + rng.choice(names) for _ in range(6)]) for _ in range(12)) for _ in range(300)]
    rows += ["&" + n for n in names]
    rows = [r for r in rows if "&#x" not in r or r in rows[:5]]  # control characters stay here and go there
    got = spark.createDataFrame(list(enumerate(rows)), "i int, t string").select("i", html.unescaped(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: standard.unescape(r) for i, r in enumerate(rows)}


def test_markup(spark):
    cases = [
        ('<a title="x > y" b=\'>\'>in</a> a < b', "in a < b"), ('<script x=">">var a="</b>";</script >z<STYLE>q</sTyle\n>', "z"), ("a<!-- <script> -->b<!-->c<!-- x", "a b c"), ("<!DOCTYPE html><p a=b c>ok</p><br/>x</>y</3>z", "ok x y z"),
        ("Net</td><td>Sales", "Net Sales"), ("a&nbsp;&nbsp;\t b \r\n\n\n\n c\x0bd", "a b\n\nc\nd"), ("<script>never ends", ""), ("<p title=it's>x</p>y", "x y"), ("1 <2 & 3> 2", "1 <2 & 3> 2"), (None, ""), ("<p" + ' a="b>"' * 40_000 + ">long</p>", "long"), ("x" * 300_000 + "<b>", "x" * 300_000),
    ]
    got = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string").select("i", html.html_to_text(F.col("t")).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: c[1] for i, c in enumerate(cases)}


def test_submission_keeps_body_and_exhibits(spark):
    doc = lambda kind, seq, name, body: f"<DOCUMENT>\n<TYPE>{kind}\n<SEQUENCE>{seq}\n<FILENAME>{name}\n<TEXT>\n{body}\n</TEXT>\n</DOCUMENT>\n"
    text = doc("EX-99.1", 2, "dex991.htm", "<html><p>Revenue rose 12&#37;</p></html>") + doc("8-K", 1, "d8k.htm", "<html>Results of operations</html>") + doc("GRAPHIC", 3, "logo.jpg", "binary-noise") + doc("EX-99.2", 4, "raw.txt", "a <b> stays") + doc("EX-99.3", 5, "none.htm", "<p> </p>") + doc("EX-10", 6, "x.htm", "no")
    got = spark.createDataFrame([(text,), (None,), ("nothing",)], "t string").select(readers.submission_text(F.col("t")).alias("x")).collect()
    assert [r.x for r in got] == ["[8-K]\nResults of operations\n\n[EX-99.1]\nRevenue rose 12%\n\n[EX-99.2]\na <b> stays", None, ""]


def test_cells_over_rows_and_columns(spark):
    page = "<table><tr><th rowspan=2>Effective <b>Date</b></th><th colspan='2'>Added</th><th colspan=\"2\">Removed</th></tr><tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>" \
        "<tr><td rowspan=3>May 1, 2020</td><td>A.B</td><td>A &amp; B</td><td rowspan=2>C</td><td>x</td></tr><tr><td>D</td><td>d</td><td>y</td></tr><tr><td></td><td></td><td>nan</td><td>z</td></tr><tr></tr><tr><td>2020-06-01[1]</td><td> e<td>E<td>F<td>f</table>"  # fmt: skip
    page = "<table><tr><th>Symbol</th><th>x</th></tr></table><TABLE><TR><TH>CIK</TH><TH>Symbol</TH><TH>Security</TH></TR><tr><td>0012</td><td>brk.b</td><td>B</td></tr><tr><td>-</td><td> </td><td>B</td></tr></TABLE>" + page
    df = spark.createDataFrame([(1, page), (2, "<p>none</p>"), (3, None)], "k int, h string")
    rows = {(r.table_no, r.row_no): (r.header, r.cells) for r in readers.html_rows(df, "k", "h").collect()}
    assert rows[2, 0] == (True, ["Effective Date", "Added", "Added", "Removed", "Removed"]) and rows[2, 1] == (True, ["Effective Date", "Ticker", "Security", "Ticker", "Security"])
    assert [rows[2, i][1] for i in (2, 3, 4, 6)] == [["May 1, 2020", "A.B", "A & B", "C", "x"], ["May 1, 2020", "D", "d", "C", "y"], ["May 1, 2020", "", "", "nan", "z"], ["2020-06-01[1]", "e", "E", "F", "f"]]
    current, changes = readers.membership_pages(df, "k", "h")
    assert [tuple(r) for r in current.collect()] == [(1, "BRK-B", "B", 12)]
    assert sorted((r.day, r.added or "", r.removed or "") for r in changes.collect()) == [(D(2020, 5, 1), "", ""), (D(2020, 5, 1), "A-B", "C"), (D(2020, 5, 1), "D", "C"), (D(2020, 6, 1), "E", "F")]


def test_dates_of_pages(spark):
    cases = {"March 15, 2020": D(2020, 3, 15), "Mar 5, 2020": D(2020, 3, 5), "2020-03-15": D(2020, 3, 15), "15 March 2020": D(2020, 3, 15), "3/15/2020": D(2020, 3, 15), " May  1, 2020 [2]": D(2020, 5, 1), "soon": None, "": None, "February 30, 2020": None}
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", calendar.universe_date(F.col("t")).alias("d")).collect()
    assert {r.t: r.d for r in got} == cases


def walked(now, changes):
    """The walk from the newest change backward."""
    out, ends = [], {t: None for t in now}
    for day, added, removed in sorted(changes, key=lambda c: c[0], reverse=True):
        if added in ends:
            out.append((added, day, ends.pop(added)))
        if removed:
            if removed in ends:
                out.append((removed, day, ends.pop(removed)))
            ends[removed] = day
    out += [(t, D(1957, 3, 4), e) for t, e in ends.items()]
    return sorted((x for x in out if x[2] is None or x[1] < x[2]), key=str)


def test_reconstruction_by_the_backward_walk(spark):
    rng = random.Random(4)
    now, changes, want = [], [], []
    for k in range(60):
        days = rng.sample(range(3000), 12)  # one change a day
        own = [(D(2000, 1, 1) + dt.timedelta(d), *(rng.choice([None, *"ABCD"]) for _ in range(2))) for d in days]
        own = [(d, a, None if r == a else r) for d, a, r in own]
        members = rng.sample("ABCD", rng.randint(0, 3))
        now += [(k, t) for t in members]
        changes += [(k, *c) for c in own]
        want += [(k, *x) for x in walked(members, own)]
    got = intervals.reconstruct(spark.createDataFrame(now, "k int, ticker string"), spark.createDataFrame(changes, "k int, day date, added string, removed string"), keys=["k"]).select("k", "ticker", "start_date", "end_date").collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_cells_over_very_many_rows(spark):
    """A cell over 2,500 rows and one beyond the standard's bound of columns, in a table of 3,000 rows."""
    lines = "".join(f"<tr>{'<td rowspan=2500>d</td>' if i == 1 else ''}<td>{i}</td><td rowspan='{1 + i % 3}'>x{i}</td></tr>" for i in range(1, 3000))
    page = f"<table><tr><th>a</th><th>b</th><th>c</th></tr>{lines}</table><table><tr><td colspan=100000>w</td></tr></table>"
    rows = {(r.table_no, r.row_no): r.cells for r in readers.html_rows(spark.createDataFrame([(1, page)], "k int, h string"), "k", "h").collect()}
    assert len(rows) == 3001 and rows[1, 0] == ["w"] * 1000
    assert all(rows[0, i][:2] == ["d", str(i)] for i in range(1, 2500) if "x" not in rows[0, i][1]) and rows[0, 2500][0] == "d" and "d" not in rows[0, 2501]
