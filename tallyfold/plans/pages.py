"""Queries over pages: text of HTML, submissions put together from pages, and membership from HTML tables to intervals."""

from __future__ import annotations

import html.entities

from pyspark.sql import functions as F

from ..functions.html import html_to_text
from ..operators import intervals
from ..sources import readers
from .studies import _UNI, query


def _text_sql(source: str, key: str, col: str) -> str:
    """CTEs that end in plain(key, plain), with the standard library's names as a table of their own."""
    names = ", ".join("('{}', '{}')".format(*(x.replace("'", "''") for x in pair)) for pair in html.entities.html5.items())
    bare = col
    for pattern in ("(?s)<!--.*?-->", "(?is)<script\\b[^>]*>.*?</script\\s*>", "(?is)<style\\b[^>]*>.*?</style\\s*>", "<![^>]*>", "</?[a-zA-Z](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>"):
        bare = f"regexp_replace({bare}, '{pattern}', ' ', 'g')"
    return f"""names(name, chars) AS (VALUES {names}),
pc AS (SELECT {key}, unnest(string_split({bare}, '&')) AS p, generate_subscripts(string_split({bare}, '&'), 1) AS i FROM {source}),
mk AS (SELECT *, CASE WHEN i > 1 THEN regexp_extract(p, '^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[A-Za-z][A-Za-z0-9]*;?)') ELSE '' END AS m FROM pc),
dm AS (SELECT DISTINCT m FROM mk WHERE m <> ''),
sh AS (SELECT m, max(length(name)) AS k, arg_max(chars, length(name)) AS short FROM dm JOIN names ON starts_with(m, name) AND NOT ends_with(name, ';') GROUP BY m),
dc AS (SELECT {key}, i, CASE WHEN i = 1 THEN p WHEN m = '' THEN '&' || p WHEN m[1] = '#' AND lower(m[2]) = 'x' THEN chr(CAST('0x' || rtrim(m[3:], ';') AS INTEGER)) || p[length(m) + 1:] WHEN m[1] = '#' THEN chr(CAST(rtrim(m[2:], ';') AS INTEGER)) || p[length(m) + 1:]
 WHEN chars IS NOT NULL THEN chars || p[length(m) + 1:] WHEN short IS NOT NULL THEN short || p[k + 1:] ELSE '&' || p END AS t FROM mk LEFT JOIN names ON name = m LEFT JOIN sh USING (m)),
wh AS (SELECT {key}, regexp_replace(replace(string_agg(t, '' ORDER BY i), chr(160), ' '), '[ \\t]+', ' ', 'g') AS t FROM dc GROUP BY {key}),
plain AS (SELECT {key}, trim(regexp_replace(array_to_string(list_transform(string_split(t, chr(10)), lambda x: trim(x, ' ' || chr(13) || chr(12))), chr(10)), '\\n{{3,}}', chr(10) || chr(10), 'g'), ' ' || chr(10)) AS plain FROM wh)
"""


@query("WITH " + _text_sql("pages", "page_id", "html") + "SELECT page_id, plain FROM plain")
def html_text(t):
    return t.raw("pages").select("page_id", html_to_text(F.col("html")).alias("plain"))


#: Pages with references of every form between their paragraphs.
_ODD = "&#8217; &ldquo;&#x20AC;&rdquo; &amp;lt; &notit; &copy2020 &Ouml;&euml &nosuch; A&B <i title=\"a > b\">x</i> &#160;&mdash;"


@query(f"""WITH o AS (SELECT page_id, replace(html, '</p>', ' {_ODD.replace("'", "''")}</p>') AS html FROM pages), """ + _text_sql("o", "page_id", "html") + "SELECT page_id, length(plain) AS n_chars, md5(plain) AS digest FROM plain")
def html_references(t):
    """Text of pages in which each paragraph ends in character references of every form."""
    page = F.replace("html", F.lit("</p>"), F.lit(f" {_ODD}</p>"))
    x = t.raw("pages").select("page_id", html_to_text(page).alias("plain"))
    return x.select("page_id", F.length("plain").alias("n_chars"), F.md5("plain").alias("digest"))


@query("WITH " + _text_sql("pages", "page_id", "html") + """SELECT page_id, '[8-K]' || chr(10) || plain || chr(10) || chr(10) || '[ex-99.2]' || chr(10) || '<b>' || url || '</b>' || chr(10) || chr(10) || '[EX-99.1]' || chr(10) || plain AS filed FROM plain JOIN pages USING (page_id) WHERE plain <> ''
UNION ALL SELECT page_id, '[ex-99.2]' || chr(10) || '<b>' || url || '</b>' FROM plain JOIN pages USING (page_id) WHERE plain = ''""")
def submission_texts(t):
    """Each page as the body and an exhibit of a submission, beside a text with markup in it, a picture and an empty exhibit."""
    doc = lambda kind, n, name, body: [F.lit(f"<DOCUMENT>\n<TYPE>{kind}\n<SEQUENCE>{n}\n<FILENAME>{name}\n<TEXT>"), body, F.lit("</TEXT>\n</DOCUMENT>\n")]
    page, url = F.coalesce("html", F.lit("")), F.concat(F.lit(" <b>"), "url", F.lit("</b>\n"))
    parts = [*doc("EX-99.1", "3", "x1.HTML", page), *doc("GRAPHIC", "4", "logo.jpg", F.lit("<p>noise")), *doc("8-K", "1", "d8k.htm", page), *doc("ex-99.2", "2", "x2.txt", url), *doc("EX-99.3", "", "x3.txt", F.lit(" \n"))]
    return t.raw("pages").select("page_id", readers.submission_text(F.concat(F.lit("<SEC-DOCUMENT>x\n"), *parts, F.lit("</SEC-DOCUMENT>"))).alias("filed"))


# membership


def universe_pages(t):
    """A page for each nation: a table of something else, its present members, and its changes under two rows of headings. A
    day with several changes has one cell over all their rows. Every fifth member has no row for its addition."""
    u = t.universe().withColumn("name", F.concat(F.lit("A &amp; B "), "ticker"))
    symbol = F.concat(F.lit("t."), F.col("ticker").cast("string"))
    td = lambda *x: F.concat(F.lit("<td>"), *x, F.lit("</td>"))
    tr = lambda *x: F.concat(F.lit("<tr>"), *x, F.lit("</tr>\n"))
    table = lambda heads, rows: F.concat(F.lit(f"<table class='wikitable'><tr>{heads}\n"), F.coalesce(F.array_join(F.array_sort(F.collect_list(rows)), ""), F.lit("")), F.lit("</table>\n"))
    now = u.where("end_date is null").groupBy("nation").agg(table("<th>Symbol</th><th>Security</th><th>CIK</th></tr>", tr(td(F.lit("<a href='#'>"), symbol, F.lit("</a>")), td("name"), td(F.lpad(F.col("ticker").cast("string"), 10, "0")))).alias("now"))
    added = u.where("ticker % 5 <> 0").select("nation", F.col("start_date").alias("day"), symbol.alias("add"), F.lit("").alias("remove"))
    removed = u.where("end_date is not null").select("nation", F.col("end_date").alias("day"), F.lit("").alias("add"), symbol.alias("remove"))
    days = added.unionByName(removed).groupBy("nation", "day").agg(F.array_sort(F.collect_list(F.concat(td("add"), td(F.lit("x")), td("remove"), td(F.lit("y"))))).alias("moves"))
    date = F.concat(F.lit("<td rowspan="), F.size("moves").cast("string"), F.lit(">"), F.date_format("day", "MMMM d, yyyy"), F.lit("</td>"))
    lines = F.array_join(F.transform("moves", lambda m, i: tr(F.when(i == 0, date).otherwise(F.lit("")), m)), "")
    heads = "<th rowspan='2'>Effective Date</th><th colspan=2>Added</th><th colspan=\"2\">Removed</th></tr><tr><th>Ticker</th><th>Security</th><th>Ticker</th><th>Security</th></tr>"
    moved = days.groupBy("nation").agg(table(heads, F.concat(F.lit("<!-- "), F.col("day").cast("string"), F.lit(" -->"), lines)).alias("moved"))
    pages = moved.join(now, "nation", "left")
    other = F.lit("<table><tr><th>Symbol</th><th>Price</th></tr><tr><td>ZZZ</td><td>1</td></tr></table>")
    return pages.select("nation", F.concat(F.lit("<html>"), other, F.coalesce("now", F.lit("")), "moved", F.lit("</html>")).alias("html"))


@query(
    _UNI + "SELECT nation, 'T-' || ticker AS ticker, CASE WHEN ticker % 5 = 0 OR end_date = start_date THEN DATE '1957-03-04' ELSE start_date END AS start_date, end_date FROM u"
)
def membership_from_pages(t):
    """Of a ticker added and removed on one day only the removal counts, as it stands first there: it closes an interval without a known start."""
    current, changes = readers.membership_pages(universe_pages(t), "nation", "html")
    return intervals.reconstruct(current, changes, keys=["nation"]).select("nation", "ticker", "start_date", "end_date")


@query(_UNI + "SELECT nation, 'T-' || ticker AS ticker, 'A & B ' || ticker AS name, ticker AS cik FROM u WHERE end_date IS NULL")
def members_from_pages(t):
    return readers.membership_pages(universe_pages(t), "nation", "html")[0]
