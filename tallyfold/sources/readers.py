"""Sources: index files, filing headers, bars, membership, dictionaries and purchases, each with an explicit schema."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import universe_date
from ..functions.html import MARKUP, html_to_text, trimmed, unescaped
from ..functions.text import item_codes, looks_like_markup
from ..storage import stored

#: What the price vendor writes into a refusal that it sends with status 200.
QUOTA_MARKS = ("run over your", "symbol look up", "hourly request allocation", "upgrade at https://api.tiingo.com/pricing")


def master_index(lines: DataFrame, form: str = "8-K", column: str = "value") -> DataFrame:
    """Rows of a '|'-delimited index: exactly five fields, the form exactly, numbers and dates that parse; other lines are skipped."""
    parts = F.split(F.col(column), r"\|", -1)
    r = lines.where(F.size(parts) == 5).select(
        F.expr(f"try_cast(trim(split({column}, '[|]')[0]) as bigint)").alias("cik"), F.trim(parts[1]).alias("name"), F.trim(parts[2]).alias("form"),
        F.to_date(F.try_to_timestamp(F.trim(parts[3]), F.lit("yyyy-MM-dd"))).alias("filed"), F.trim(parts[4]).alias("path"),
    )
    return r.where((F.col("form") == form) & F.col("cik").isNotNull() & F.col("filed").isNotNull()).withColumn("accession_no", F.regexp_extract("path", r"([0-9-]{18,20})\.txt$", 1))


def filing_header(text: Column, zone: str = "America/New_York") -> Column:
    """Struct of accession_no, accepted_at (UTC), period, company, former names and documents of a submission header."""
    one = lambda p: F.nullif(F.trim(F.regexp_extract(text, p, 1)), F.lit(""))
    many = lambda p, g=1: F.regexp_extract_all(text, F.lit(p), F.lit(g))
    return F.struct(
        one(r"(?m)ACCESSION NUMBER:\s*(\S+)").alias("accession_no"),
        F.to_utc_timestamp(F.try_to_timestamp(one(r"(?m)ACCEPTANCE-DATETIME>\s*(\d{14})"), F.lit("yyyyMMddHHmmss")), zone).alias("accepted_at"),
        F.to_date(F.try_to_timestamp(one(r"(?m)CONFORMED PERIOD OF REPORT:\s*(\d{8})"), F.lit("yyyyMMdd"))).alias("period_of_report"),
        one(r"(?m)COMPANY CONFORMED NAME:\s*(.+)$").alias("company"),
        F.array_sort(F.array_distinct(F.transform(many(r"(?m)FORMER CONFORMED NAME:\s*(.+)$"), lambda x: F.trim(x)))).alias("former_names"),
        F.array_sort(F.array_distinct(F.transform(many(r"(?m)ITEM INFORMATION:\s*(.+)$"), lambda x: F.trim(x)))).alias("items"),
        item_codes(many(r"(?m)ITEM INFORMATION:\s*(.+)$")).alias("item_codes"),
        F.zip_with(F.transform(many(r"<TYPE>([^\n<]+)"), lambda x: F.trim(x)), F.transform(many(r"<SEQUENCE>([^\n<]+)"), lambda x: F.trim(x)), lambda t, s: F.struct(t.alias("type"), F.coalesce(s, F.lit("999")).alias("sequence"))).alias("documents"),
    )


def submission_text(text: Column) -> Column:
    """Texts of the main document and its EX-99 exhibits, by sequence as text, each under its type in brackets. Documents whose
    name and first characters say that they are markup are flattened; empty ones are left out."""
    docs = F.regexp_extract_all(text, F.lit(r"(?s)<DOCUMENT>(.*?)(?=<DOCUMENT>|</SEC-DOCUMENT>|\z)"), F.lit(1))
    field = lambda d, name: F.trim(F.regexp_extract(d, rf"<{name}>([^\r\n<]*)", 1))
    parts = F.transform(docs, lambda d, i: F.struct(F.coalesce(F.nullif(field(d, "SEQUENCE"), F.lit("")), F.lit("999")).alias("s"), i.alias("i"), field(d, "TYPE").alias("t"), field(d, "FILENAME").alias("f"), F.regexp_extract(d, r"(?s)<TEXT>(.*?)(?:</TEXT>|\z)", 1).alias("b")))
    kept = F.sort_array(F.filter(parts, lambda p: p["t"].rlike(r"(?i)^(8-K|EX-99(\.\d+)?)$")))
    flat = F.transform(kept, lambda p: F.struct(p["t"].alias("t"), F.when(looks_like_markup(p["f"], p["b"]), html_to_text(p["b"])).otherwise(trimmed(p["b"])).alias("b")))
    return F.array_join(F.transform(F.filter(flat, lambda p: p["b"] != ""), lambda p: F.concat(F.lit("["), p["t"], F.lit("]\n"), p["b"])), "\n\n")


def url_to_path(url: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(url, "^[a-z]+://", ""), r"[^A-Za-z0-9._/-]", "_")
    return F.regexp_replace(bare, r"\.\.+|/+$", "_")


def is_quota_error(body: Column) -> Column:
    head = F.lower(F.substring(F.coalesce(body, F.lit("")), 1, 400))
    return functools.reduce(Column.__or__, [F.contains(head, F.lit(m)) for m in QUOTA_MARKS])


def purged(cache: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """What a cache of bodies keeps, and the refusals that must be fetched again."""
    bad = is_quota_error(F.col(body))
    return cache.where(~bad), cache.where(bad)


#: Addresses of the archive.
ARCHIVE = "https://www.sec.gov/Archives"


def quarter_index_url(year: Column, quarter: Column) -> Column:
    return F.format_string(f"{ARCHIVE}/edgar/full-index/%d/QTR%d/master.idx", year, quarter)


def filing_dir_url(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit(f"{ARCHIVE}/edgar/data/"), cik.cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")))


def headers_url(cik: Column, accession: Column) -> Column:
    return F.concat(filing_dir_url(cik, accession), F.lit("/"), accession, F.lit("-index-headers.html"))


def submission_url(cik: Column, accession: Column) -> Column:
    return F.concat(filing_dir_url(cik, accession), F.lit("/"), accession, F.lit(".txt"))


def submission_bodies(text: Column) -> Column:
    """Map of file name to body of a submission's documents; of a name that repeats the last counts."""
    docs = F.regexp_extract_all(text, F.lit(r"(?s)<DOCUMENT>(.*?)(?=<DOCUMENT>|</SEC-DOCUMENT>|\z)"), F.lit(1))
    named = F.transform(docs, lambda d: F.struct(F.trim(F.regexp_extract(d, r"<FILENAME>([^\r\n<]*)", 1)).alias("key"), F.regexp_extract(d, r"(?s)<TEXT>(.*?)(?:</TEXT>|\z)", 1).alias("value")))
    last = F.filter(named, lambda x, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda y: y["key"] == x["key"]) & (x["key"] != ""))
    return F.map_from_entries(last)


def submission_company(body: Column) -> Column:
    """sic and description of a registrant's JSON."""
    return F.struct(F.get_json_object(body, "$.sic").alias("sic"), F.get_json_object(body, "$.sicDescription").alias("sic_description"))


def sample_accessions(spark: SparkSession, path: str) -> DataFrame:
    """The frozen ids of a sample file; a file without any raises, since it would select everything."""
    ids = spark.read.csv(path, header=True).select(F.trim("accession_no").alias("accession_no")).where("accession_no <> ''").distinct()
    if ids.isEmpty():
        raise ValueError(f"{path} names no accession")
    return ids


def trades(spark: SparkSession, table: str | None, bundle: str, schema: str) -> DataFrame:
    """Trades from the table where it exists, or else from the CSV bundle, in the same columns."""
    if table and spark.catalog.tableExists(table):
        names = [c.strip().split()[0] for c in schema.split(",")]
        return spark.table(table).select(*names)
    return spark.read.schema(schema).csv(bundle, header=True)


def zipped_tsv(spark: SparkSession, path: str, member: str, schema: str) -> DataFrame:
    """Rows of one tab-separated member of zip archives, a task for each archive, which streams its lines; row_no counts them
    from 0. Columns are found by the header's names; schema lists those wanted, all strings."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def read(batches):
        import csv
        import io
        import zipfile

        import pyarrow as pa

        for b in batches:
            for content in b.column(1):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z, z.open(member) as f:
                    rows = csv.reader(io.TextIOWrapper(f, encoding="utf-8", errors="replace"), delimiter="\t")
                    at = {c: i for i, c in enumerate(next(rows, []))}
                    held: list[list] = []
                    for n, row in enumerate(rows):
                        held.append([n, *(row[at[c]] if c in at and at[c] < len(row) else None for c in names)])
                        if len(held) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.int64() if not i else pa.string()) for i in range(len(names) + 1)], ["row_no", *names])
                            held = []
                    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], pa.int64() if not i else pa.string()) for i in range(len(names) + 1)], ["row_no", *names])

    return files.mapInArrow(read, "row_no long, " + ", ".join(f"{c} string" for c in names))


#: The HTML standard's bounds of rowspan and colspan.
MOST_ROWS, MOST_COLUMNS = 65_534, 1_000


def html_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, table_no, row_no, header (all its cells are headings) and cells (plain text) of every row of every table of HTML
    pages. A cell over several columns or rows stands in each of them; tables are not nested. Rows are parsed one by one, and
    cells over several rows are carried on in one pass down each page's tables."""
    plain = lambda c: F.trim(F.regexp_replace(unescaped(F.regexp_replace(c, MARKUP, " ")), r"(?U)\s+", " "))
    number = lambda c, name: F.nullif(F.regexp_extract(c, rf"(?i)^<t[hd]\b[^>]*\b{name}\s*=\s*[\"']?([0-9]{{1,18}})", 1), F.lit("")).cast("long")
    span = lambda c, name, most: F.greatest(F.least(F.coalesce(number(c, name), F.lit(1)), F.lit(most)), F.lit(1)).cast("int")
    tables = pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(r"(?is)<table\b[^>]*>(.*?)</table\s*>"), F.lit(1))).alias("table_no", "_t"))
    rows = tables.select(key, "table_no", F.posexplode(F.regexp_extract_all("_t", F.lit(r"(?is)<tr\b[^>]*>(.*?)(?=</tr\s*>|<tr\b|\z)"), F.lit(1))).alias("row_no", "_r"))
    rows = rows.withColumn("_r", F.regexp_extract_all("_r", F.lit(r"(?is)<t[hd]\b[^>]*>.*?(?=</t[hd]\s*>|<t[hd]\b|\z)"), F.lit(0)))
    header = (F.size("_r") > 0) & F.forall("_r", lambda c: F.lower(F.substring(c, 1, 3)) == "<th")
    cell = lambda c: F.array_repeat(F.struct(plain(c).alias("text"), (span(c, "rowspan", MOST_ROWS) - 1).alias("left")), span(c, "colspan", MOST_COLUMNS))
    own = rows.select(key, "table_no", "row_no", header.alias("header"), F.flatten(F.transform("_r", cell)).alias("_own"))
    own = own.select(key, "table_no", "row_no", "header", F.col("_own.text").alias("cells"), F.col("_own.left").alias("_left"))
    return own.mapInArrow(spread, own.drop("_left").schema)


def spread(batches):
    """Rows as html_rows makes them, in a page's order, with the cells of the rows above that reach into them."""
    import pyarrow as pa

    carry: list[tuple[str, int]] = []
    for b in batches:
        out = []
        for row_no, texts, left in zip(*(b.column(n).to_pylist() for n in ("row_no", "cells", "_left"))):
            carry = spread_row(carry if row_no else [], list(zip(texts, left)))
            out.append([c and c[0] for c in carry])
        held = {n: b.column(n) for n in b.schema.names if n != "_left"}
        yield pa.RecordBatch.from_pydict(held | {"cells": pa.array(out, pa.list_(pa.string()))})


def spread_row(above: list, own: list) -> list:
    """One step down a table: cells of the row above that reach this one keep their columns, the row's own fill the others."""
    width, rest = sum(1 for c in above if c and c[1] > 0) + len(own), iter(own)
    return [(above[i][0], above[i][1] - 1) if i < len(above) and above[i] and above[i][1] > 0 else next(rest, None) for i in range(width)]


def table_names(rows: DataFrame, key: str) -> DataFrame:
    """key, table_no and names of the columns of each table with headings at its top: of the heading rows above the first other
    row, parts that repeat collapse and the rest are joined by "_", in lower case with "_" for blanks."""
    top = rows.groupBy(key, "table_no").agg(F.min(F.when(~F.col("header"), F.col("row_no"))).alias("_first"), F.collect_list(F.when(F.col("header"), F.struct("row_no", "cells"))).alias("_heads"))
    heads = F.transform(F.filter(F.sort_array("_heads"), lambda h: F.col("_first").isNull() | (h["row_no"] < F.col("_first"))), lambda h: h["cells"])
    part = lambda h, j: F.trim(F.coalesce(F.get(h, j), F.lit("")))
    # a part that repeats the one above is the cell that reaches over both rows
    name = lambda j: F.aggregate(heads, F.expr("cast(array() as array<string>)"), lambda done, h: F.when((part(h, j) == "") | F.coalesce(F.get(done, F.size(done) - 1) == part(h, j), F.lit(False)), done).otherwise(F.concat(done, F.array(part(h, j)))))
    names = F.transform(F.sequence(F.lit(0), F.size(F.get(heads, F.lit(0))) - 1), lambda j: F.replace(F.lower(F.array_join(name(j), "_")), F.lit(" "), F.lit("_")))
    return top.where(F.exists("_heads", lambda h: F.col("_first").isNull() | (h["row_no"] < F.col("_first")))).select(key, "table_no", names.alias("names"))


def membership_pages(pages: DataFrame, key: str, html: str) -> tuple[DataFrame, DataFrame]:
    """Present members (key, ticker, name, cik) and changes (key, row_no, day, added, removed) of pages that list them. The
    first table with the columns symbol and security has the members; the first with a date and an added column the changes.
    Of several date columns the shortest counts. Rows without a date that parses, and empty or missing tickers, are left out."""
    names, cells = F.col("names"), F.col("cells")
    side = lambda n: n.startswith("added_") | n.startswith("removed_")
    dated = F.array_sort(F.filter(names, lambda n: F.contains(n, F.lit("date")) & ~side(n)), lambda a, b: F.length(a) - F.length(b))
    is_current = F.array_contains(names, "symbol") & F.array_contains(names, "security")
    is_changes = (F.size(dated) > 0) & F.exists(names, lambda n: n.startswith("added_"))
    place = lambda test: F.get(F.filter(F.transform(names, lambda n, i: F.when(test(n), i)), lambda i: i.isNotNull()), F.lit(0))
    move = lambda kind: place(lambda n: n.startswith(f"{kind}_") & F.contains(n, F.lit("ticker")))
    # few and long pages: each may go to a task of its own; rows are read four times
    spark = pages.sparkSession
    rows = stored(html_rows(pages.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), key), key, html), "page-rows")
    columns = {"symbol": place(lambda n: n == "symbol"), "security": place(lambda n: n == "security"), "cik": place(lambda n: n == "cik"), "date": place(lambda n: n == F.get(dated, F.lit(0))), "added": move("added"), "removed": move("removed")}
    heads = table_names(rows, key).select(key, "table_no", is_current.alias("is_current"), is_changes.alias("is_changes"), F.struct(*[c.alias(n) for n, c in columns.items()]).alias("at"))
    first = lambda role: heads.where(role).groupBy(key).agg(F.min_by(F.struct("table_no", "at"), "table_no").alias("_t")).select(key, "_t.*")
    body = rows.where("not header")
    cell = lambda name: F.get(cells, F.col(f"at.{name}"))
    ticker = lambda c: F.nullif(F.nullif(F.replace(F.upper(F.trim(c)), F.lit("."), F.lit("-")), F.lit("")), F.lit("NAN"))
    current = body.join(first("is_current"), [key, "table_no"]).select(key, ticker(cell("symbol")).alias("ticker"), cell("security").alias("name"), F.expr("try_cast(get(cells, at.cik) as bigint)").alias("cik"))
    changes = body.join(first("is_changes"), [key, "table_no"]).select(key, "row_no", universe_date(cell("date")).alias("day"), ticker(cell("added")).alias("added"), ticker(cell("removed")).alias("removed"))
    return current.where("ticker is not null"), changes.where("day is not null")


def bars_json(bodies: DataFrame, ticker: str = "ticker", body: str = "body") -> DataFrame:
    """A row for each bar of JSON lists; bodies that are an object (an error) or carry a quota notice give none."""
    shape = "array<struct<date:string,open:double,high:double,low:double,close:double,adjClose:double,volume:double>>"
    ok = bodies.where(F.ltrim(F.col(body)).startswith("[") & ~is_quota_error(F.col(body)))
    bar = ok.select(F.col(ticker).alias("ticker"), F.inline(F.from_json(body, shape)))
    return bar.select("ticker", F.to_date(F.substring("date", 1, 10)).alias("day"), "open", "high", "low", "close", F.col("adjClose").alias("adj_close"), "volume")


def membership_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ticker string, name string, cik long, start_date date, end_date date").csv(path, header=True, nullValue="")


def purchases(spark: SparkSession, path: str) -> DataFrame:
    """Rows with a date; tickers in upper case, a blank value counts as 0."""
    raw = spark.read.schema("issuer_cik long, ticker string, accession string, filing_date date, trans_date date, owner_cik string, role string, shares double, price double, value double, row_no long").csv(path, header=True)
    return raw.where("filing_date is not null").withColumn("ticker", F.upper("ticker")).withColumn("value", F.coalesce("value", F.lit(0.0)))


def dictionary(spark: SparkSession, path: str) -> DataFrame:
    """word, positive and negative; any number but 0 makes a member; a byte order mark is dropped."""
    raw = spark.read.schema("Word string, Negative int, Positive int").csv(path, header=True, enforceSchema=False)
    return raw.select(F.upper(F.regexp_replace("Word", "^﻿", "")).alias("word"), (F.col("Positive") != 0).alias("positive"), (F.col("Negative") != 0).alias("negative"))


def tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, sep="\t")


def tickers(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.upper(F.trim("value")).alias("ticker")).where("ticker <> ''")


def industry(rows: DataFrame, digits: int = 3) -> DataFrame:
    """ticker and the first digits of its code; of repeated tickers the last row wins."""
    return rows.groupBy("ticker").agg(F.max_by(F.substring("sic", 1, digits), "row_no").alias("sic3"))


def role(flags: Column) -> Column:
    low = F.lower(F.coalesce(flags, F.lit("")))
    return F.when(F.contains(low, F.lit("officer")), "officer").when(F.contains(low, F.lit("director")), "director").otherwise("other")
