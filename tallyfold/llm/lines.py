"""Line deduplication by distinct-site spread.

A line (trimmed, at least `min_chars` long) on `min_sites` or more distinct sites is boilerplate. HyperLogLog sketches of
sites are made for each line hash and salt and merged by aggregation; a line whose estimate lies within BAND of the
threshold gets an exact distinct count. Of each boilerplate line the occurrence in the smallest doc_id (first line of it)
stays, so that a text copied to many sites is not lost from all of them; the others go. `keep_first=False` removes all.

Lines are hashed once into a table that the three passes over them read; texts are not split again before lines go. A line
ends at LF only and only blanks are trimmed, so a line that ends in CRLF differs from the same line that ends in LF.

Lines that occur on one site only, or fewer than min_sites times, get no sketch: they cannot reach the threshold.
Line hashes have 128 bits. Defined cases: null text is empty; a null site is no site; a null doc_id sorts after every
other; rows repeated with the same doc_id and text are treated alike; ties of doc_id between different texts are broken by
the text's hash; an empty table gives an empty result; other columns are ignored (deduplicated() keeps those of documents).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

MIN_SITES, MIN_CHARS, LG_K, BAND, SALTS = 5, 20, 12, 0.2, 16


def with_keys(docs: DataFrame, id_col: str, text_col: str, site_col: str) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    return docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), docs[site_col].cast("string").alias("site")).withColumn("th", F.xxhash64("text"))


def line_table(d: DataFrame, min_chars: int) -> DataFrame:
    lines = d.select("doc_id", "th", "site", F.posexplode(F.split("text", "\n", -1)).alias("n", "line"))
    lines = lines.withColumn("line", F.trim("line")).where(F.length("line") >= min_chars)
    return lines.select("doc_id", "th", "site", "n", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit("line"), "line").alias("h2"))


def boilerplate(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """h1, h2 and keeper (struct) of each line that is on min_sites distinct sites or more."""
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "th", "n")
    spread = lines.groupBy("h1", "h2").agg(F.min("site").alias("a"), F.max("site").alias("b"), F.count("site").alias("times"), F.min(place).alias("keeper"))
    possible = spread.where(F.col("times") >= min_sites)
    if min_sites > 1:
        possible = possible.where("a < b")
    possible = stored(possible.select("h1", "h2", "keeper"), "lines")
    known = lines.where("site is not null").join(possible, ["h1", "h2"], "left_semi")
    sketches = known.groupBy("h1", "h2", F.pmod(F.col("th"), F.lit(SALTS)).alias("salt")).agg(F.hll_sketch_agg("site", LG_K).alias("sketch"))
    estimates = stored(sketches.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("sites")), "estimates")
    near = (F.col("sites") >= (1 - BAND) * min_sites - 1) & (F.col("sites") <= (1 + BAND) * min_sites + 1)
    exact = known.join(estimates.where(near), ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("sites"))
    over = estimates.where(~near & (F.col("sites") >= min_sites)).select("h1", "h2").unionByName(exact.where(F.col("sites") >= min_sites).select("h1", "h2"))
    return possible.join(over, ["h1", "h2"])


def removals(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source") -> DataFrame:
    """r_id, r_th (hash of the text) and gone, the numbers of the lines to remove, for the documents that have any."""
    d = with_keys(docs, id_col, text_col, site_col)
    lines = stored(line_table(d, min_chars), "hashed")
    found = stored(boilerplate(lines, min_sites), "boilerplate")
    at = lines.join(found, ["h1", "h2"])
    if keep_first:
        k = F.col("keeper")
        at = at.where(~(F.col("doc_id").eqNullSafe(k["doc_id"]) & (F.col("th") == k["th"]) & (F.col("n") == k["n"])))
    return at.groupBy(F.col("doc_id").alias("r_id"), F.col("th").alias("r_th")).agg(F.collect_set("n").alias("gone"))


def kept_text(text, gone):
    """The text without the lines numbered in gone: the stretches between them, each cut out once, so that a text of many lines
    and many removals takes time in proportion to both. The lines are bound by a list of one, or every stretch would split
    the text again."""
    gone = F.sort_array(gone)
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda n: n + 1))

    def stretches(lines):
        ends = F.concat(gone, F.array(F.size(lines)))
        return F.flatten(F.zip_with(starts, ends, lambda a, z: F.slice(lines, a + 1, z - a)))

    kept = F.get(F.transform(F.array(F.split(text, "\n", -1)), stretches), F.lit(0))
    return F.when(gone.isNull(), text).otherwise(F.array_join(kept, "\n"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """docs with the lines removed from text; all columns and rows stay. Other names than those of documents: see removals()."""
    gone = removals(docs, **how)
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    out = docs.join(gone, docs["doc_id"].cast("long").eqNullSafe(gone.r_id) & (F.xxhash64(text) == gone.r_th), "left")
    return out.select(*[F.when(gone.gone.isNull(), docs["text"]).otherwise(kept_text(text, gone.gone)).alias("text") if c == "text" else docs[c] for c in docs.columns])


def line_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, n_lines, n_removed and text_sha256 of what remains."""
    gone = removals(docs, **how)
    d = with_keys(docs, how.get("id_col", "doc_id"), how.get("text_col", "text"), how.get("site_col", "source"))
    out = d.join(gone, d.doc_id.eqNullSafe(gone.r_id) & (d.th == gone.r_th), "left")
    return out.select(
        "doc_id",
        F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size(F.when(F.col("gone").isNotNull(), F.col("gone"))), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(kept_text(F.col("text"), F.col("gone")), 256).alias("text_sha256"),
    )
