"""Contamination audit, scoring costs and the comparison of models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import stats, text

THRESHOLD = 0.2


def parsed_guess(raw: Column) -> Column:
    """Struct (company, ticker, confidence) of an answer from its first brace to its end, and failed: whatever is not JSON as
    a whole, so also text behind the object, fails. An answer without a brace is empty, not failed."""
    start = F.instr(raw, "{")
    rest = F.substring(raw, start, F.length(raw))
    # the parser stops behind the first value: in a list, what follows the object breaks it, and a second value shows
    listed = F.when(F.rtrim(rest).endswith("}"), F.try_parse_json(F.concat(F.lit("["), rest, F.lit("]"))))
    whole = F.when((start > 0) & F.try_variant_get(listed, "$[1]", "variant").isNull(), listed)
    field = lambda name: F.try_variant_get(whole, f"$[0].{name}", "string")
    return F.struct(field("company").alias("company"), field("ticker").alias("ticker"), field("confidence").alias("confidence"), ((start > 0) & whole.isNull()).alias("failed"))


def is_correct(company: Column, ticker: Column, true_ticker: Column, true_name: Column) -> Column:
    """The ticker exactly, or the normal company name, or any distinctive word of it; 'unknown' is no guess."""
    company, ticker = F.coalesce(company, F.lit("")), F.coalesce(ticker, F.lit(""))
    by_name = (text.normalise_company(company) == text.normalise_company(true_name)) | F.arrays_overlap(text.name_words(company), text.name_words(true_name))
    return (
        F.when((company == "") & (ticker == ""), False)
        .when((ticker != "") & (F.upper(F.trim(ticker)) == F.upper(F.trim(true_ticker))), True)
        .when((company == "") | (F.lower(F.trim(company)) == "unknown"), False)
        .otherwise(F.coalesce(by_name, F.lit(False)))
    )


def identification(audited: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of audited (correct, failed): attempted, identified, parse_failures, rate to four digits, exceeds_threshold."""
    n = F.count(F.lit(1))
    hits = F.coalesce(F.sum(F.col("correct").cast("long")), F.lit(0))
    rate = F.when(n > 0, hits / n).otherwise(0.0)
    return audited.agg(n.alias("attempted"), hits.alias("identified"), F.coalesce(F.sum(F.col("failed").cast("long")), F.lit(0)).alias("parse_failures"), F.round(rate, 4).alias("identification_rate"), (rate > threshold).alias("exceeds_threshold"))


def unidentified(rows: DataFrame, audited: DataFrame, key: str) -> DataFrame:
    """What a report is repeated on when identification exceeds the threshold."""
    return rows.join(audited.where("correct").select(key).distinct(), key, "left_anti")


def scoring_cost(calls: DataFrame, keys: list[str], input_per_mtok: float, output_per_mtok: float) -> DataFrame:
    """calls (input_tokens, output_tokens, failed): cost in dollars, by call too, and the share of failures to five digits."""
    n = F.count(F.lit(1))
    cost = F.sum("input_tokens") / 1_000_000 * input_per_mtok + F.sum("output_tokens") / 1_000_000 * output_per_mtok
    return calls.groupBy(*keys).agg(n.alias("calls"), cost.alias("cost_usd"), (cost / n).alias("cost_per_filing"), F.round(F.avg(F.col("failed").cast("double")), 5).alias("parse_failure_rate"))


def head_to_head(rows: DataFrame, keys: list[str], book: DataFrame) -> DataFrame:
    """For each model (keys) hit rate and Brier score of rows (probability, correct) beside its book's statistics."""
    from .calibration import scores

    return scores(rows, keys, "probability", "correct").join(stats.book_stats(book, keys, "month", "book"), keys, "left")
