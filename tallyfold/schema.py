"""Schemas of the tables and the rules that their rows keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VERSION = 1
TABLES = {
    "filings": "accession_no string not null, cik long, ticker string not null, accepted_at timestamp not null, period_of_report date, item_codes string, anonymized_text string, anon_version string",
    "universe": "ticker string not null, cik long, start_date date not null, end_date date",
    "prices": "ticker string not null, day date not null, open double, high double, low double, close double, adj_close double, volume double",
    "predictions": "id long not null, accession_no string not null, model_id string not null, prompt_version string not null, direction string, probability double, rationale string, created_at timestamp, run_mode string",
    "evaluations": "prediction_id long not null, horizon int not null, entry_date date, exit_date date, raw_return double, excess_return double, cost_bps double not null, net_return double",
}

#: Keys, foreign keys (column to parent table and its column), and tables whose rows are never changed.
KEYS = {"filings": ["accession_no"], "universe": ["ticker", "start_date"], "prices": ["ticker", "day"], "predictions": ["id"], "evaluations": ["prediction_id", "horizon", "cost_bps"]}
PARENTS = {"predictions": {"accession_no": ("filings", "accession_no")}, "evaluations": {"prediction_id": ("predictions", "id")}}
IMMUTABLE = {"predictions"}


def required(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table].split(", ") if c.endswith("not null")]


def rules(table: str) -> dict[str, Column]:
    """Name and condition of every check of a table; a null condition passes, as in SQL."""
    return {
        "predictions": {
            "direction": F.col("direction").isin("up", "down"),
            "probability": F.col("probability").between(0.5, 1.0),
            "run_mode": F.col("run_mode").isin("historical", "live"),
        },
        "universe": {"interval": F.col("end_date") > F.col("start_date")},
        "evaluations": {"horizon": F.col("horizon") > 0},
    }.get(table, {})


def violations(df: DataFrame, table: str) -> DataFrame:
    """df with the name of the first rule that each row breaks, null if it keeps all. First come the columns that may not be null."""
    broken = F.lit(None).cast("string")
    for name, ok in reversed(list(rules(table).items())):
        broken = F.when(F.coalesce(~ok, F.lit(False)), name).otherwise(broken)
    for c in reversed(required(table)):
        broken = F.when(F.col(c).isNull(), f"{c}_is_null").otherwise(broken) if c in df.columns else broken
    return df.withColumn("violation", broken)


def checked_version(found: int) -> int:
    if found > VERSION:
        raise ValueError(f"tables have version {found}, newer than {VERSION}")
    return VERSION
