"""Sinks: keyed overwrite, append-only log, bundles, texts, ticker lists and the manifest of a run."""

from __future__ import annotations

import datetime
import json
import subprocess
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..operators.intervals import append_new, first_by


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The union's latest row of each key. Write it to a new folder and switch: a lost task never leaves half a table."""
    return first_by(old.unionByName(new), keys, F.desc(order))


def append_log(new: DataFrame, path: str, keys: list[str], old: DataFrame | None = None) -> None:
    (new if old is None else append_new(new, old, keys)).write.mode("append").parquet(path)


def bundle_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)


def bundle_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replaced(df: DataFrame, path: str) -> None:
    """Delete everything and insert: the new table takes the place of the old one."""
    df.write.mode("overwrite").parquet(path)


def write_texts(df: DataFrame, path: str) -> None:
    """Extracted texts by year and accession: a folder for each year, a row for each filing."""
    df.select("accession_no", "accepted_at", "text").withColumn("year", F.year("accepted_at")).write.mode("overwrite").partitionBy("year").parquet(path)


def write_tickers(events: DataFrame, path: str) -> None:
    """Distinct tickers in order, one on a line."""
    events.select("ticker").where("ticker is not null").distinct().orderBy("ticker").write.mode("overwrite").text(path)


class RunManifest:
    """What a run did, counted and excluded, written as JSON to any store that Spark reaches, also when the run fails."""

    def __init__(self, spark: SparkSession, name: str, path: str, **parameters):
        self.spark, self.path = spark, path
        self.content = {"name": name, "parameters": parameters, "commit": commit(), "counts": {}, "exclusions": {}, "examples": {}}

    def count(self, name: str, n: int = 1) -> None:
        self.content["counts"][name] = self.content["counts"].get(name, 0) + n

    def add_ledger(self, ledger: DataFrame, examples: str | None = None) -> None:
        """Rows (reason, n) of a waterfall, as many as there are reasons."""
        for r in ledger.collect():
            self.content["exclusions"][r["reason"]] = self.content["exclusions"].get(r["reason"], 0) + r["n"]
            if examples:
                self.content["examples"].setdefault(r["reason"], list(r[examples] or []))

    def written(self, df: DataFrame, path: str, reason: str, reasons: list[str]) -> None:
        """Writes the rows without a reason, and counts what was written and what each reason kept out in the same pass: the
        counts ride along as observed metrics of the one job. A reason that is not listed counts as "other"."""
        seen = Observation()
        listed = {f"r{i}": F.count_if(F.col(reason) == r) for i, r in enumerate(reasons)}
        metrics = {**listed, "written": F.count_if(F.col(reason).isNull()), "every": F.count(F.lit(1))}
        df.observe(seen, *[m.alias(k) for k, m in metrics.items()]).where(F.col(reason).isNull()).drop(reason).write.mode("overwrite").parquet(path)
        got = seen.get
        self.count("read", got["every"])
        self.count("written", got["written"])
        kept_out = {r: got[f"r{i}"] for i, r in enumerate(reasons)}
        kept_out["other"] = got["every"] - got["written"] - sum(kept_out.values())
        for r, n in kept_out.items():
            if n:
                self.content["exclusions"][r] = self.content["exclusions"].get(r, 0) + n

    def __enter__(self) -> RunManifest:
        self.content["started_at"] = datetime.datetime.now(datetime.UTC).isoformat()
        return self

    def __exit__(self, kind, error, trace) -> bool:
        self.content |= {"ended_at": datetime.datetime.now(datetime.UTC).isoformat(), "failed": repr(error) if error else None}
        self.spark.createDataFrame([(json.dumps(self.content, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(self.path)
        return False


def commit() -> str | None:
    """The commit of this code, with + where it has changes; None outside a repository."""
    at = Path(__file__).resolve().parent
    git = lambda *a: subprocess.run(["git", "-C", str(at), *a], capture_output=True, text=True, check=True).stdout.strip()
    try:
        return git("rev-parse", "HEAD") + ("+" if git("status", "--porcelain") else "")
    except (OSError, subprocess.CalledProcessError):
        return None
