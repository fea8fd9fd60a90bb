"""Queries over keyed tables and one-pass ledgers that they write in the shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.returns import REASONS, net_return
from ..sources.sinks import RunManifest
from ..sources.tables import KeyedTable
from ..storage import new_path, stored
from .standins import BASE
from .studies import query, returns

_EVALUATED = BASE + """, pr AS (SELECT DISTINCT accession AS id FROM ev WHERE accession % 7 <> 0 AND probability BETWEEN 0.5 AND 1.0),
e1 AS (SELECT accession, horizon, raw, excess FROM ret WHERE reason IS NULL AND horizon < 20),
e2 AS (SELECT accession, horizon, raw, excess * 2 AS excess FROM ret WHERE reason IS NULL AND horizon > 1),
al AS (SELECT * FROM e2 UNION ALL SELECT * FROM e1 WHERE NOT EXISTS (SELECT 1 FROM e2 WHERE e2.accession = e1.accession AND e2.horizon = e1.horizon))
"""


@query(
    _EVALUATED + """SELECT 'evaluations' AS part, CAST(horizon AS VARCHAR) AS what, count(*) AS n, round(sum(excess - 0.001), 4) AS total FROM al JOIN pr ON id = accession GROUP BY horizon
UNION ALL SELECT 'rejected', 'prediction_id_without_predictions', count(*), NULL FROM e2 WHERE accession % 7 = 0 UNION ALL SELECT 'rejected', 'horizon', count(*), NULL FROM e2 WHERE accession % 7 <> 0 AND horizon = 20
UNION ALL SELECT 'rejected', 'entry_or_key', count(*), NULL FROM ev WHERE false HAVING count(*) > 0
UNION ALL SELECT 'predictions', 'immutable', count(*), NULL FROM pr UNION ALL SELECT 'predictions', 'probability', count(*), NULL FROM ev WHERE accession % 7 <> 0"""
)
def keyed_evaluations(t):
    """Evaluations of two runs under their keys, whose second run takes the place of the first where both have a row; some belong
    to no prediction, and some are written once more with a horizon that no rule allows. Predictions stay as first written."""
    r = returns(t).where("reason is null")
    ids = t.filings().where("accession % 7 <> 0")
    base = new_path(t.spark, "keyed")
    predictions = KeyedTable(t.spark, f"{base}/predictions", "predictions")
    p = ids.select(F.col("accession").alias("id"), F.col("accession").cast("string").alias("accession_no"), F.lit("m").alias("model_id"), F.lit("1").alias("prompt_version"), "direction", "probability", F.lit("because").alias("rationale"), F.lit(None).cast("timestamp").alias("created_at"), F.lit("historical").alias("run_mode"))
    predictions.upsert(p, "accession_no")
    predictions.upsert(p.unionByName(p.withColumn("id", -F.col("id")).withColumn("probability", F.lit(0.2))).withColumn("rationale", F.lit("changed")), "accession_no")
    evaluations = KeyedTable(t.spark, f"{base}/evaluations", "evaluations", {"predictions": predictions})
    e = stored(r.select(F.col("accession").alias("prediction_id"), "horizon", F.lit(None).cast("date").alias("entry_date"), F.lit(None).cast("date").alias("exit_date"), F.col("raw").alias("raw_return"), F.col("excess").alias("excess_return"), F.lit(10.0).alias("cost_bps")), "evaluated")
    net = lambda df: df.withColumn("net_return", net_return(F.col("excess_return"), 10))
    evaluations.upsert(net(e.where("horizon < 20")), "raw_return")
    second = net(e.where("horizon > 1").withColumn("excess_return", F.col("excess_return") * 2))
    evaluations.upsert(second.unionByName(second.where("horizon = 20 and prediction_id % 7 <> 0").withColumn("horizon", F.lit(-20))), "raw_return")
    count = F.count(F.lit(1)).alias("n")
    by = lambda df, part: df.groupBy("violation").agg(count).select(F.lit(part).alias("part"), F.col("violation").alias("what"), "n", F.lit(None).cast("double").alias("total"))
    kept = evaluations.read().groupBy("horizon").agg(count, F.round(F.sum("net_return"), 4).alias("total")).select(F.lit("evaluations").alias("part"), F.col("horizon").cast("string").alias("what"), "n", "total")
    return kept.unionByName(by(evaluations.rejected(), "rejected")).unionByName(by(predictions.rejected(), "predictions"))


@query(BASE + "SELECT coalesce(reason, 'written') AS what, count(*) AS n FROM ret GROUP BY ALL UNION ALL SELECT 'read', count(*) FROM ret")
def observed_ledger(t):
    """Returns written and exclusions counted in one pass over the events."""
    base = new_path(t.spark, "observed")
    with RunManifest(t.spark, "returns", f"{base}/manifest") as m:
        m.written(returns(t), f"{base}/rows", "reason", list(REASONS))
    found = t.spark.read.text(f"{base}/manifest").select(F.from_json("value", "counts map<string,long>, exclusions map<string,long>").alias("m"))
    return found.select(F.explode(F.map_concat("m.counts", "m.exclusions")).alias("what", "n"))
