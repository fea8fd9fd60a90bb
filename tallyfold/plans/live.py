"""Live queries: purchases that arrive in two parts, with the stream stopped between them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..storage import new_path
from ..streaming.clusters import live_clusters as clusters_of
from .studies import _CLUSTERS_SQL, query

#: The day on which the stream is stopped and started again, and one after all purchases.
STOP, END = "1998-07-01", "2100-01-01"


@query(_CLUSTERS_SQL)
def live_clusters(t):
    """The clusters of purchase_clusters, from a stream that goes on from its checkpoint. A last row, of no ticker, lets the
    watermark pass all days."""
    inbox, state, out = (new_path(t.spark, n) for n in ("inbox", "state", "clusters"))
    p = t.purchases().select(F.col("ticker").cast("string").alias("ticker"), "day", "row_no", F.col("owner").cast("string").alias("owner"), "value")
    last = t.spark.range(1).select(F.lit("").alias("ticker"), F.lit(END).cast("date").alias("day"), F.lit(0).cast("long").alias("row_no"), F.lit("").alias("owner"), F.lit(0.0).alias("value"))
    for part in (p.where(F.col("day") < STOP), p.where(F.col("day") >= STOP).unionByName(last)):
        part.write.mode("append").parquet(inbox)
        stream = clusters_of(t.spark.readStream.schema(p.schema).parquet(inbox), 3, 500_000.0)
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
    found = t.spark.read.schema("ticker string, day date, row_no long, n_owners int, total_value double").parquet(out)
    return found.withColumn("ticker", F.col("ticker").cast("long"))
