"""The live clusters against the batch operator, over a restart."""

import datetime as dt
import random

from pyspark.sql import functions as F

from tallyfold.operators import clusters
from tallyfold.streaming.clusters import live_clusters

SCHEMA = "ticker string, day date, row_no long, owner string, value double"


def test_stream_and_batch_agree_over_a_restart(spark, tmp_path):
    rng = random.Random(3)
    start = dt.date(2018, 1, 1)
    rows = sorted(((rng.choice("abc"), start + dt.timedelta(rng.randint(0, 300)), i, rng.choice(["o1", "o2", "o3", None]), float(rng.randint(1, 50))) for i in range(400)), key=lambda r: r[1])
    # files a few days out of order, within the delay; the last row only moves the watermark
    parts = [rows[k : k + 80] for k in range(0, 400, 80)]
    parts = [p[3:] + q[:3] if q else p[3:] for p, q in zip(parts, parts[1:] + [[]])]
    parts[0] = rows[:3] + parts[0]
    parts[-1] = parts[-1] + [("z", start + dt.timedelta(2000), 999, "o", 0.0)]
    found = []
    for k, p in enumerate(parts):  # a new start from the checkpoint for each file
        spark.createDataFrame(p, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
        q = live_clusters(stream, 2, 40.0, 30, 30, "20 days").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        found.append(spark.read.schema("ticker string, day date, row_no long, n_owners int, total_value double").parquet(str(tmp_path / "out")).count())
    want = clusters.cluster_events(spark.createDataFrame(rows, SCHEMA), 2, 40.0, 30, 30)
    got = spark.read.parquet(str(tmp_path / "out"))
    key = lambda df: sorted((r.ticker, r.day, r.row_no, r.n_owners, round(r.total_value, 4)) for r in df.select("ticker", "day", "row_no", F.col("n_owners").cast("int"), "total_value").collect())
    assert key(got) == key(want) and len(key(want)) > 5
    assert 0 < found[1] < found[-1]  # rows came out before the end
