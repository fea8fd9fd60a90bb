"""Intermediate tables in the folder that the driver and the executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folders written and not deleted yet.
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master, whose tasks run on this machine, gets a temporary folder where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/tallyfold-{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet and read back: its lineage ends here."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def cleaned(spark: SparkSession) -> None:
    """Deletes what stored() wrote. To be called when the results that read it are written."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        p = jvm.org.apache.hadoop.fs.Path(_made.pop())
        p.getFileSystem(conf).delete(p, True)
