"""Helpers that the corpus operators share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master, whose tasks run on this machine,
    gets a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tallyfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Folders that this process has made and not deleted yet, and tables over them.
_made: list[str] = []
_tables: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/tallyfold-{name}-{uuid.uuid4().hex[:12]}")
    return _made[-1]


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    freed(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """df written once as a table bucketed by its keys: joins on them move the other side only. df: dealt out by the keys."""
    spark = df.sparkSession
    _tables.append(f"tallyfold_{name}_{uuid.uuid4().hex[:12]}")
    df.write.bucketBy(partitions(spark), *keys).format("parquet").option("compression", "zstd").option("path", new_path(spark, name)).saveAsTable(_tables[-1])
    freed(spark)
    return spark.table(_tables[-1])


def freed(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of steps whose results are stored: it acts when the driver collects garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder, when nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    if path in _made:
        _made.remove(path)


def discarded(*frames: DataFrame) -> None:
    """Deletes what stored() wrote for these frames; what was derived from them must be stored already. Others stay as they are."""
    for df in frames:
        if path := getattr(df, "stored_at", None):
            removed(df.sparkSession, path)


def made() -> list[str]:
    """Folders and tables of intermediate results that this process has made and not deleted."""
    return [*_tables, *_made]


def cleaned(spark: SparkSession, names: list[str] | None = None) -> None:
    """Deletes the named folders and tables of intermediate results, or all. To be called when what reads them is stored."""
    for name in [n for n in _tables if names is None or n in names]:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        _tables.remove(name)
    for path in [p for p in _made if names is None or p in names]:
        removed(spark, path)


def id_and_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just doc_id (long) and text (string, null read as empty); any other column, whatever its name, stays out."""
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))


def partitions(spark: SparkSession, factor: int = 1) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) * factor)


def numbered(df: DataFrame, order: list[Column | str], name: str, group: str | None = None) -> DataFrame:
    """df with the column pos: a row's place, from 0, under the order, within its group if one is named. Rows that are equal
    under the order stand in any order. Ranges of the whole order are sorted apart and stored, and the counts of the ranges
    before are added: no task sees a whole group. group: a column without nulls."""
    keys = [group] if group else []
    spread = df.repartitionByRange(partitions(df.sparkSession), *keys, *order).sortWithinPartitions(*keys, *order)
    marked = stored(spread.withColumn("_row", F.monotonically_increasing_id()), name)
    part = F.shiftrightunsigned("_row", 33).alias("_part")
    ends = marked.groupBy(part, *keys).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    ends = stored(ends.select("_part", *keys, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift")), f"{name}-ranges")
    return marked.withColumn("_part", part).join(ends, ["_part", *keys]).select(*df.columns, (F.col("_row") + F.col("_shift")).alias("pos"))
