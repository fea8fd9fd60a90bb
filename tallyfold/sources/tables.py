"""Keyed tables in a folder, with their rules kept at every write.

A table is a row of immutable snapshots, one folder each, and a pointer: a small file that names the snapshot that counts and
is put in place by one rename. A write makes the next snapshot beside the old one and then moves the pointer, so a reader sees
the table before or after, and a job that is lost in between leaves the old table whole. One writer at a time.

Rows that break a rule do not stop a write: they go to the snapshot's rejected rows with the first rule that they break, in
this order: a column that may not be null, a check of the schema, a parent that is missing, and, in a table that never changes
a row, a key that is there already. Of new rows with one key the last by `order` counts; ties need a total order.

Keys of a table grow with it, and its files are far smaller than they are: keys meet by sorting, none go to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema
from ..operators.intervals import first_by


class KeyedTable:
    """parents: table name to KeyedTable or DataFrame for the foreign keys that the schema names."""

    def __init__(self, spark: SparkSession, path: str, name: str, parents: dict | None = None):
        self.spark, self.path, self.name, self.parents = spark, path.rstrip("/"), name, parents or {}
        self.keys = schema.KEYS[name]
        self.ddl = schema.TABLES[name].replace(" not null", "")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The snapshot that counts; 0: none yet. Of several pointers, left by a lost job, the newest is the one."""
        path, fs = self._fs()
        if not fs.exists(path(self.path)):
            return 0
        found = [f.getPath().getName() for f in fs.listStatus(path(self.path))]
        return max([0, *(int(n.removeprefix("current-")) for n in found if n.startswith("current-"))])

    def at(self, version: int | None = None, part: str = "rows") -> str:
        return f"{self.path}/snapshot-{self.version() if version is None else version}/{part}"

    def read(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(self.ddl).parquet(self.at(v)) if v else self.spark.createDataFrame([], self.ddl)

    def rejected(self) -> DataFrame:
        """Rows that the last write turned away, with violation."""
        v = self.version()
        return self.spark.read.schema(f"{self.ddl}, violation string").parquet(self.at(v, "rejected")) if v else self.spark.createDataFrame([], f"{self.ddl}, violation string")

    def judged(self, new: DataFrame) -> DataFrame:
        """new in the table's columns, with the first rule that each row breaks."""
        typed = new.select(*[F.col(c).cast(t).alias(c) for c, t in (x.split()[:2] for x in schema.TABLES[self.name].split(", "))])
        out = schema.violations(typed, self.name)
        for own, (parent, key) in schema.PARENTS.get(self.name, {}).items():
            if parent in self.parents:
                p = self.parents[parent]
                there = (p.read() if isinstance(p, KeyedTable) else p).select(F.col(key).alias("_parent")).distinct().withColumn("_there", F.lit(True)).hint("merge")
                out = out.join(there, F.col(own) == F.col("_parent"), "left").withColumn("violation", F.coalesce("violation", F.when(F.col(own).isNotNull() & F.col("_there").isNull(), f"{own}_without_{parent}"))).drop("_parent", "_there")
        return out

    def upsert(self, new: DataFrame, *order: str | Column) -> int:
        """Puts rows in, those with a key that is there in the place of the old ones; in a table of the append-only kind these are
        rejected instead. Returns the version of the new snapshot."""
        old, version = self.read(), self.version() + 1
        judged = self.judged(new)
        good = first_by(judged.where("violation is null").drop("violation"), self.keys, *order)
        bad = judged.where("violation is not null")
        there = old.select(*self.keys).hint("merge")
        if self.name in schema.IMMUTABLE:
            bad = bad.unionByName(good.join(there, self.keys, "left_semi").withColumn("violation", F.lit("immutable")))
            rows = old.unionByName(good.join(there, self.keys, "left_anti").select(*old.columns))
        else:
            rows = old.join(good.select(*self.keys).hint("merge"), self.keys, "left_anti").select(*old.columns).unionByName(good.select(*old.columns))
        return self._put(version, rows, bad)

    def replace(self, new: DataFrame, *order: str | Column) -> int:
        """Delete everything and insert."""
        if self.name in schema.IMMUTABLE:
            raise ValueError(f"rows of {self.name} are never changed or deleted")
        judged = self.judged(new)
        good = first_by(judged.where("violation is null").drop("violation"), self.keys, *order)
        return self._put(self.version() + 1, good, judged.where("violation is not null"))

    def _put(self, version: int, rows: DataFrame, bad: DataFrame) -> int:
        rows.write.mode("overwrite").parquet(self.at(version))  # over what a lost job left
        bad.write.mode("overwrite").parquet(self.at(version, "rejected"))
        path, fs = self._fs()
        fs.create(path(f"{self.path}/next-{version}"), True).close()
        if not fs.rename(path(f"{self.path}/next-{version}"), path(f"{self.path}/current-{version}")):
            raise RuntimeError(f"{self.path}: another writer made version {version}")
        for v in range(version - 2, 0, -1):  # readers of the last version may go on
            if not any([fs.delete(path(f"{self.path}/snapshot-{v}"), True), fs.delete(path(f"{self.path}/current-{v}"), False)]):
                break
        return version
