"""Exact duplicates through a log-structured merge index of digests, in DataFrame operations only.

Memtables: every scan task sorts the digests of its rows and flushes them as one file, without a shuffle; a flush deals its
tasks out over FANOUT runs of level 0. Compaction: as soon as a level holds FANOUT runs, they are merged by digest into one
run of the next level, which keeps for each digest the smallest identifier under the order (most code points, smallest
doc_id) and the number of entries; so an entry is merged once a level, however many flushes follow. What is left in several
levels is merged when the index is read. Filters: the merged index has for each digest that occurs twice its bits in a
blocked filter of FILTER_BLOCKS bitmaps of 32,768 bits, 16 MB in all whatever the corpus, which is broadcast. An entry that
the filter does not know occurs once and is answered at once; the others, hits and few false positives, are looked up in
the merged index. Hits receive byte verification: the least and the greatest text under a digest that occurs twice must be
equal. Were two texts to share a digest, the index is rebuilt on a wider one.

A filter that is too full, beyond some 30 million different repeated texts, knows more than it should: then more entries are
looked up, and nothing else changes. A digest with very many entries is one row of the merged index, and the entries that
look it up are split by Spark's skew join.

Defined cases: a null text is empty, and all empty texts are equal; a null doc_id sorts after every other; of rows
repeated with the same doc_id exactly one stays; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discarded, id_and_text, new_path, stored

#: Characters that do not count when texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
#: Runs of a level that are merged into one of the next.
FANOUT = 4
#: Bitmaps of the filter, bits of one (that of Spark's bitmap functions), and bits that a digest sets.
FILTER_BLOCKS, BITMAP, PROBES = 4096, 32_768, 3


def normalised(text):
    return F.regexp_replace(text, BLANKS, "")


def block_of(digest: Column) -> Column:
    return F.pmod(F.xxhash64(digest), F.lit(FILTER_BLOCKS))


def bits_of(digest: Column) -> list[Column]:
    return [F.pmod(F.xxhash64(digest, F.lit(i)), F.lit(BITMAP)) for i in range(PROBES)]


def filter_of(digests: DataFrame) -> DataFrame:
    """f_block and bitmap of the column digest."""
    return digests.select(block_of(F.col("digest")).alias("f_block"), F.explode(F.array(*bits_of(F.col("digest")))).alias("bit")).groupBy("f_block").agg(F.bitmap_construct_agg("bit").alias("bitmap"))


def known(bitmap: Column, digest: Column) -> Column:
    """Whether all bits of the digest are set; a missing bitmap has none."""
    one = lambda bit: F.conv(F.hex(F.substring(bitmap, (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (bit % 8 + 1).cast("int"))) != 0
    return F.coalesce(functools.reduce(Column.__and__, [one(b) for b in bits_of(digest)]), F.lit(False))


class DigestIndex:
    """digest_bytes: leading bytes of the digest that entries are keyed by; fewer than all only to provoke collisions in tests."""

    def __init__(self, spark: SparkSession, digest_bytes: int = 32, wide: bool = False):
        self.spark, self.digest_bytes, self.wide = spark, digest_bytes, wide
        self.batches: list[tuple[str, DataFrame]] = []
        self.levels: dict[int, list[DataFrame]] = {}

    def digests(self, docs: DataFrame) -> DataFrame:
        """doc_id, points, norm, sha and the key of every row. wide: SHA-512 follows SHA-256 in the key."""
        d = id_and_text(docs).select("doc_id", F.length("text").cast("long").alias("points"), normalised(F.col("text")).alias("norm"))
        sha = F.unhex(F.sha2("norm", 256))
        key = F.concat(sha, F.unhex(F.sha2("norm", 512))) if self.wide else F.substring(sha, 1, self.digest_bytes)
        return d.select("doc_id", "points", "norm", sha.alias("sha"), key.alias("digest"))

    def flush(self, docs: DataFrame) -> None:
        """Writes the memtables of a batch as FANOUT runs of level 0 and compacts. No shuffle before the merge."""
        path = new_path(self.spark, "runs")
        row = F.monotonically_increasing_id()
        (
            self.digests(docs)
            .select(row.alias("row"), F.lit(len(self.batches)).alias("batch"), "doc_id", "points", "sha", "digest", (F.spark_partition_id() % FANOUT).alias("run"))
            .sortWithinPartitions("run", "digest")
            .write.partitionBy("run")
            .parquet(path)
        )
        self.batches.append((path, docs))
        entry = F.struct((-F.col("points")).alias("less"), F.col("doc_id").isNull().alias("last"), "doc_id", "batch", "row")
        for run in range(FANOUT):
            self.add(0, self.entries_of(path).where(F.col("run") == run).select("digest", entry.alias("keep"), F.lit(1).cast("long").alias("size")))

    def entries_of(self, path: str) -> DataFrame:
        return self.spark.read.schema("row long, batch int, doc_id long, points long, sha binary, digest binary, run int").parquet(path)

    def add(self, level: int, run: DataFrame) -> None:
        """Puts a run into a level; a full level goes into the next as one run."""
        self.levels.setdefault(level, []).append(run)
        if len(self.levels[level]) == FANOUT:
            full, self.levels[level] = self.levels[level], []
            merged = stored(self.merged(full), f"level{level + 1}")
            discarded(*full)
            self.add(level + 1, merged)

    @staticmethod
    def merged(runs: list[DataFrame]) -> DataFrame:
        every = functools.reduce(DataFrame.unionByName, runs)
        return every.groupBy("digest").agg(F.min("keep").alias("keep"), F.sum("size").alias("size")).sortWithinPartitions("digest")

    def compact(self) -> DataFrame:
        """The only run that is left when all levels are merged."""
        runs = [r for _, level in sorted(self.levels.items()) for r in level]
        if len(runs) > 1:
            deepest = max(self.levels) + 1
            self.levels = {deepest: [stored(self.merged(runs), f"level{deepest}")]}
            discarded(*runs)
            runs = self.levels[deepest]
        return runs[0]

    def collided(self, repeated: DataFrame) -> bool:
        """Byte verification of the hits: of the texts under a digest that occurs twice, the least and the greatest are equal.
        Texts that the filter does not know stay where they are."""
        found = []
        for _, docs in self.batches:
            d = self.digests(docs).select("digest", "norm").withColumn("f_block", block_of(F.col("digest")))
            found.append(d.join(F.broadcast(repeated), "f_block").where(known(F.col("bitmap"), F.col("digest"))).select("digest", "norm"))
        ends = functools.reduce(DataFrame.unionByName, found).groupBy("digest").agg(F.min("norm").alias("least"), F.max("norm").alias("greatest"))
        return not ends.where("least <> greatest").isEmpty()

    def result(self) -> DataFrame:
        """One row for each entry: doc_id, keep_id, group_size, kept, text_sha256."""
        index = self.compact()
        again = index.where("size > 1")
        repeated = stored(filter_of(again), "filter")  # FILTER_BLOCKS rows of 4 KB at most
        if not self.wide and self.collided(repeated):
            wide = DigestIndex(self.spark, wide=True)
            for _, docs in self.batches:
                wide.flush(docs)
            return wide.result()
        entries = functools.reduce(DataFrame.unionByName, [self.entries_of(p) for p, _ in self.batches])
        probed = entries.withColumn("f_block", block_of(F.col("digest"))).join(F.broadcast(repeated), "f_block", "left")
        probed = probed.withColumn("hit", known(F.col("bitmap"), F.col("digest"))).drop("bitmap", "f_block")
        sha = F.lower(F.hex("sha")).alias("text_sha256")
        alone = probed.where(~F.col("hit")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), sha)
        found = probed.where("hit").join(again.withColumnRenamed("digest", "i_digest"), F.col("digest") == F.col("i_digest"), "left")
        first = (F.col("batch") == F.col("keep.batch")) & (F.col("row") == F.col("keep.row"))
        return alone.unionByName(
            found.select(
                "doc_id",
                F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
                F.coalesce("size", F.lit(1)).alias("group_size"),
                F.coalesce(first, F.lit(True)).alias("kept"),
                sha,
            )
        )


def exact_dedup(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    index = DigestIndex(docs.sparkSession, digest_bytes)
    index.flush(docs)
    return index.result()
