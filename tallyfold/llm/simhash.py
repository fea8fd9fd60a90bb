"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint has 64 bits; two link when they differ in at most RADIUS = 3 of them. Half of that is 1.5, so a ball of
radius 1 alone would miss pairs at distance 3. The bits are therefore cut into BLOCKS = 3 blocks, and for each block the
fingerprint without it emits all variants within one bit. Two fingerprints at distance 3 differ in some block, and without
that block in at most two bits: their balls meet. That makes 131 variants, not the 2,081 of radius 2. Variants are
shuffled; colliding fingerprints are deduplicated, verified by popcount and linked into the forest of their bucket, so no
group makes all its pairs. A bucket holds distinct fingerprints only, at most 44 * 2^22, whatever the number of copies.
Buckets' forests are joined into components by alternating star contraction, on the cluster alone.

Defined cases: null text is empty; no word gives fingerprint 0, which links like any other; a null doc_id gets a
fingerprint but never names a component unless the component has no other; repeated rows are all returned; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discarded, id_and_text, partitions, stored

RADIUS, WIDTH, SEED = 3, 3, 42
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Shingles whose hashes are held as bits at once.
STEP = 1 << 16


def words_of(text: str) -> list[bytes]:
    """Words in UTF-8: of bytes, only A-Z have a lower case and only \\x20 and \\x09 to \\x0D are blanks."""
    return text.encode().lower().split()


def fingerprint(text: str, width: int = WIDTH) -> int:
    words = words_of(text)
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, STEP):
        part = [b" ".join(words[i : i + width]) for i in range(at, min(n, at + STEP))]
        h = np.fromiter(map(xxhash.xxh64_intdigest, part, repeat(SEED)), np.uint64, len(part))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    return id_and_text(docs).mapInArrow(run, "doc_id long, fp long")


def variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys (each fingerprint without a block, within one bit), the number of the block left out, and the fingerprints."""
    keys, which = [], []
    for number, (start, width) in enumerate(BLOCKS):
        rest = fps & ~np.uint64(((1 << width) - 1) << start)
        flips = [0, *(1 << i for i in range(64) if not start <= i < start + width)]
        keys += [rest ^ np.uint64(f) for f in flips]
        which += [number] * len(flips)
    return np.concatenate(keys), np.repeat(np.array(which, np.int8), len(fps)), np.tile(fps, len(keys))


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Edges from each fingerprint of a bucket to the least of its component. fps: distinct, ascending."""
    rest, out = fps, []
    while len(rest) > 1:
        root, rest = rest[0], rest[1:]
        queue = [root]
        while queue and len(rest):
            near = np.bitwise_count(rest ^ queue.pop()) <= RADIUS
            found = rest[near]
            if len(found):
                out += [(int(root), int(x)) for x in found]
                queue += list(found)
                rest = rest[~near]
    return out


def links(distinct: DataFrame) -> DataFrame:
    """distinct: column fp without repeats. Edges a < b (as unsigned), a forest of each bucket's links."""
    spark = distinct.sparkSession

    def emit(batches):
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(fps), 2048):
                key, which, fp = variants(fps[at : at + 2048])
                yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(key.view(np.int64)), pa.array(fp.view(np.int64))], ["block", "key", "fp"])

    def meet(batches):
        held = None  # the rows of the last key, which may go on in the next batch
        for b in batches:
            block, key, fp = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            if held is not None:
                block, key, fp = (np.concatenate(x) for x in zip(held, (block, key, fp)))
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
            held = block[starts[-1] :], key[starts[-1] :], fp[starts[-1] :]
            yield edges(fp, starts[:-1], starts[1:])
        if held is not None:
            yield edges(held[2], np.array([0]), np.array([len(held[2])]))

    def edges(fp, starts, ends):
        many = np.flatnonzero(ends - starts > 1)
        out = []
        for s, e in zip(starts[many], ends[many]):
            out += forest(np.unique(fp[s:e].view(np.uint64)))
        pairs = np.array(sorted(set(out)), np.uint64).reshape(-1, 2).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    keyed = distinct.repartition(partitions(spark), "fp").mapInArrow(emit, "block byte, key long, fp long")
    met = keyed.repartition(partitions(spark), "block", "key").sortWithinPartitions("block", "key").mapInArrow(meet, "a long, b long")
    return met.distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root, for every node of the edges: alternating large-star and small-star until the edges are stars, that is,
    until no node has two parents or a parent and a child. Each pair of steps keeps the components, and only a few rows that
    say whether to go on reach the driver."""
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        ends = e.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty():
            break
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("g")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, F.col("u") == F.col("g")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy(F.col("u").alias("g")).agg(F.min("v").alias("m"))
        small = large.join(down, F.col("u") == F.col("g")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select(F.col("g").alias("u"), F.col("m").alias("v")))
        before, e = e, stored(small.where("u <> v").distinct(), "stars")
        discarded(before)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest doc_id reachable over links."""
    fps = stored(fingerprints(docs, width), "fingerprints")
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    distinct = stored(distinct, "distinct")
    roots = components(links(distinct.select("fp")))
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy(F.col("root").alias("r")).agg(F.min("first_id").alias("component_id"))
    ids = named.join(least, named.root == least.r).select(F.col("fp").alias("key_fp"), "component_id")
    return fps.join(ids, fps.fp == ids.key_fp).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
