"""Importance resampling towards a target: hashed n-grams of words are counted in the corpus and in the target, a document's
weight is the sum of its features' log ratios, and Gumbel noise with the weights draws documents without replacement.

Per batch of a partition, the words of its texts are numbered and the numbers joined, with a separator behind each text, to
one array whose suffixes are sorted to the depth of the longest n-gram. Neighbours' common prefixes cut the order into runs:
a run of depth n is one n-gram with all its occurrences. An n-gram is hashed once for its run, from the hash of its first
n - 1 words onwards, and the bucket is scattered back to the run's places in the texts. The corpus is read twice: for the
counts of its buckets, which are summed, and with the gains of the buckets for weights. Only BUCKETS numbers reach the driver.

Defined cases: null or empty text has no features, weight 0 and no rank; a null doc_id has the noise of the text "null" and
stands last among equal scores; repeated rows are all counted, scored and ranked, in any order among themselves; empty
corpus or target tables count nothing, and an empty corpus gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

N, BUCKETS, LEAST_WORDS, PERCENT, SEED = 3, 10_000, 20, 5, 42
#: Characters of text whose suffixes are sorted together.
BATCH = 4 << 20
#: Bytes from which a word's hash is continued by itself.
SHORT = 64
#: Bytes of words: digits, letters in lower case, and those of other characters; all else is a blank.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(WORDS).split()


def shifts() -> np.ndarray:
    """[length, byte, value]: what a byte of a CRC-32 becomes after `length` more zero bytes, for lengths under SHORT."""
    step = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32)
    step ^= step[0]  # linear: without the inversions
    out = np.empty((SHORT, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    for k in range(1, SHORT):
        out[k] = step[out[k - 1] & 255] ^ out[k - 1] >> 8
    return out


SHIFTS = shifts()


def hashed_on(before: np.ndarray, word: np.ndarray, names: list[bytes]) -> np.ndarray:
    """CRC-32s of n-grams from those of their first words (before) and the numbers of their last."""
    spaced = [b" " + x for x in names]
    sizes = np.fromiter(map(len, spaced), np.int64, len(spaced))
    size, before = sizes[word], before.astype(np.uint32)
    short = np.minimum(size, SHORT - 1)
    out = np.fromiter(map(zlib.crc32, spaced), np.uint32, len(spaced))[word]
    for k in range(4):
        out ^= SHIFTS[short, k, before >> np.uint32(8 * k) & 255]
    for i in np.flatnonzero(size >= SHORT).tolist():
        out[i] = zlib.crc32(spaced[word[i]], int(before[i]))
    return out


def suffix_order(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of ids sorted to depth n, and each one's common prefix with the one before it, up to n. A suffix that
    reaches a separator (0) before depth n is shorter, and sorts by what stands before it."""
    columns, alive = [], np.ones(len(ids), bool)
    for k in range(n):
        c = np.concatenate([ids[k:], np.zeros(min(k, len(ids)), ids.dtype)])
        alive &= c > 0  # nothing behind a separator
        columns.append(np.where(alive, c, 0))
    bits = 63 // n
    if len(ids) and int(ids.max()) < 1 << bits:  # the numbers of n words fit into one
        key = np.zeros(len(ids), np.int64)
        for c in columns:
            key = key << bits | c
        order = np.argsort(key)
    else:
        order = np.lexsort(columns[::-1])
    lcp, same = np.zeros(len(ids), np.int8), np.ones(max(len(ids) - 1, 0), bool)
    for c in columns:
        s = c[order]
        same &= (s[1:] == s[:-1]) & (s[1:] > 0)
        lcp[1:] += same
    return order, lcp


def features(texts: list[str | None], n: int = N, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every n-gram of 1 to n words, and the numbers of words and of features of each document."""
    split = [words_of(t) for t in texts]
    counts = np.array([len(w) for w in split], np.int64)
    names = [b"", *{x for w in split for x in w}]
    number = dict(zip(names, range(len(names))))
    ids = np.zeros(int(counts.sum()) + len(split), np.int32)
    doc = np.repeat(np.arange(len(split)), counts + 1)
    inside = np.ones(len(ids), bool)
    inside[np.cumsum(counts + 1) - 1] = False
    ids[inside] = [number[x] for w in split for x in w]
    order, lcp = suffix_order(ids, n)
    docs_out, buckets_out, hashes = [], [], None
    for depth in range(1, n + 1):
        # places where an n-gram of this depth begins, in the order; a run starts where the prefix is shorter than it
        whole = np.ones(len(order), bool)
        for k in range(depth):
            at = order + k
            whole &= (at < len(ids)) & (ids[np.minimum(at, len(ids) - 1)] > 0)
        head = lcp < depth
        run = np.cumsum(head) - 1
        first = np.flatnonzero(head & whole)
        last = ids[order[first] + depth - 1]
        of_run = np.zeros(int(run[-1]) + 1 if len(run) else 0, np.int64)
        of_run[run[first]] = hashed_on(hashes[first], last, names) if depth > 1 else np.fromiter(map(zlib.crc32, names), np.int64, len(names))[last]
        hashes = of_run[run]
        places = order[whole]
        docs_out.append(doc[places])
        buckets_out.append(hashes[whole] % buckets)
    sizes = sum(np.maximum(counts - k, 0) for k in range(n))
    return np.concatenate(docs_out), np.concatenate(buckets_out), counts, sizes


def parts(column: pa.Array):
    """(first row, texts) of some MB at a time."""
    at, texts, size = 0, [], 0
    for i, t in enumerate(column.to_pylist()):
        texts.append(t)
        size += len(t or "")
        if size >= BATCH:
            yield at, texts
            at, texts, size = i + 1, [], 0
    if texts:
        yield at, texts


def bucket_counts(df: DataFrame, text_col: str, name: str) -> DataFrame:
    """bucket and the number of features in it."""

    def count(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for _, texts in parts(b.column(0)):
                total += np.bincount(features(texts)[1], minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", name])

    return df.select(df[text_col].cast("string")).mapInArrow(count, f"bucket long, {name} long").groupBy("bucket").agg(F.sum(name).alias(name))


def gains(docs: DataFrame, target: DataFrame, text_col: str = "text", target_col: str = "text") -> np.ndarray:
    """The gain of every bucket: one row for each of BUCKETS."""
    spark = docs.sparkSession
    s, t = bucket_counts(docs, text_col, "s"), bucket_counts(target, target_col, "t")
    both = stored(spark.range(BUCKETS).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left").na.fill(0), "buckets")
    total = both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + BUCKETS)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + BUCKETS)).cast("double")
    rows = both.join(F.broadcast(total)).select("bucket", F.floor(1000.0 * F.log(ratio)).alias("gain")).collect()  # one row of totals; BUCKETS rows
    out = np.zeros(BUCKETS, np.int64)
    out[[r.bucket for r in rows]] = [r.gain for r in rows]
    return out


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight."""

    def weigh(batches):
        for b in batches:
            columns = [np.zeros(b.num_rows, np.int64) for _ in range(3)]
            for at, texts in parts(b.column(1)):
                doc, bucket, words, sizes = features(texts)
                # sums of long integers, exact at any size
                order = np.argsort(doc, kind="stable")
                total = np.concatenate([[0], np.cumsum(gain[bucket[order]])])
                ends = np.searchsorted(doc[order], np.arange(len(texts) + 1))
                for c, x in zip(columns, (words, sizes, np.diff(total[ends]))):
                    c[at : at + len(texts)] = x
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, columns)], ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string")).mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """One row for each row of docs: doc_id, n_features, weight, score and, of those drawn, rank."""
    w = weighted(docs, gains(docs, target))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    w = w.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("able"))
    w = stored(w, "weights")  # sorting by ranges reads its input twice
    placed = numbered(w, [F.desc("able"), F.desc("score"), F.asc_nulls_last("doc_id")], "scores")
    drawn = placed.where("able").count() * percent // 100
    return placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("able") & (F.col("pos") < drawn), F.col("pos") + 1).alias("rank"))
