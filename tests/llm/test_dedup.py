"""Exact, near, line and substring duplicates against brute force, with the edge cases their docstrings define."""

import collections
import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from tallyfold.llm import exact_dedup, lines, simhash, suffix

SCHEMA = "doc_id long, text string, source string, keep string, h1 int, fp string, digest string"


def frame(spark, rows):
    """Extra columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, s, "x", 1, "y", None) for i, t, s in rows], SCHEMA)


EDGES = [(None, None, None), (1, "", "a"), (2, " \t", "b"), (3, "Ab c", "a"), (4, "abc", "b"), (5, "A b c", "c"), (6, "A bc ", "c"), (6, "A bc ", "c"), (7, "x" * 50_000, "a"), (8, "x" * 50_000, "b")]


def test_exact_by_brute_force(spark):
    for digest_bytes in (32, 1):  # one byte: most digests collide, and only the bytes tell
        rows = EDGES + [(100 + i, f"t{i % 40} {'z' * (i % 3)}{' ' * (i % 5)}", "s") for i in range(400)]
        got = exact_dedup.exact_dedup(frame(spark, rows), digest_bytes).collect()
        groups = collections.defaultdict(list)
        for i, t, _ in rows:
            groups["".join(c for c in t or "" if c not in " \t\n\v\f\r")].append((-len(t or ""), i is None, i))
        want = collections.Counter()
        for norm, members in groups.items():
            best = min(members, key=lambda m: m[:2] + (m[2] or 0,))
            for m in members:
                want[(m[2], best[2], len(members), hashlib.sha256(norm.encode()).hexdigest())] += 1
        assert collections.Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)


def test_exact_over_many_flushes(spark):
    """Five flushes fill level 0 five times: four runs of level 1 become one of level 2, and the last stays beside it."""
    rows = EDGES + [(100 + i, f"t{i % 90} {'z' * (i % 3)}{' ' * (i % 5)}", "s") for i in range(500)]
    index = exact_dedup.DigestIndex(spark)
    for part in range(5):
        index.flush(frame(spark, rows[part::5]))
    assert {k: len(v) for k, v in index.levels.items()} == {0: 0, 1: 1, 2: 1}
    many, one = (collections.Counter(tuple(r) for r in d.collect()) for d in (index.result(), exact_dedup.exact_dedup(frame(spark, rows))))
    assert many == one and sum(many.values()) == len(rows)
    assert list(index.levels) == [3]


def test_filter_knows_every_digest(spark):
    df = spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"), (F.col("id") % 4 == 0).alias("put"))
    bits = exact_dedup.filter_of(df.where("put"))
    got = df.withColumn("f_block", exact_dedup.block_of(F.col("digest"))).join(bits, "f_block", "left").groupBy("put").agg(F.avg(exact_dedup.known(F.col("bitmap"), F.col("digest")).cast("double")).alias("share")).collect()
    share = {r.put: r.share for r in got}
    assert share[True] == 1.0 and share[False] < 0.01


def test_empty_tables(spark):
    e = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.exact_dedup(e).count() == 0
    assert simhash.near_duplicates(e).count() == 0
    assert lines.line_report(e).count() == 0
    assert suffix.remove_repeats(e).count() == 0


def plain_fingerprint(text):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").translate({c: 32 for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_components(fps):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if bin(fps[a] ^ fps[b]).count("1") <= 3:
                parent[root(a)] = root(b)
    return [root(i) for i in range(len(fps))]


def test_simhash_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()] + EDGES
    got = collections.Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(frame(spark, rows)).collect())
    fps = [plain_fingerprint(t) for _, t, _ in rows]
    roots = brute_components(fps)
    least = {}
    for (i, _, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(i, least.get(r, i))
    assert got == collections.Counter((i, f"{fp:016x}", least.get(r)) for (i, _, _), fp, r in zip(rows, fps, roots))


def test_links_of_clustered_fingerprints(spark):
    rng = random.Random(5)
    fps = set()
    for _ in range(6):
        chain = [rng.getrandbits(64)]
        for _ in range(60):
            x = rng.choice(chain)
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            chain.append(x)
        fps |= set(chain)
    fps = sorted(fps)
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in fps], "fp long")
    roots = {r.node & (1 << 64) - 1: r.root for r in simhash.components(simhash.links(df)).collect()}
    want = collections.defaultdict(set)
    for x, r in zip(fps, brute_components(fps)):
        want[r].add(x)
    got = collections.defaultdict(set)
    for x in fps:
        got[roots.get(x, ("alone", x))].add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_lines_by_brute_force(spark):
    rng = random.Random(3)
    common = [f"common line number {i} for sites" for i in range(12)]
    rows = list(EDGES)
    for i in range(200):
        text = [rng.choice(common[: 1 + i % 12]) for _ in range(rng.randint(0, 3))] + [f"own line {i} of this document {rng.random()}", "short"]
        rng.shuffle(text)
        rows.append((20 + i, "\n".join(text), None if i % 17 == 0 else f"s{rng.randint(0, 3 + i % 9)}"))
    rows += rows[20:24]
    for keep_first in (True, False):
        sites, first = collections.defaultdict(set), {}
        for i, t, s in rows:
            for n, line in enumerate((t or "").split("\n")):
                if len(line.strip(" ")) >= 20:
                    if s is not None:
                        sites[line.strip(" ")].add(s)
                    first.setdefault(line.strip(" "), []).append((i is None, i or 0, n))
        want = collections.Counter()
        for i, t, _ in rows:
            kept = [x for n, x in enumerate((t or "").split("\n")) if len(sites[x.strip(" ")]) < 5 or (keep_first and min(first[x.strip(" ")]) == (i is None, i or 0, n))]
            want[(i, len((t or "").split("\n")), len((t or "").split("\n")) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())] += 1
        got = lines.line_report(frame(spark, rows), keep_first=keep_first).collect()
        assert collections.Counter(tuple(r) for r in got) == want
    assert sum(k[2] for k in want) > 50
    kept = lines.deduplicated(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "source", "keep", "h1", "fp", "digest"] and kept.count() == len(rows)


def test_many_sites_are_decided_by_sketches_alone(spark):
    rows = [(i, f"a line on very many sites\nown {i} {'x' * 20}", f"site{i}") for i in range(900)]
    got = lines.line_report(frame(spark, rows), min_sites=300)
    assert got.agg(F.sum("n_removed")).first()[0] == 899


def brute_repeats(rows, w=200):
    seen = collections.Counter()
    for _, t, _ in rows:
        b = (t or "").encode()
        seen.update(b[i : i + w] for i in range(len(b) - w + 1))
    out = collections.Counter()
    for i, t, _ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for j in range(len(b) - w + 1):
            if seen[b[j : j + w]] > 1:
                gone[j : j + w] = b"\1" * w
        kept = bytes(x for x, g in zip(b, gone) if not g)
        runs = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        out[(i, len(b), sum(gone), runs, hashlib.sha256(kept).hexdigest())] += 1
    return out


@pytest.mark.parametrize("shard,held", [(512, 100_000), (4, 20)])
def test_repeats_by_brute_force(spark, monkeypatch, shard, held):
    rng = random.Random(shard)
    monkeypatch.setattr(suffix, "SHARD", shard)
    monkeypatch.setattr(suffix, "HELD", held)
    word = lambda n: "".join(rng.choice("abcd é") for _ in range(n))
    passages = [word(320) for _ in range(4)]
    rows = [r for r in EDGES if len(r[1] or "") < 1000] + [(900, "a" * 2000, "s"), (901, "ab" * 300, "s"), (902, "z" * 199, "s"), (903, "z" * 199 + "y", "s")]
    for i in range(250):
        p = rng.choice(passages)
        a = rng.randint(0, 110)
        rows.append((i, word(rng.randint(0, 60)) + p[a : a + rng.randint(150, 300)] + word(rng.randint(0, 3)), "s"))
    rows += rows[30:40]
    assert collections.Counter(tuple(r) for r in suffix.remove_repeats(frame(spark, rows)).collect()) == brute_repeats(rows)


def test_suffix_order_and_prefixes():
    import numpy as np

    rng = random.Random(1)
    for n in (1, 7, 300):
        data = bytes(rng.choice(b"ab") for _ in range(n)) * 2
        order = suffix.suffix_order(np.frombuffer(data, np.uint8))
        assert order.tolist() == sorted(range(len(data)), key=lambda i: (*data[i:], 256))


def test_many_removed_lines_take_time_in_proportion(spark):
    import time

    def removed(n):
        text = "\n".join(f"common line with number {i:06d}" for i in range(n))
        df = frame(spark, [(k, f"own {k}\n{text}\n\nend {k}", f"s{k}") for k in range(6)]).withColumn("gone", F.sequence(F.lit(1), F.lit(n)))
        start = time.time()
        assert [r.t for r in df.select(lines.kept_text(F.col("text"), F.col("gone")).alias("t")).collect()] == [f"own {k}\n\nend {k}" for k in range(6)]
        return time.time() - start

    removed(10)
    assert removed(40_000) < 4 * removed(10_000) + 10
    odd = spark.createDataFrame([("a\nb\nc\n", [3, 0, 2]), ("a", [0]), ("", [0]), ("", None), ("a\n\nb", [1]), ("a\nb", [])], "t string, g array<int>")
    assert [r.k for r in odd.select(lines.kept_text(F.col("t"), F.col("g")).alias("k")).collect()] == ["b", "", "", "", "a\nb", "a\nb"]
