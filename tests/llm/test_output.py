"""Resampling, the Merkle manifest and the token files against brute force, with the edge cases their docstrings define."""

import collections
import hashlib
import math
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tallyfold.llm import merkle, resample, tokenfile

SCHEMA = "doc_id long, text string, source string, lang string, n_chars long, pos long, grp string, digest string, weight long"
TEXTS = [None, "", " \t\n", "Abc", "It's ÉCOLE<|endoftext|>b I'LL x ß\x1fa\x0bb\x85c 12ab3½ !'s''re", "퟿\U0001f600á ῼΣ ΑΣ H̱", "word " * 30_000, "w" * 70_000, "It's A\x0bb \x1f!x 12 'S'll É", "a" + "é" * 100]


def frame(spark, rows, n=1):
    """rows: (doc_id, text, lang). Extra columns have names that the operators use inside."""
    return spark.createDataFrame([(i, t, "s" if i else None, g, len(t) if t else None, 5, "x", None, 7) for i, t, g in rows], SCHEMA).repartition(n)


def edge_rows():
    rng = random.Random(5)
    rows = [(i, t, ["en", None, "fr", "é", ""][i % 5]) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id Here", "en"), (None, None, None), (3, "Abc", "en"), (3, "Abc", "en"), (3, "another A", "en"), (-7, "minus", "one")]
    return rows + [(100 + i, " ".join(rng.choice(["alpha", "Beta", "c1", "été", "z"]) for _ in range(rng.randint(0, 40))), rng.choice(["en", "en", "en", "de"])) for i in range(700)]


def test_features_by_brute_force():
    rng = random.Random(3)
    words = ["a", "B", "cc", "é", "x-y", "1", "w" * 62, "v" * 63, "u" * 64, "q" * 700]
    for _ in range(150):
        texts = [None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 5))]
        doc, bucket, counts, sizes = resample.features(texts)
        want = collections.Counter()
        for i, t in enumerate(texts):
            w = "".join(c.lower() if c.isascii() and c.isupper() else c if c.isdigit() or c.isalpha() else " " for c in t or "").split()
            assert counts[i] == len(w)
            grams = [" ".join(w[k : k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]
            assert sizes[i] == len(grams)
            want.update((i, zlib.crc32(g.encode()) % 10_000) for g in grams)
        assert collections.Counter(zip(doc.tolist(), bucket.tolist())) == want


def test_suffix_order_with_too_many_words_for_one_number():
    rng = np.random.default_rng(1)
    ids = rng.integers(0, 4, 500).astype(np.int64)
    ids[-1] = 0
    wide = np.where(ids > 0, ids + (1 << 22), 0)
    for x in (ids, wide):
        order, lcp = resample.suffix_order(x, 3)
        cut = [tuple((x[i : i + 3].tolist() + [0])[: (x[i : i + 3].tolist() + [0]).index(0)]) for i in range(len(x))]
        assert [cut[i] for i in order] == sorted(cut)
        assert all(lcp[k] == next((j for j in range(4) if cut[order[k]][: j + 1] != cut[order[k - 1]][: j + 1] or j == min(len(cut[order[k]]), 3)), 3) for k in range(1, len(x)))


def test_resample_by_brute_force(spark):
    rows = edge_rows()
    target = [(1, "alpha beta c1", "en"), (2, "été z z", "en"), (3, None, "en")]
    got = resample.resample(frame(spark, rows, 5), frame(spark, target)).collect()

    def grams(text):
        w = [x.decode() for x in resample.words_of(text)]
        return len(w), [zlib.crc32(" ".join(w[k : k + n]).encode()) % 10_000 for n in (1, 2, 3) for k in range(len(w) - n + 1)]

    s, t = (collections.Counter(b for r in side for b in grams(r[1])[1]) for side in (rows, target))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    want = []
    for i, text, _ in rows:
        n, g = grams(text)
        weight = sum(map(gain, g))
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append((i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), n >= 20))
    able = sorted((w for w in want if w[4]), key=lambda w: (-w[3], w[0] is None, w[0]))[: sum(w[4] for w in want) * 5 // 100]
    assert collections.Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == collections.Counter(w[:4] for w in want)
    assert sorted((r.rank, r.doc_id, r.score) for r in got if r.rank) == [(k + 1, w[0], w[3]) for k, w in enumerate(able)]
    none = frame(spark, rows[:1]).limit(0)
    assert resample.resample(none, none).count() == 0
    assert {r.rank for r in resample.resample(frame(spark, rows[:5]), none).collect()} == {None}


def manifest_by_hand(rows):
    H = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    framed = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(i, t, g, lower=False):
        return H(*map(framed, (i, "s" if i else None, g, len(t) if t else None, t and "".join(c.lower() if c.isascii() else c for c in t) if lower else t)))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][k : k + 8]) for k in range(0, len(levels[-1]), 8)])
        return levels

    def way(levels, i):
        for level in levels[:-1]:
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            yield run[: i % 8], run[i % 8 + 1 :]
            i //= 8

    groups = collections.defaultdict(list)
    for i, t, g in rows:
        groups[g].append((i is not None, i or 0, leaf(i, t, g), leaf(i, t, g, True), i))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([m[2] for m in sorted(groups[g])]) for g in names}
    high = tree([trees[g][-1][0] for g in names])
    for k, g in enumerate(names):
        for at, (_, _, own, bad, i) in enumerate(sorted(groups[g])):
            path = [*way(trees[g], at), *way(high, k)]
            node = bad if zlib.crc32(str("" if i is None else i).encode()) % 3 == 0 else own
            for a, z in path:
                node = H(*a, node, *z)
            yield i, own, trees[g][-1][0], high[-1][0], H(*[x for a, z in path for x in a + z]), node, node == high[-1][0]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_manifest_by_brute_force(spark, levels):
    """In steps over blocks of 8, 64 and 512 leaves."""
    rows = edge_rows()
    if levels == 1:
        rows = rows[:90]
    got = merkle.manifest(frame(spark, rows, 5), depth=levels).collect()
    assert collections.Counter(map(tuple, got)) == collections.Counter(manifest_by_hand(rows))
    assert {r.verified for r in got} == {True, False}


def test_small_manifests(spark):
    assert merkle.manifest(frame(spark, [(1, "a", "en")]).limit(0)).count() == 0
    (one,) = merkle.manifest(frame(spark, [(1, "a", "en")])).collect()
    assert one.leaf == one.subroot == one.root == one.folded_root and one.proof_sha256 == hashlib.sha256(b"").hexdigest()
    assert merkle.manifest(frame(spark, edge_rows()[:40]), tamper_every=0).where("not verified").count() == 0


def test_coder_gives_the_ids_back():
    rng = np.random.default_rng(0)
    b = tokenfile.BLOCK
    rows = [rng.integers(0, 65536, b), np.zeros(b, int), np.full(b, 65535), np.arange(b) % 3, rng.zipf(1.3, b) % 49408, np.tile(rng.integers(0, 49408, 64), b // 64), rng.choice([0, 256, 65535], b)]
    grid = np.array(rows).astype(np.uint32)
    data = tokenfile.coded(grid)
    assert (tokenfile.decoded(data) == grid).all()
    sizes = [len(d) for d in data]
    assert sizes[1] < 40 and sizes[5] < b and sizes[0] < 2.6 * b  # what repeats is predicted
    assert all(tokenfile.coded(grid[k : k + 1])[0] == d for k, d in enumerate(data))  # blocks are independent
    assert (tokenfile.decoded(data[3:5]) == grid[3:5]).all()


def test_mixture_sums_to_one():
    m = tokenfile.Models(3)
    rng = np.random.default_rng(0)
    for _ in range(300):
        m.forecast()
        assert (m.f1 >= 16).all() and (m.f2 >= 16).all() and (m.named < 1 << tokenfile.SCALE).all()
        m.learned(rng.integers(0, 5, 3).astype(np.uint32))
        assert np.allclose(m.w0 + m.w1 + m.w2, 1, atol=1e-5)
        assert (m.size.reshape(3, 256).sum(1) == 1 << tokenfile.SCALE0).all()


def test_crc_of_joined_bytes():
    rng = random.Random(2)
    for _ in range(50):
        parts = [rng.randbytes(rng.choice([0, 1, 50, 5000])) for _ in range(rng.randint(1, 6))]
        behind = [sum(map(len, parts[i + 1 :])) for i in range(len(parts))]
        shifted = tokenfile.crc_shift(np.array([zlib.crc32(p) for p in parts]), np.array(behind))
        assert np.bitwise_xor.reduce(shifted) == zlib.crc32(b"".join(parts))


def test_token_file_by_brute_force(spark, tmp_path):
    rows = edge_rows()
    t = tokenfile.encoder_of(tokenfile.VOCABULARY).tokenizer
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfile.round_trip(frame(spark, rows, 5)).collect())
    ids = [(i, [*t.encode(x or "", add_special_tokens=False).ids, 2]) for i, x, _ in rows]
    assert collections.Counter(g[1:] for g in got) == collections.Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for i, x in ids)
    assert [(g[1] is not None, g[1] or 0) for g in got] == sorted((i is not None, i or 0) for i, _, _ in rows)
    assert [g[0] for g in got] == np.cumsum([0, *(g[2] for g in got)])[:-1].tolist()
    assert max(g[2] for g in got) > 3 * tokenfile.BLOCK  # a document over several blocks
    assert tokenfile.round_trip(frame(spark, rows).limit(0)).count() == 0
    # a damaged block is noticed
    tokenfile.write_ids(frame(spark, rows), str(tmp_path / "a"))
    bad = spark.read.parquet(str(tmp_path / "a")).withColumn("coded", F.expr("overlay(coded placing X'5A5B' from 9)"))
    bad.write.parquet(str(tmp_path / "b"))
    with pytest.raises(Exception, match="checksum"):
        tokenfile.read_ids(spark, str(tmp_path / "b")).collect()
    spark.read.parquet(str(tmp_path / "a")).where("block <> 1").write.parquet(str(tmp_path / "c"))
    with pytest.raises(Exception, match="missing"):
        tokenfile.read_ids(spark, str(tmp_path / "c")).collect()


def test_texts_in_parts_have_the_ids_of_whole_texts():
    import pyarrow as pa

    rng = random.Random(11)
    simple = [chr(c) for c in range(128)] + list("àÉßÿÖøÐ") + ["'s", "'LL", "'Re", " ", "\n", "the", "Ing", "<|", "<|endoftext|>"]
    other = simple + list("×÷œ“É\u0301Σ\u00a0\u2028İǅ中\U0001f600\u0131")
    texts = ["".join(rng.choice(side) for _ in range(rng.randint(0, 40))) for _ in range(1500) for side in (simple[:-2], simple, other)]
    e = tokenfile.Encoder(tokenfile.VOCABULARY)
    ids, sizes = e.encoded(pa.array(texts))
    at = np.cumsum([0, *sizes])
    for text, a, z, want in zip(texts, at, at[1:], e.tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:z].tolist() == want.ids, repr(text)


def test_new_parts_are_encoded_together():
    """An encoding for each new part took a third of the query's time."""
    import pyarrow as pa

    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.n = tokenizer, 0

        def __getattr__(self, name):
            return getattr(self.tokenizer, name)

        def encode_batch_fast(self, texts, **options):
            self.n += len(texts)
            return self.tokenizer.encode_batch_fast(texts, **options)

    rng = random.Random(7)
    texts = [" ".join("".join(rng.choice("abcdeéß'!7") for _ in range(rng.randint(1, 12))) for _ in range(400)) for _ in range(20)]
    e = tokenfile.Encoder(tokenfile.VOCABULARY)
    e.bare = Counted(e.bare)
    for part in (texts[:10], texts):  # the first half again
        ids, sizes = e.encoded(pa.array(["none"] + part).slice(1))
        assert np.split(ids, np.cumsum(sizes)[:-1])[-1].tolist() == e.tokenizer.encode(part[-1], add_special_tokens=False).ids
        assert sizes.tolist() == [len(x.ids) for x in e.tokenizer.encode_batch(part, add_special_tokens=False)]
    assert 0 < e.bare.n < 400


def test_dearest_ids_fit():
    """Ids that the models hold least likely at each step, beside others."""
    m, row = tokenfile.Models(1), []
    for _ in range(tokenfile.BLOCK):
        m.forecast()
        high = int(m.size.argmin())
        x = next(i for i in range(high << 8, (high << 8) + 3) if i not in (m.one[0], m.two[0]))
        if len(row) in range(300, 900):  # first the models grow sure
            x = 7
        row.append(x)
        m.came(np.array([x >> 8]), np.array([x not in (m.one[0], m.two[0])]))
        m.learned(np.array([x], np.uint32))
    grid = np.array([row, [7] * tokenfile.BLOCK, row[::-1]], np.uint32)
    data = tokenfile.coded(grid)
    assert (tokenfile.decoded(data) == grid).all()
    assert len(data[1]) < 40 < len(data[0]) < 4 + 3 * tokenfile.Coder.MOST + tokenfile.BLOCK


def test_few_blocks_at_a_time(spark, monkeypatch):
    """Rows of a shard come out whole whatever the number of blocks coded together."""
    import pyarrow as pa

    rows = sorted((i, t or "") for i, t, _ in edge_rows() if i is not None and i >= 0)
    batches = [pa.RecordBatch.from_arrays([pa.array([4] * len(p), pa.int32()), pa.array([r[0] for r in p], pa.int64()), pa.array([r[1] for r in p])], ["shard", "doc_id", "text"]) for p in (rows[:300], rows[300:])]
    found = []
    for lanes in (1, 3, 4096):
        monkeypatch.setattr(tokenfile, "LANES", lanes)
        found.append([r for b in tokenfile.coded_blocks(iter(batches), tokenfile.VOCABULARY, 2) for r in b.to_pylist()])
    assert found[0] == found[1] == found[2]
    n = sum(r["n"] for r in found[0])
    assert [r["first"] for r in found[0]] == list(range(0, n, tokenfile.BLOCK)) and sum(d["n"] for d in {(d["start"]): d for r in found[0] for d in r["docs"]}.values()) == n


@pytest.mark.parametrize("name", ["op11_resample", "op12_merkle"])
def test_query_against_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(__spark_entry__.oracle_sql()[name])
    names = [c[0] for c in found.description]
    got = __spark_entry__.queries()[name](spark, sf_dir)
    assert sorted(got.columns) == sorted(names)
    assert collections.Counter(map(tuple, got.select(*names).collect())) == collections.Counter(found.fetchall())
