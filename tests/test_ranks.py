"""Ranks, medians, fifths, samples and group sums under changing membership, against brute force."""

import collections
import hashlib
import random
import re
import statistics

from pyspark.sql import functions as F

from tallyfold.functions import stats
from tallyfold.operators import books, ranks, sampling

SCHEMA = "k string, g int, x double, id long"


def rows_of(n=600, seed=1):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 2), rng.choice([None, 0.5, -1.0, float(rng.randint(-50, 50)), rng.gauss(0, 1)]), i) for i in range(n)]
    return rows + [("one", 0, 7.5, n), ("none", 0, None, n + 1), ("two", 0, 1.0, n + 2), ("two", 0, 2.0, n + 3)]


def test_medians_by_brute_force(spark):
    rows = rows_of()
    got = stats.summarised(spark.createDataFrame(rows, SCHEMA).repartition(7), ["k", "g"], "x", stats.summary("x")).collect()
    groups = collections.defaultdict(list)
    for k, g, x, _ in rows:
        groups[k, g] += [] if x is None else [x]
    assert {(r.k, r.g): (r.n, round(r["median"], 9)) for r in got} == {key: (len(v), round(statistics.median(v), 9) if v else 0.0) for key, v in groups.items()}
    whole = stats.summarised(spark.createDataFrame(rows, SCHEMA), [], "x", stats.summary("x")).first()
    assert whole["median"] == statistics.median([r[2] for r in rows if r[2] is not None])


def test_ranks_by_brute_force(spark):
    rows = rows_of(seed=2)
    got = ranks.ranked(spark.createDataFrame(rows, SCHEMA).repartition(7), ["k"], F.desc("x"), "id").collect()
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[0]].append(r)
    for v in groups.values():
        v.sort(key=lambda r: (r[2] is None, -(r[2] or 0), r[3]))
    assert {r.id: (r._pos, r._n) for r in got} == {r[3]: (i, len(v)) for v in groups.values() for i, r in enumerate(v)}
    assert ranks.ranked(spark.createDataFrame([], SCHEMA), ["k"], "x").count() == 0


def test_fifths(spark):
    rows = [(k, 0, float((i * 7) % n), i + 1000 * n) for k, n in (("a", 4), ("b", 5), ("c", 14), ("d", 100)) for i in range(n)]
    got = collections.Counter((r.k, r.leg) for r in books.legs(spark.createDataFrame(rows, SCHEMA), ["k"], "x", "id").collect())
    assert got == {(k, leg): n // 5 for k, n in (("b", 5), ("c", 14), ("d", 100)) for leg in ("long", "short")}


def test_sample_moves_few_rows(spark):
    rows = rows_of(seed=3)
    df = spark.createDataFrame(rows, SCHEMA)
    s = sampling.stratified(df.where("k is not null"), ["k", "g"], "id", 40)
    taken = collections.defaultdict(list)
    for r in s.collect():
        taken[r.k, r.g].append(r.id)
    every = collections.defaultdict(list)
    for k, g, _, i in rows:
        if k is not None:
            every[k, g].append(i)
    assert sum(map(len, taken.values())) == 40
    for key, ids in taken.items():
        assert sorted(ids) == sorted(sorted(every[key], key=lambda i: (hashlib.md5(f"{i}-{sampling.SEED}".encode()).hexdigest(), i))[: len(ids)])
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_every_cell_has_zeros(spark):
    df = spark.createDataFrame([("a", 0, 1.0, 1)], SCHEMA).select("k", "g", "x")
    got = {(r.k, r.g): (r.n, r.mean_bps, r.median_bps, r.hit_rate) for r in stats.every_cell(df, {"k": ["a", "b"], "g": [0, 1]}, "x", stats.bps_summary("x")).collect()}
    assert got == {("a", 0): (1, 1e4, 1e4, 1.0), ("a", 1): (0, 0.0, 0.0, 0.0), ("b", 0): (0, 0.0, 0.0, 0.0), ("b", 1): (0, 0.0, 0.0, 0.0)}


def test_group_sums_under_membership_by_brute_force(spark):
    import datetime as dt

    from tallyfold.operators import diffusion, intervals

    rng = random.Random(8)
    start = dt.date(2014, 1, 1)
    days = [start + dt.timedelta(d) for d in sorted(rng.sample(range(400), 120))]
    names = [f"t{i}" for i in range(12)]
    groups = {n: i % 3 for i, n in enumerate(names)}
    spans = [(n, start + dt.timedelta(rng.randint(-50, 300)), rng.choice([None, start + dt.timedelta(rng.randint(-50, 450))])) for n in names for _ in range(rng.randint(0, 3))]
    returns = [(n, i, h, rng.choice([None, 0.0, rng.gauss(0, 1)])) for n in names for i in range(len(days)) for h in (1, 5) if rng.random() < 0.8]
    events = [(k, rng.choice([*names, "stranger"]), rng.randrange(len(days)), rng.choice([1.0, -1.0])) for k in range(300)]
    inside = lambda n, d: any(m == n and a <= d and (b is None or d <= b) for m, a, b in spans)
    s = spark.createDataFrame([(d, i) for i, d in enumerate(days)], "day date, idx int")
    m = spark.createDataFrame(spans, "ticker string, start_date date, end_date date")
    present = diffusion.member_sessions(m, s)
    assert {tuple(r) for r in present.collect()} == {(n, i) for n in names for i, d in enumerate(days) if inside(n, d)}
    g = spark.createDataFrame(list(groups.items()), "ticker string, grp int")
    e = spark.createDataFrame(events, "accession int, ticker string, idx int, sign double")
    sums = diffusion.peer_sums(e, spark.createDataFrame(returns, "ticker string, idx int, horizon int, x double"), g, present)
    want = {}
    for k, f, i, sign in events:
        for h in (1, 5):
            xs = [sign * x for n, j, hh, x in returns if x is not None and j == i and hh == h and n != f and groups[n] == groups.get(f) and inside(n, days[i])]
            if xs:
                want[k, h] = (len(xs), sum(xs), sum(x * x for x in xs), sum(x > 0 for x in xs))
    got = {(r.accession, r.horizon): (r.n, r.s, r.q, r.hits) for r in sums.collect()}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for key in got for a, b in zip(got[key], want[key]))
    pairs = intervals.peers(e.join(s, "idx"), g.withColumnRenamed("grp", "sic3"), m).collect()
    assert {(r.accession, r.peer) for r in pairs} == {(k, n) for k, f, i, _ in events for n in names if n != f and groups[n] == groups.get(f) and inside(n, days[i])}


def test_change_by_brute_force(spark):
    import math

    from tallyfold.operators import novelty

    rng = random.Random(6)
    words = ["alpha", "beta", "gamma", "delta", "the", "omega", "rare"]
    docs = [(i, rng.choice(["s", "s", "t", None]), None if rng.random() < 0.1 else " ".join(rng.choice(words) for _ in range(rng.choice([0, 3, 30])))) for i in range(120)]
    df = spark.createDataFrame(docs, "id long, src string, text string").repartition(5)
    counted = novelty.terms(df.where("text is not null"), "id", "text", None)
    vocab = novelty.vocabulary(counted, df.agg(F.count(F.lit(1))), 5, 0.9, None)
    bag = {i: collections.Counter(w for w in (t or "").split() if w not in novelty.STOPWORDS) for i, _, t in docs}
    df_ = collections.Counter(w for b in bag.values() for w in b)
    idf = {w: math.log(len(docs) / k) for w, k in df_.items() if 5 <= k <= math.floor(0.9 * len(docs))}

    def vector(i):
        v = {w: c / bag[i].total() * idf[w] for w, c in bag[i].items() if w in idf}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    want, last = {}, {}
    for i, s, t in docs:
        if s in last and t is not None and docs[last[s]][2] is not None:
            a, b = vector(i), vector(last[s])
            want[i] = (last[s], 1 - sum(x * b.get(w, 0) for w, x in a.items()))
        last[s] = i
    got = {r.id: (r.prev, r.change) for r in novelty.change(df, "id", "text", ["src"], "id", counted, vocab).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in got)


def test_terms_are_counted_in_their_text(spark):
    from tallyfold.operators import novelty

    df = spark.createDataFrame([(1, "Beta alpha beta, the alpha gamma beta"), (2, "the of"), (3, ""), (4, "zeta")], "id long, t string")
    counts = novelty.term_counts(df, "id", "t")
    assert sorted(tuple(r) for r in counts.collect()) == [(1, 6, "alpha", 2), (1, 6, "beta", 3), (1, 6, "gamma", 1), (4, 1, "zeta", 1)]
    assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()


def test_change_sees_the_end_of_long_texts(spark, tmp_path):
    import duckdb

    import __spark_entry__

    tails = ["alpha beta", "alpha beta", "gamma delta", "gamma delta"]
    docs = [(i, "s", "the " * 5_000 + tails[i % 4]) for i in range(40)]  # 20,000 characters of a stopword before the words
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {(i, i - 1, float(tails[i % 4] != tails[(i - 1) % 4])) for i in range(1, 40)}
    assert {(r.doc_id, r.prev, r.change) for r in __spark_entry__.queries()["novelty_change"](spark, str(tmp_path)).collect()} == want
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert set(con.execute(__spark_entry__.oracle_sql()["novelty_change"]).fetchall()) == want


def test_terms_of_many_batches(spark):
    from tallyfold.operators import novelty

    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    texts = [" ".join("".join(rng.choices(letters, k=4)) for _ in range(30_000)) for _ in range(9)] + ["Ünder THE \u212aelvin kelvin--ab a1b2 xyz9xyz", None, "", "the and"]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").coalesce(1)  # one task hands over several batches
    found = [re.findall("[a-z]{3,}", (t or "").lower()) for t in texts]
    want = {i: collections.Counter(w for w in f if w not in novelty.STOPWORDS) for i, f in enumerate(found)}
    got = {r.id: (r.n, dict(zip(r.words.split(" "), r.counts))) for r in novelty.bags(df, "id", "t").collect()}
    assert got == {i: (c.total(), dict(c)) for i, c in want.items() if c}
    assert sum(map(len, want.values())) > novelty.TOKENS_A_BATCH
    assert {r.id: r.words for r in novelty.bags(df.where("id = 9"), "id", "t", 13).collect()} == {9: "nder kel"}
