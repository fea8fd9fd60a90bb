"""The pipeline against brute force, stage after stage, on one small corpus; and the edge cases of each stage."""

import collections

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tallyfold.llm import common, decontaminate, pieces, toxicity

from .test_similar import brute_survivors

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_lines(rows):
    """Texts without the cross-site lines, but for the first occurrence of each."""
    sites, first = collections.defaultdict(set), {}
    for n, (i, text, site) in enumerate(rows):
        for k, line in enumerate((text or "").split("\n")):
            line = line.strip(" ")
            if len(line) >= 20:
                sites[line] |= {site} - {None}
                first[line] = min(first.get(line, (True, 1 << 62, 0, 0)), (i is None, i or 0, k, n))
    out = []
    for n, (i, text, _) in enumerate(rows):
        kept = []
        for k, line in enumerate((text or "").split("\n")):
            bare = line.strip(" ")
            if len(bare) < 20 or len(sites[bare]) < 5 or first[bare] == (i is None, i or 0, k, n):
                kept.append(line)
        out.append((i, "\n".join(kept)))
    return out


def test_pipeline_by_brute_force(spark, sf_dir):
    docs, labels, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    kept = [r for r in rows if scores[r[0]] < 0.5]
    unlined = brute_lines(kept)
    alone = brute_survivors(unlined)
    items = [(r.item_id, decontaminate.plain(r.text)) for r in benchmark.collect()]
    clean = {i: t for i, t in alone if not any(near(item, decontaminate.plain(t)) for _, item in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert {i: r.text for i, r in got.items()} == clean
    assert 0 < len(clean) < len(alone) and sum(alone.values()) < len(unlined) and any(a[1] != (b[1] or "") for a, b in zip(unlined, kept))
    with open(pieces.MODEL, "rb") as f:
        p = pieces.Pieces(f.read())
    assert all(p.decode(r.pieces) == (r.text or "") for r in got.values())


def near(item, text):
    """Whether the item is within its budget of a stretch of the text, by its pieces and the plain table of distances."""
    k = decontaminate.budget(len(item))
    cuts = [len(item) * i // (k + 1) for i in range(k + 2)]
    for a, b in zip(cuts, cuts[1:]):
        at = text.find(item[a:b])
        while at >= 0:
            part = text[max(0, at - a - k) : at - a + len(item) + k]
            row = [0] * (len(part) + 1)
            for i, c in enumerate(item, 1):
                last, row[0] = row[0], i
                for j, d in enumerate(part, 1):
                    last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
            if min(row) <= k:
                return True
            at = text.find(item[a:b], at + 1)
    return False


EDGES = [(None, None), (None, "first text without an id"), (None, "second text without an id"), (7, "one text of the id seven"), (7, "another text of the id seven"), (8, "x" * 300_000), (9, ""), (9, "")]


@pytest.mark.parametrize("number", range(4))
def test_stages_on_edge_cases(spark, sf_dir, number):
    """Null, repeated and reused ids, empty and long texts, extra columns of clashing names, an empty table: no stage drops
    any of these rows but the near-dedup stage, which keeps one of equal rows and one of the texts without words."""
    name, stage = corpus_pipeline.STAGES[number]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in EDGES], SCHEMA)
    df = df.select("*", F.lit("a").alias("score"), F.lit(1).alias("root"), F.lit("k").alias("stays"), F.lit(2).alias("gone"))
    out = stage(spark, df, sf_dir)
    assert out.columns == df.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    want = collections.Counter(EDGES)
    if name == "simhash":
        del want[None, None]
        want[9, ""] = 1
    assert got == want
    assert stage(spark, df.limit(0), sf_dir).count() == 0
    corpus_pipeline.sample_pieces(spark, df, sf_dir)
    assert not [p for p in common.made() if p in corpus_pipeline._left]
