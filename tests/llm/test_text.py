"""WARC, personal data, pieces, decontamination, token counts and toxicity."""

import base64
import collections
import hashlib
import math
import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfold.llm import decontaminate, pieces, pii, tokens, toxicity, warc

DOCS = "doc_id long, text string, lang string, score string, spans string, item_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "a", "b", "c") for i, t in rows], DOCS)


# WARC


def plain_pages(pages, least):
    first = {}
    for i, _, h in pages:
        p = (h or "").encode()
        if i is not None and len(p) >= least:
            first[p] = min(i, first.get(p, i))
    n = collections.Counter((h or "").encode() for _, _, h in pages)
    for i, _, h in pages:
        p = (h or "").encode()
        again = len(p) >= least and n[p] > 1 and p in first and i != first[p]
        yield i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "revisit" if again else "response", first[p] if again else None


@pytest.mark.parametrize("least,segment", [(0, 64), (8, 8192)])
def test_warc_round_trip(spark, least, segment):
    rng = random.Random(2)
    texts = ["", None, "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n", "é\r\n\r\n0\r\n\r\n" * 40, "x" * 30_000, "\x00\n", "short", "\r" * 5_000 + "\r\n\r" * 900]
    pages = [(i, f"http://a/{i}\r\nX: y" if i % 5 else None, rng.choice(texts)) for i in range(60)] + [(None, "u", "only here"), (None, None, "x" * 30_000)]
    pages += pages[3:9]
    df = spark.createDataFrame([(*p, "no") for p in pages], "page_id long, url string, html string, digest string")
    got = warc.round_trip(df, least, segment).collect()
    assert collections.Counter(tuple(r)[:5] for r in got) == collections.Counter(plain_pages(pages, least))
    by_digest = {base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(): (h or "").encode() for _, _, h in pages}
    assert all(bytes(r.payload) == by_digest[r.payload_digest] for r in got if r.record_type == "response")
    assert segment > 1000 or max(r.segments for r in got) > 100


def test_warc_refuses_broken_archives():
    whole = warc.records(1, "u", b"payload" * 50, None, 64)
    assert len(whole) > 2
    with pytest.raises(ValueError):
        list(warc.cut(whole[0] + b"\r\n" + whole[1][:-9]))
    with pytest.raises(ValueError):
        warc.unchunked(b"5\r\nabcdefg\r\n0\r\n\r\n")
    assert warc.unchunked(warc.chunked(b"", 4)) == b"" and warc.unchunked(warc.chunked(b"abcdefgh", 3)) == b"abcdefgh"


def test_warc_segments_that_do_not_fit(spark, tmp_path):
    """Through the reader: complete archives in any order, and one segment missing, repeated, misnumbered or cut short."""
    import gzip

    whole = [r + b"\r\n" for r in warc.records(1, "u", b"pay\r\n\r\nload" * 50, None, 64)]
    other = [r + b"\r\n" for r in warc.records(2, "u", b"", None, 64)]
    assert len(whole) > 4

    def read(name, *archives):
        at = tmp_path / name
        at.mkdir()
        for i, a in enumerate(archives):
            (at / f"{i}.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in a))  # a member for each record
        return sorted(tuple(r)[:2] for r in warc.read_archives(spark, str(at)).collect())

    assert read("whole", whole[::-1], other) == [(1, 550), (2, 0)]
    assert read("apart", *[[r] for r in whole], other) == [(1, 550), (2, 0)]
    assert read("twice", whole, whole) == [(1, 550), (1, 550)]
    wrong = whole[1].replace(b"Segment-Number: 2", b"Segment-Number: 9")
    for name, archive in (("missing", whole[:1] + whole[2:]), ("wrong", [whole[0], wrong, *whole[2:]]), ("short", [*whole[:-1], whole[-1][:-9]]), ("first", whole[1:])):
        with pytest.raises(Exception, match="segments are missing|ends|should begin|no attribute|digest"):
            read(name, archive)


def test_warc_empty(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# personal data


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


PII = [
    (1, "mail a@b.c_d@e.f, x..y%@host-1.example.org. and foo@@bar.com foo@bar@baz.com é🎉 q@w.e"),
    (2, "ip 1.2.3.4.5 and 256.1.1.1 and 001.002.003.0004 1.2.3 10.0.0.255"),
    (3, "card 4111 1111 1111 1111, 4111-1111-1111-1112 5500005555555559 1 2 3 4 6011000990139424 9"),
    (4, "call +49 (0) 30 123456 or +1 2 or +1-555-0100-200-3000-99999 or +34.600.123.456)"),
    (5, "IBAN DE89 3704 0044 0532 0130 00 and DE89370400440532013001 and GB82WEST12345698765432"),
    (6, "social security 078-05-1120; order 078-05-1120 is " + "far " * 20 + "away 219-09-9999"),
    (7, "my visa card 378282246310005"),
    (10, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"; digest ' + "far " * 20 + "04dbebab91ab85687d33eeaaf9ac699e1188f962 key 00000000000000000000000000000000"),
    (None, None),
    (8, ""),
    (9, "a" * 60_000 + "@" + "1 " * 30_000 + "2.3" * 9000 + "+1" * 1000),
    (9, "a@b.co " * 3000),
]


def test_base_spans_by_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rng = random.Random(4)
    docs += [(1000 + i, "".join(rng.choice("a1@.+ -0()9é4") for _ in range(rng.randint(0, 120)))) for i in range(300)]
    rows = docs + PII
    got = pii.pii_report(frame(spark, rows)).collect()
    want = collections.Counter()
    for i, t in rows:
        s = plain_base(t)
        n = collections.Counter(k for k, _, _ in s)
        want[(i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in s).encode()).hexdigest())] += 1
    assert collections.Counter(tuple(r)[:6] for r in got) == want
    assert sum(sum(k[1:5]) for k in want) > 3000


def test_added_spans(spark):
    spans = {r.doc_id: [(s.kind, s.found, s.score) for s in r.spans] for r in pii.find_pii(frame(spark, PII[4:8])).collect()}
    assert [f for k, f, _ in spans[5] if k == "iban"] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert [f for k, f, _ in spans[6] if k == "ssn"] == ["078-05-1120"] * 2  # the word is near the first two only
    assert [k for k, _, _ in spans[7]] == ["short_card"]
    assert [(k, f[:4]) for k, f, _ in spans[10]] == [("secret", "04db")]


def test_many_matches_in_one_text(spark):
    """Time follows the number of matches, and chunks change neither offsets nor context."""
    n = 100_000
    text = "10.1.2.3 " * n
    began = time.time()
    got = pii.pii_report(frame(spark, [(1, text)])).first()
    assert time.time() - began < 30 and got.n_ip == n
    assert got.base_sha256 == hashlib.sha256(",".join(f"ip:{9 * i}:{9 * i + 8}" for i in range(n)).encode()).hexdigest()
    spans = pii.find_pii(frame(spark, [(1, "order 078-05-1120 " * 300 + "ssn 078-05-1120 078-05-1120 " * 200)])).first().spans
    assert [s.start for s in spans][-400:] == [300 * 18 + 28 * i + a for i in range(200) for a in (4, 16)]


def test_pii_runs_no_python(spark, capsys):
    pii.pii_report(frame(spark, PII)).explain()
    assert "Python" not in capsys.readouterr().out


# pieces


@pytest.fixture(scope="module")
def vocabulary():
    with open(pieces.MODEL, "rb") as f:
        return pieces.Pieces(f.read())


STRANGE = ["", " ", "  a\n\n ▁x ▁▁ ", "x" * 3000, "é漢字🎉\r\n\t", "a\x00b", " " * 500, "\n" * 5, "漢" * 70 + " b"]


def test_pieces_are_lossless_and_reproducible(spark):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    df = frame(spark, [(i, t) for i, t in enumerate(STRANGE)] + [(None, None), (3, "x" * 3000)])
    a = {(r.doc_id, r.text): r.pieces for r in pieces.with_pieces(df).collect()}
    b = {(r.doc_id, r.text): r.pieces for r in pieces.with_pieces(df.repartition(3)).collect()}
    assert a == b
    assert all(sp.decode(ids) == (t or "") for (_, t), ids in a.items())
    assert pieces.round_trip(df).where("not lossless").count() == 0
    other = {(r.doc_id, r.text): r.pieces for r in pieces.with_pieces(df, seed=5).collect()}
    assert other != a
    assert pieces.with_pieces(spark.createDataFrame([], DOCS)).count() == 0


def test_sampling_has_the_lattice_distribution(vocabulary):
    p = vocabulary

    def every(part, i=0):
        if i == len(part):
            yield (), 0.0
        for j in range(i + 1, len(part) + 1):
            if part[i:j] in p.log_p:
                for rest, w in every(part, j):
                    yield (p.id[part[i:j]], *rest), w + p.log_p[part[i:j]]

    n = 40_000
    for whole in (p.whole, 3):  # together, and one by one
        p.whole, old = whole, p.whole
        want = {k: math.exp(w) for k, w in every("▁stand")}
        total = sum(want.values())
        ids, ends = p.encode(["stand"] * n, list(range(n)))
        got = collections.Counter(tuple(ids[a:b].tolist()) for a, b in zip(np.r_[0, ends[:-1]], ends))
        p.whole = old
        assert set(got) <= set(want)
        assert max(abs(got[k] / n - w / total) for k, w in want.items()) < 0.01


def test_long_parts_are_sampled_like_short_ones(vocabulary):
    """A part's length chooses between two ways to sample, which give the same pieces for each key."""
    rng = random.Random(11)
    words = ["understanding", "▁x" * 3, "漢字é" * 4, *("".join(rng.choice("etaoinshrdlé漢") for _ in range(rng.randint(1, 36))) for _ in range(400))]
    texts, keys = [w for w in words for _ in range(5)], list(range(5 * len(words)))
    old, want = vocabulary.whole, vocabulary.encode(texts, keys)
    for whole in (0, 5):
        vocabulary.whole = whole
        got = vocabulary.encode(texts, keys)
        vocabulary.whole = old
        assert np.array_equal(got[0], want[0]) and np.array_equal(got[1], want[1])
    long = "".join(rng.choice("etaoinshrdl") for _ in range(20_000))
    ids, _ = vocabulary.encode([long], [3])
    assert vocabulary.decode(ids.tolist()) == long


# decontamination


def plain_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return min(row)


def test_matches_by_brute_force(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(rng.randint(8, 30)))) for i in range(12)] + [(50, None), (51, "  "), (52, "tiny item"), (53, "a short item of 24 chars"), (54, "a short item of 24 chars"), (None, "an item without an identifier but with text")]
    rows = [(None, None), (0, ""), (7, "see a short itm of 24 chars"), (7, "see a short itm of 24 chars"), (8, "a shrt itm of 24 chars"), (9, "tiny iem")]
    for i in range(120):
        _, item = rng.choice(items[:12] + items[-1:])
        chars = list(item)
        for _ in range(rng.randint(0, int(0.09 * len(chars)))):
            at = rng.randrange(len(chars))
            chars[at : at + 1] = rng.choice([[], ["x"], [chars[at], "y"]])
        rows.append((i, " ".join(word() for _ in range(5)) + "\n" + "".join(chars).upper() + "  " + word()))
    got = collections.Counter((r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(frame(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = collections.Counter()
    for i, t in rows:
        for n, item in items:
            a, b = decontaminate.plain(item), decontaminate.plain(t)
            if a and (d := plain_distance(a, b)) <= decontaminate.budget(len(a)):
                want[(i, n, d)] += 1
    assert got == want and len(want) > 60


def test_long_text_is_searched_to_its_end(spark):
    item = "the quick brown fox jumps over a lazy dog"
    docs = frame(spark, [(1, "x" * 300_000 + " " + item.replace("quick", "quik") + " " + "y " * 200_000), (2, "x" * 300_000 + " quick brown")])
    got = decontaminate.matches(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.distance) for r in got] == [(1, 5, 1)]


def test_blocks_change_nothing(spark, monkeypatch, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one = sorted(tuple(r) for r in decontaminate.matches(docs, items).collect())
    kept = decontaminate.decontaminated(docs, items)
    assert kept.columns == docs.columns and kept.count() == docs.count() - len({d for d, *_ in one})
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 2000)
    assert sorted(tuple(r) for r in decontaminate.matches(docs, items).collect()) == one
    assert decontaminate.matches(docs, items.limit(0)).count() == 0
    assert decontaminate.matches(docs.limit(0), items).count() == 0


# token counts


def test_tokens_against_another_encoder(spark, sf_dir):
    from pathlib import Path

    from tokenizers import Tokenizer

    other = Tokenizer.from_file(str(Path(tokens.VOCABULARY).with_name("byte_bpe_50k.json")))
    other.encode_special_tokens = True
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(500 + i, t) for i, t in enumerate(STRANGE + [None, "<|endoftext|>\n\n\n a"])]
    for r in tokens.section_tokens(frame(spark, rows)).collect():
        text = dict(rows)[r.doc_id] or ""
        enc = other.encode(text, add_special_tokens=False)
        starts = [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]
        want = [0] * len(starts)
        at = 0  # offsets of this encoder are code points; tokens inside one share it
        for a, _ in enc.offsets:
            at = max(s for s in range(len(starts)) if starts[s] <= a)
            want[at] += 1
        assert (r.n_tokens, r.n_sections) == (len(enc.ids), len(starts))
        assert sum(r.section_tokens) == r.n_tokens
        if all(ord(c) < 0x250 for c in text):
            assert [int(x) for x in r.section_tokens] == want


def test_long_white_space(spark):
    """The encoder's pattern refuses runs of about a million; cutting them out changes no token."""
    from pathlib import Path

    enc, _ = tokens.encoding(Path(tokens.VOCABULARY).read_bytes())
    n = tokens.LONG
    for text in ("a" + " " * n + "b", "\n" * n, "a" + " \r\n" * n + ".", "x" + "\u2003" * n + " y" + "\x1c" * n + "z", " " * (n - 1) + "b", " " * n + "b" + "\t" * n):
        assert tokens.encoded(enc, text).tolist() == enc.encode(text, disallowed_special=())
    big = frame(spark, [(1, "a" + " " * 2_000_000 + "b"), (2, "\n" * 2_000_000), (None, None), (None, None)])
    got = {r.doc_id: r for r in tokens.section_tokens(big).collect()}
    assert got[1].n_tokens == sum(got[1].section_tokens) and got[1].n_sections == 1
    assert got[2].n_sections == 2_000_001 and got[None].n_tokens == 0


def test_allocation_rules(spark):
    ends = np.array([3, 10, 12])
    for rule, want in (("first", [2, 0, 1]), ("most", [1, 1, 1]), ("share", [1 + 1 / 7, 6 / 7, 1])):
        got, crossing = tokens.allocate(ends, np.array([0, 4, 10]), np.array([4, 10, 12]), rule)
        assert crossing == 1 and np.allclose(got, want)
    assert tokens.allocate(ends, np.array([5]), np.array([9]), "first") == (pytest.approx([0]), 3)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("parts", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))])
    df = spark.createDataFrame([(1, "hello world é", [(0, 5), (6, 11)]), (2, None, None)], schema)
    got = {r.doc_id: r for r in tokens.section_tokens(df, "most", "parts").collect()}
    assert got[1].section_tokens == [1.0, 1.0] and got[2].section_tokens == [] and got[2].n_tokens == 0


# toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out and toxic is not null").select("score", "predicted", "toxic").collect()
    right = sum(r.predicted == r.toxic for r in got) / len(got)
    caught = sum(r.predicted for r in got if r.toxic) / sum(r.toxic for r in got)
    assert right > 0.98 and caught > 0.9


def test_held_out_labels_do_not_matter(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(tuple(r) for r in toxicity.toxicity(docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_toxicity_edges(spark):
    rows = [(None, None), (1, ""), (2, "you are a pathetic idiot and a loser"), (2, "w " * 40_000), (3, "fine words")]
    df = frame(spark, rows)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = sorted(toxicity.toxicity(df, none).collect(), key=lambda r: -r.score)
    assert len(got) == 5 and (got[0].doc_id, got[0].predicted) == (2, 1) and got[1].predicted == 0
    odd = spark.createDataFrame([(None, 1), (1, None), (2, 1), (2, 0), (77, 1)], "doc_id long, toxic int")
    assert toxicity.with_score(df, odd, out_col="score").columns == ["doc_id", "text", "lang", "score", "spans", "item_id"]
    assert toxicity.toxicity(df.limit(0), odd).count() == 0
