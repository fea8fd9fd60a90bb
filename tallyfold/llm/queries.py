"""The registered queries of this subpackage, over whole tables with production parameters, and the SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, lines, merkle, pieces, pii, resample, simhash, suffix, tokenfile, tokens, toxicity, warc
from .common import table


def op1_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return lines.line_report(table(spark, sf_dir, "documents"))


def op5_sentencepiece(spark, sf_dir):
    return pieces.round_trip(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark, sf_dir):
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


def op8_toxicity(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op10_token_counts(spark, sf_dir):
    counted = tokens.section_tokens(table(spark, sf_dir, "documents"))
    return counted.withColumn("section_tokens", F.array_join(F.transform("section_tokens", lambda x: x.cast("long").cast("string")), ","))


def op11_resample(spark, sf_dir):
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_merkle(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_token_file(spark, sf_dir):
    return tokenfile.round_trip(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc, op2_simhash, op3_pii, op4_line_dedup, op5_sentencepiece, op6_decontaminate, op7_suffix_dedup, op8_toxicity, op9_exact_dedup, op10_token_counts, op11_resample, op12_merkle, op13_token_file)}

#: The 5-bit groups of 160 bits as letters, in order.
_LETTER = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + " + " + ".join(f"{16 >> j} * CAST(substr(bits, 5 * i + {j + 1}, 1) AS INTEGER)" for j in range(5)) + ", 1)"

#: CRC-32 in SQL: the table of its bytes by rule, and a fold over a list of bytes.
_CRC_TABLE = "crc_table AS MATERIALIZED (SELECT list(c ORDER BY i) AS tab FROM (SELECT i, list_reduce(list_concat([i], [0, 0, 0, 0, 0, 0, 0, 0]), lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS c FROM (SELECT unnest(range(256)) AS i)))"


def _crc(octets: str) -> str:
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda a, b: xor(tab[xor(a & 255, b) + 1], a >> 8)), 4294967295)"


_FRAMED = " || ".join(f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')" for v in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", "{text}"))

ORACLES = {
    "op11_resample": f"""
        WITH {_CRC_TABLE},
        w AS (SELECT 0 AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents
         UNION ALL SELECT 1, 0, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') FROM benchmark),
        i AS (SELECT kind, id, ws, unnest(range(1, len(ws) + 1)) AS ix FROM w),
        n AS (SELECT kind, id, unnest([ws[ix], ws[ix] || ' ' || ws[ix + 1], ws[ix] || ' ' || ws[ix + 1] || ' ' || ws[ix + 2]]) AS gram FROM i),
        c AS (SELECT kind, id, gram, count(*) AS n FROM n WHERE gram IS NOT NULL GROUP BY ALL),
        d AS (SELECT gram, hex(encode(gram)) AS x FROM (SELECT DISTINCT gram FROM c)),
        h AS (SELECT gram, {_crc("list_transform(range(1, len(x), 2), lambda k: CAST('0x' || substr(x, k, 2) AS BIGINT))")} % 10000 AS bucket FROM d, crc_table),
        b AS (SELECT kind, id, bucket, n FROM c JOIN h USING (gram)),
        st AS (SELECT bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t FROM b GROUP BY bucket),
        g AS (SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * ((SELECT sum(s) FROM st) + 10000) AS DOUBLE) / CAST((s + 1) * ((SELECT sum(t) FROM st) + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM st),
        f AS (SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS weight FROM b JOIN g USING (bucket) WHERE kind = 0 GROUP BY id),
        x AS (SELECT w.id AS doc_id, len(ws) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
              coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || w.id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w LEFT JOIN f ON f.id = w.id WHERE kind = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS rn, count(*) OVER (PARTITION BY able) AS k FROM x)
        SELECT doc_id, n_features, weight, score, CASE WHEN able AND rn <= 5 * k // 100 THEN rn END AS rank FROM r""",
    "op12_merkle": f"""
        WITH RECURSIVE {_CRC_TABLE},
        leaf AS (SELECT doc_id, coalesce('+' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS ix, count(*) OVER (PARTITION BY lang) AS size, sha256({_FRAMED.format(text="text")}) AS h,
              CASE WHEN {_crc("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x))")} % 3 = 0 THEN sha256({_FRAMED.format(text="translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS bad FROM documents, crc_table),
        node AS (SELECT tree, 0 AS level, ix, size, h FROM leaf
         UNION ALL SELECT tree, level + 1, ix // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY ix)) FROM node WHERE size > 1 GROUP BY tree, level, ix // 8, size),
        subroot AS (SELECT tree, level AS depth, row_number() OVER (ORDER BY tree) - 1 AS ix, count(*) OVER () AS size, h FROM node WHERE size = 1),
        high AS (SELECT 0 AS level, ix, size, h FROM subroot UNION ALL SELECT level + 1, ix // 8, (size + 7) // 8, sha256(string_agg(h, '' ORDER BY ix)) FROM high WHERE size > 1 GROUP BY level, ix // 8, size),
        way AS (SELECT l.doc_id, n.level, n.ix AS place, n.h, n.ix < l.ix // (CAST(pow(8, n.level) AS BIGINT)) AS is_left FROM leaf l JOIN node n ON n.tree = l.tree AND n.ix // 8 = l.ix // CAST(pow(8, n.level + 1) AS BIGINT) AND n.ix <> l.ix // CAST(pow(8, n.level) AS BIGINT)
         UNION ALL SELECT l.doc_id, s.depth + n.level, n.ix, n.h, n.ix < s.ix // CAST(pow(8, n.level) AS BIGINT) FROM leaf l JOIN subroot s ON s.tree = l.tree JOIN high n ON n.ix // 8 = s.ix // CAST(pow(8, n.level + 1) AS BIGINT) AND n.ix <> s.ix // CAST(pow(8, n.level) AS BIGINT)),
        step AS (SELECT doc_id, level, coalesce(string_agg(h, '' ORDER BY place) FILTER (is_left), '') AS l, coalesce(string_agg(h, '' ORDER BY place) FILTER (NOT is_left), '') AS r FROM way GROUP BY doc_id, level),
        top AS (SELECT max(level) AS height, any_value(h) FILTER (size = 1) AS root FROM high),
        fold AS (SELECT doc_id, 0 AS level, depth + height AS last, coalesce(bad, leaf.h) AS h FROM leaf JOIN subroot USING (tree), top
         UNION ALL SELECT f.doc_id, f.level + 1, f.last, sha256(coalesce(l, '') || f.h || coalesce(r, '')) FROM fold f LEFT JOIN step s ON s.doc_id = f.doc_id AND s.level = f.level WHERE f.level < f.last)
        SELECT leaf.doc_id, leaf.h AS leaf, subroot.h AS subroot, root, coalesce(p.proof, sha256('')) AS proof_sha256, fold.h AS folded_root, fold.h = root AS verified
        FROM leaf JOIN subroot USING (tree) JOIN fold ON fold.doc_id = leaf.doc_id AND fold.level = fold.last LEFT JOIN (SELECT doc_id, sha256(string_agg(h, '' ORDER BY level, place)) AS proof FROM way GROUP BY doc_id) p ON p.doc_id = leaf.doc_id, top""",
    "op1_warc": f"""
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
        d AS (SELECT page_id, octet_length(payload) AS n, sha1(payload) AS hex, CAST(CAST(unhex(sha1(payload)) AS BIT) AS VARCHAR) AS bits FROM p),
        g AS (SELECT hex, bits, min(page_id) AS first_id FROM d GROUP BY hex, bits),
        r AS (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31]) AS i),
        b AS (SELECT hex, first_id, string_agg({_LETTER}, '' ORDER BY i) AS base32 FROM g, r GROUP BY hex, first_id)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, base32 AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first_id THEN first_id END AS refers_to
        FROM d JOIN b USING (hex)""",
    "op4_line_dedup": """
        WITH d AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
        l AS (SELECT doc_id, source, parts, unnest(range(1, len(parts) + 1)) AS n FROM d),
        t AS (SELECT doc_id, source, n, parts[n] AS raw, trim(parts[n], ' ') AS line FROM l),
        s AS (SELECT line, min({'doc_id': doc_id, 'n': n}) AS keeper FROM t WHERE length(line) >= 20 GROUP BY line HAVING count(DISTINCT source) >= 5),
        m AS (SELECT t.doc_id, t.n, t.raw, (s.line IS NOT NULL AND NOT (s.keeper.doc_id = t.doc_id AND s.keeper.n = t.n)) AS gone FROM t LEFT JOIN s ON t.line = s.line AND length(t.line) >= 20)
        SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_removed,
               sha256(coalesce(string_agg(raw, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS text_sha256
        FROM m GROUP BY doc_id""",
    "op9_exact_dedup": r"""
        WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS sha FROM documents),
        w AS (SELECT *, first_value(doc_id) OVER (PARTITION BY sha ORDER BY points DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY sha) AS n FROM d)
        SELECT doc_id, keep_id, CAST(n AS BIGINT) AS group_size, doc_id = keep_id AS kept, sha AS text_sha256 FROM w""",
}
