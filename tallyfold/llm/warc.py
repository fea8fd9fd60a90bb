"""WARC archives: a writer that cuts long records into segments, and a reader that puts them together again.

Writing: one response record for each row, its HTTP block in chunked transfer framing; a block over `segment_bytes` is
cut into a first record (WARC-Segment-Number 1) and continuation records that name it in WARC-Segment-Origin-ID, the last
with WARC-Segment-Total-Length. A row whose payload equals that of a row with a smaller page_id becomes a revisit record,
whose HTTP header still states Content-Length. Archives are written by Spark's text sink, which ends each record's bytes
with the CRLF that a record ends with and compresses each archive, so they may lie in any store that Spark reaches.

Reading: an archive comes as a stream of pieces between CRLFs, decompressed on the way, so that a task holds a record and
not an archive; only an archive that is not compressed and larger than Spark's splits must be compressed first. Records are
cut out of the stream by Content-Length; those in one piece are decoded at once; pieces are shuffled by origin
identifier and segment number, ordered, checked against the total length and decoded. A broken archive raises.

Defined cases: null html is an empty payload, null url an empty target; a null page_id is kept and sorts after every
other; repeated rows are all written and all read; rows repeated with the smallest page_id are all responses; an empty
table gives no archive and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path

SEGMENT_BYTES, CHUNK_BYTES, SALTS = 8192, 2048, 32
CRLF = b"\r\n"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, segments int"
PIECE = "origin string, number int, total long, page_id long, digest string, data binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i : i + size]
        parts += [b"%x\r\n" % len(part), part, CRLF]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(data: bytes) -> bytes:
    at, parts = 0, []
    while True:
        end = data.index(CRLF, at)
        n = int(data[at:end].split(b";")[0], 16)
        at = end + 2
        if not n:
            return b"".join(parts)
        if data[at + n : at + n + 2] != CRLF:
            raise ValueError("a chunk does not end where its length says")
        parts.append(data[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    head, _, body = block.partition(CRLF + CRLF)
    return unchunked(body) if re.search(rb"(?im)^transfer-encoding:[^\r\n]*chunked", head) else body


def record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    """A record without its last CRLF, which the sink adds."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))])
    return b"WARC/1.1\r\n" + head.encode() + CRLF + block + CRLF


def records(page_id, url, payload: bytes, refers, segment_bytes: int) -> list[bytes]:
    """Records of one row. A record's id is made of page_id and digest: rows that share it have the same payload."""
    digest = base32_sha1(payload)
    name = lambda page: f"<urn:page:{page}:{digest}>"
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    common = [("WARC-Record-ID", name(page_id)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if refers is not None:
        block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
        return [record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", name(refers)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")], block)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [record([("WARC-Type", "response"), *common], block)]
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [record([("WARC-Type", "response"), *common, ("WARC-Segment-Number", 1)], parts[0])]
    for i, part in enumerate(parts[1:], 2):
        own = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<urn:page:{page_id}:{digest}:{i}>"), common[1], common[2], ("WARC-Segment-Origin-ID", name(page_id)), ("WARC-Segment-Number", i)]
        out.append(record([*own, ("WARC-Segment-Total-Length", len(block))] if i == len(parts) else own, part))
    return out


def write_archives(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha", F.unhex(F.sha1("html")))
    # one row for each payload that repeats: its size does not follow the number of its copies
    again = (
        p.where(F.octet_length("html") >= min_revisit_bytes)
        .groupBy(F.col("sha").alias("again_sha"))
        .agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
        .select("again_sha", "first_id")
    )
    # a payload may have a third of all rows: its one row goes to SALTS places, and its copies are dealt over them
    again = again.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("again_salt"))
    p = p.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    p = p.join(again, (p.sha == again.again_sha) & (p.salt == again.again_salt), "left").select(
        "page_id", "url", "html", F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers")
    )

    def build(batches):
        for b in batches:
            out = [bytes_ for row in zip(*(b.column(i).to_pylist() for i in range(4))) for bytes_ in records(row[0], row[1], row[2].encode(), row[3], segment_bytes)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    # bytes stay as they are in the cast; the sink writes CRLF after each
    p.mapInArrow(build, "value binary").select(F.col("value").cast("string")).write.option("lineSep", "\r\n").option("compression", "gzip").text(path)


class Cutter:
    """Cuts the records out of an archive that comes in pieces, each without the CRLF after it."""

    def __init__(self, name: str = ""):
        self.name, self.head, self.body, self.size, self.fields = name, [], [], 0, None

    def add(self, piece: bytes):
        """The records, (fields, block), that this piece completes."""
        if self.fields is None:
            if piece or not self.head:
                if not self.head and not piece.startswith(b"WARC/"):
                    raise ValueError(f"{self.name}: no record where one should begin")
                self.head.append(piece)
                return
            self.fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in b"\r\n".join(self.head[1:]).decode().split("\r\n"))}
            self.want, self.head = int(self.fields["content-length"]), []
            return
        # a record's block and the two CRLFs after it are the pieces up to an empty one that ends behind them
        self.body.append(piece)
        self.size += len(piece) + 2
        if self.size >= self.want + 4:
            data = CRLF.join([*self.body, b""])
            if self.size != self.want + 4 or data[self.want :] != CRLF + CRLF:
                raise ValueError(f"{self.name}: a record does not end where its length says")
            done, self.body, self.size, self.fields = (self.fields, data[: self.want]), [], 0, None
            yield done

    def end(self) -> None:
        if self.fields is not None or self.head:
            raise ValueError(f"{self.name}: the archive ends inside a record")


def cut(data: bytes):
    """(fields, block) of each record of an archive that is in memory."""
    cutter = Cutter()
    for piece in data.removesuffix(CRLF).split(CRLF) if data else ():
        yield from cutter.add(piece)
    cutter.end()


def page_of(name: str) -> int | None:
    page = name.split(":")[2]
    return None if page == "None" else int(page)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload (null for revisits) and what the records state of it, for every record of the archives."""
    whole = f"{RESULT}, payload binary"
    lines = spark.read.option("lineSep", "\r\n").option("pathGlobFilter", "*.{txt,gz,warc}").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("starts"), F.col("value").cast("binary").alias("piece"))

    def scan(batches):
        done, pieces, held, cutter = [], [], 0, None
        for b in batches:
            for name, starts, piece in zip(*(b.column(i).to_pylist() for i in range(3))):
                if starts:
                    raise ValueError(f"{name} is not compressed and was split: compress it")
                if cutter is None or cutter.name != name:
                    if cutter:
                        cutter.end()
                    cutter = Cutter(name)
                for f, block in cutter.add(piece):
                    if "warc-segment-number" in f:
                        origin = f.get("warc-segment-origin-id", f["warc-record-id"])
                        total = int(f["warc-segment-total-length"]) if "warc-segment-total-length" in f else None
                        pieces.append((origin, int(f["warc-segment-number"]), total, page_of(origin), f.get("warc-payload-digest", "")[5:] or None, block))
                    elif f["warc-type"] == "revisit":
                        n = int(re.search(rb"(?im)^content-length: *(\d+)", block)[1])
                        done.append((page_of(f["warc-record-id"]), n, f["warc-payload-digest"][5:], "revisit", page_of(f["warc-refers-to"]), 1, None))
                    else:
                        payload = payload_of(block)
                        if (digest := base32_sha1(payload)) != f["warc-payload-digest"][5:]:
                            raise ValueError(f"{f['warc-record-id']}: the payload does not have the digest stated")
                        done.append((page_of(f["warc-record-id"]), len(payload), digest, "response", None, 1, payload))
                    held += len(block)
                    if held > 4 << 20:
                        yield batch(done, pieces)
                        done, pieces, held = [], [], 0
        if cutter:
            cutter.end()
        yield batch(done, pieces)

    wp, pp = to_arrow(whole), to_arrow(PIECE)

    def batch(done, pieces):
        a = pa.array([dict(zip(wp.names, x)) for x in done] + [None] * len(pieces), pa.struct(wp))
        p = pa.array([None] * len(done) + [dict(zip(pp.names, x)) for x in pieces], pa.struct(pp))
        return pa.RecordBatch.from_arrays([a, p], ["whole", "piece"])

    # both kinds of record come from one scan, which is written so that it is not repeated for each
    at = new_path(spark, "scan")
    lines.mapInArrow(scan, f"whole struct<{whole.replace(' ', ':').replace(',:', ',')}>, piece struct<{PIECE.replace(' ', ':').replace(',:', ',')}>").write.option("compression", "zstd").parquet(at)
    both = spark.read.parquet(at)
    done = both.where("whole is not null").select("whole.*")
    # repeated rows repeat each segment: one of each is kept and the number of first ones counted
    pieces = both.where("piece is not null").select("piece.*").groupBy("origin", "number").agg(
        F.first("data").alias("data"), F.max("total").alias("total"), F.first("page_id").alias("page_id"), F.max("digest").alias("digest"), F.count(F.lit(1)).alias("copies")
    )
    groups = pieces.groupBy("origin").agg(
        F.sort_array(F.collect_list(F.struct("number", "data"))).alias("parts"), F.max("total").alias("total"), F.first("page_id").alias("page_id"), F.max("digest").alias("digest"), F.max("copies").alias("copies")
    )

    def joined(batches):
        for b in batches:
            out = []
            for origin, parts, total, page, digest, copies in zip(*(b.column(i).to_pylist() for i in range(6))):
                block = b"".join(x["data"] for x in parts)
                if [x["number"] for x in parts] != list(range(1, len(parts) + 1)) or len(block) != total:
                    raise ValueError(f"{origin}: segments are missing, or their length is not the total stated")
                payload = payload_of(block)
                if base32_sha1(payload) != digest:
                    raise ValueError(f"{origin}: the payload does not have the digest stated")
                out += [(page, len(payload), digest, "response", None, len(parts), payload)] * copies
            cols = list(zip(*out)) or [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, wp)], schema=wp)

    return done.unionByName(groups.select("origin", "parts", "total", "page_id", "digest", "copies").mapInArrow(joined, whole))


def to_arrow(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([pa.field(n, kinds[t]) for n, t in (x.split() for x in ddl.split(", "))])


def round_trip(pages: DataFrame, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, min_revisit_bytes, segment_bytes)
    return read_archives(spark, path)
