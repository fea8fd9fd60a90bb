"""A Merkle manifest of a table: every row is a leaf, rows of a group form a tree, and the groups' roots form one more.

A node is the lower-case hexadecimal SHA-256 of up to FANOUT hexadecimal children, concatenated. Leaves are numbered in
their group by ranges, without a task that sees a whole group, and dealt out in aligned blocks of FANOUT ** LEVELS leaves.
In a block the digests are one contiguous matrix of bytes, 64 to a row: reshaping it by the fanout gives the input of the
level above, row by row, and index arithmetic gives each node's siblings. Tops of blocks are the leaves of the next step, so
steps are as many as the logarithm of the table to the base of 512 asks for; then the path above each block is sent back
to it, where proofs are made and tampered leaves are folded.

Defined cases: a null value counts as "-", which no other value makes; a null doc_id sorts first, and its text for the
tampering rule is empty; rows repeated whole have equal leaves at neighbouring places, each with its own proof; rows that
share only doc_id sort by leaf; a group of one row has its leaf as subroot, a table of one group its subroot as root, and a
proof without siblings is the hash of nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import numbered, stored

FANOUT, LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
LONGS = ("doc_id", "n_chars")
#: Of each place in a run, the places of the others.
OTHERS = np.array([[j for j in range(FANOUT) if j != i] for i in range(FANOUT)])
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def framed(value: Column) -> Column:
    """Length in bytes, colon and value, so that no two rows run together alike."""
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_of(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[framed(c) for c in fields]), 256)


def matrix(digests: pa.ChunkedArray) -> np.ndarray:
    """Hexadecimal digests as one contiguous matrix, a row for each."""
    return np.frombuffer("".join(digests.to_pylist()).encode(), np.uint8).reshape(-1, 64)


def above(nodes: np.ndarray) -> np.ndarray:
    """The level above: full runs are rows of the matrix reshaped by the fanout, the rest is one short run."""
    full = len(nodes) // FANOUT
    runs = [*np.ascontiguousarray(nodes[: full * FANOUT]).reshape(full, FANOUT * 64), *([nodes[full * FANOUT :].reshape(-1)] if len(nodes) % FANOUT else [])]
    return np.frombuffer("".join(hashlib.sha256(r).hexdigest() for r in runs).encode(), np.uint8).reshape(-1, 64)


def height(n: int, most: int) -> int:
    """Levels above n leaves, and `most` at most."""
    h = 0
    while n > 1 and h < most:
        n, h = -(-n // FANOUT), h + 1
    return h


def levels(leaves: np.ndarray, n: int, most: int) -> list[np.ndarray]:
    """Levels of a block from its leaves to its top; n: leaves of the whole group."""
    out = [leaves]
    for _ in range(height(n, most)):
        out.append(above(out[-1]))
    return out


def siblings(nodes: np.ndarray) -> tuple[list[bytes], list[bytes]]:
    """For each node, what stands left and right of it in its run."""
    full = len(nodes) // FANOUT
    others = nodes[: full * FANOUT].reshape(full, FANOUT, 64)[:, OTHERS].reshape(-1, (FANOUT - 1) * 64)
    text, size = others.tobytes(), (FANOUT - 1) * 64
    left, right = [], []
    for i in range(full * FANOUT):
        cut = i * size + i % FANOUT * 64
        left.append(text[i * size : cut])
        right.append(text[cut : (i + 1) * size])
    rest = nodes[full * FANOUT :].tobytes()
    for i in range(len(nodes) - full * FANOUT):
        left.append(rest[: 64 * i])
        right.append(rest[64 * (i + 1) :])
    return left, right


def top_of_block(t: pa.Table, most: int) -> pa.Table:
    t = t.sort_by("pos")
    n = t["n"][0].as_py()
    top = levels(matrix(t["digest"]), n, most)[-1].tobytes().decode()
    return pa.table({"grp": t["grp"][:1].cast(pa.string()), "pos": t["block"][:1], "digest": [top], "n": pa.array([-(-n // FANOUT**most)], pa.int64())})


PATH = "path array<struct<l:string,r:string>>"
PATH_TYPE = pa.list_(pa.struct([("l", pa.string()), ("r", pa.string())]))


def paths_in_block(t: pa.Table, up: pa.Table, most: int) -> pa.Table:
    """For each node of a block, the siblings of its way to the root of its group: those in the block, then those of the block."""
    t = t.sort_by("pos")
    tree = [siblings(x) for x in levels(matrix(t["digest"]), t["n"][0].as_py(), most)[:-1]]
    rest = [(s["l"], s["r"]) for s in up["path"][0].as_py() or []]
    path = [[(s[0][i // FANOUT**k].decode(), s[1][i // FANOUT**k].decode()) for k, s in enumerate(tree)] + rest for i in range(len(t))]
    return pa.table({"grp": t["grp"].cast(pa.string()), "pos": t["pos"], "path": pa.array([[{"l": a, "r": b} for a, b in p] for p in path], PATH_TYPE)})


def blocks(nodes: DataFrame, depth: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {FANOUT**depth}"))


def paths(nodes: DataFrame, up: DataFrame, depth: int) -> DataFrame:
    """grp, pos and path of every node; up: path above each block."""
    return blocks(nodes, depth).groupBy("grp", "block").cogroup(up.groupBy("grp", "block")).applyInArrow(lambda t, u: paths_in_block(t, u, depth), f"grp string, pos long, {PATH}")


def climbed(nodes: DataFrame, most: int, depth: int) -> tuple[DataFrame, DataFrame]:
    """(root of each group, path above each block) of nodes (grp, pos, digest, n). most: nodes of the largest group."""
    tops = stored(blocks(nodes, depth).groupBy("grp", "block").applyInArrow(lambda t: top_of_block(t, depth), "grp string, pos long, digest string, n long"), "tops")
    if most <= FANOUT**depth:
        return tops.select("grp", F.col("digest").alias("root")), tops.select("grp", F.col("pos").alias("block"), F.expr("cast(array() as array<struct<l:string,r:string>>)").alias("path"))
    roots, up = climbed(tops, -(-most // FANOUT**depth), depth)
    return roots, stored(paths(tops, up, depth).withColumnRenamed("pos", "block"), "paths")


def proofs_in_block(t: pa.Table, up: pa.Table, most: int) -> pa.Table:
    """proof_sha256 of each leaf, and the root that its tampered leaf, if it has one, folds to."""
    t = t.sort_by("pos")
    root = up["root"][0].as_py()
    tree = [siblings(x) for x in levels(matrix(t["digest"]), t["n"][0].as_py(), most)[:-1]]
    rest = [(s["l"].encode(), s["r"].encode()) for s in up["path"][0].as_py() or []]
    after = b"".join(a + b for a, b in rest)
    proof, folded = [], []
    for i, own in enumerate(t["tampered"].to_pylist()):
        way = [(s[0][i // FANOUT**k], s[1][i // FANOUT**k]) for k, s in enumerate(tree)]
        proof.append(hashlib.sha256(b"".join([x for pair in way for x in pair]) + after).hexdigest())
        node = (own or t["digest"][i].as_py()).encode()
        for a, b in way + rest:
            node = hashlib.sha256(a + node + b).hexdigest().encode()
        folded.append(node.decode())
    same = lambda x: pa.array([x] * len(t), pa.string())
    return pa.table({
        "doc_id": t["doc_id"], "leaf": t["digest"].cast(pa.string()), "subroot": same(up["subroot"][0].as_py()), "root": same(root),
        "proof_sha256": proof, "folded_root": folded, "verified": pa.array([f == root for f in folded], pa.bool_()),
    })


OUT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def manifest(docs: DataFrame, group: str = "lang", tamper_every: int = 3, depth: int = LEVELS) -> DataFrame:
    """One row for each row of docs, with its proof and what its tampered copy folds to. Tampered are rows whose doc_id has
    a CRC-32 divisible by tamper_every; 0: none. depth: levels of a block."""
    f = {c: docs[c].cast("long" if c in LONGS else "string").cast("string") for c in FIELDS}
    bad = leaf_of([F.translate(f[c], UPPER, LOWER) if c == "text" else f[c] for c in FIELDS])
    hit = F.crc32(F.coalesce(f["doc_id"], F.lit(""))) % tamper_every == 0 if tamper_every else F.lit(False)
    # the key of a group: nulls first, then by bytes
    grp = F.coalesce(F.concat(F.lit("+"), docs[group].cast("string")), F.lit(""))
    leaves = docs.select(grp.alias("grp"), docs["doc_id"].cast("long").alias("doc_id"), leaf_of(list(f.values())).alias("digest"), F.when(hit, bad).alias("tampered"))
    placed = numbered(leaves, [F.asc_nulls_first("doc_id"), "digest"], "leaves", "grp")
    sizes = stored(placed.groupBy("grp").agg(F.count(F.lit(1)).alias("n")), "sizes")
    placed = stored(placed.join(sizes, "grp"), "placed")
    roots, up = climbed(placed.select("grp", "pos", "digest", "n"), sizes.agg(F.max("n")).first()[0] or 0, depth)
    # the groups' roots are leaves of one more tree
    first = stored(numbered(roots.select(F.lit("").alias("all"), "grp", F.col("root").alias("digest")), ["grp"], "subroots", "all"), "forest")
    n = first.count()
    forest = first.select(F.col("all").alias("grp"), "pos", "digest", F.lit(n).cast("long").alias("n"))
    top, over = climbed(forest, n, depth)
    way = paths(forest, over, depth)
    tail = first.select(F.col("grp").alias("of"), "pos", F.col("digest").alias("subroot")).join(way.select("pos", F.col("path").alias("tail")), "pos")
    root = (top.select("root").first() or [None])[0]
    ends = stored(tail.select("of", "subroot", "tail", F.lit(root).cast("string").alias("root")), "ends")
    up = up.join(ends, F.col("grp") == F.col("of")).select("grp", "block", "subroot", "root", F.concat("path", "tail").alias("path"))
    return blocks(placed, depth).groupBy("grp", "block").cogroup(up.groupBy("grp", "block")).applyInArrow(lambda t, u: proofs_in_block(t, u, depth), OUT)
