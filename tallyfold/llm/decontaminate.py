"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are lower-cased and their white space runs become one blank. An item of n characters may differ in
floor(rate * n) edits from some stretch of a document. It is cut into one piece more than that, so a stretch within budget
has at least one piece unchanged. An Aho-Corasick automaton finds the pieces; the regions that its hits allow are merged
for each item and verified by Myers' bit-parallel distance. Items come in blocks of at most BLOCK_BYTES, one of which is on
the driver and goes to the executors at a time, so neither grows with the benchmark; every block meets every document.
Where there are several blocks, what each finds is stored before the next is read.

Defined cases: null text is empty; items empty after normalisation match nothing; an item too short for one edit at this
rate (under 20 characters at 5 %) must match exactly; repeated items and rows are reported each; an empty table gives an empty result; other columns
are ignored by matches() and kept by decontaminated().
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

RATE, BLOCK_BYTES = 0.05, 4 << 20
SPACE = re.compile(r"\s+")
_built: dict = {}


def plain(text: str | None) -> str:
    return SPACE.sub(" ", (text or "").lower()).strip()


def budget(n: int, rate: float = RATE) -> int:
    return int(rate * n)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(start, piece) of k + 1 pieces as even as can be."""
    n = len(item)
    cuts = [n * i // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(item: str, text: str) -> tuple[int, int]:
    """Least edit distance of the item to any stretch of text, and where the first such stretch ends."""
    n, masks = len(item), {}
    for i, c in enumerate(item):
        masks[c] = masks.get(c, 0) | 1 << i
    full, top = (1 << n) - 1, 1 << n - 1
    up, down, score = full, 0, n
    best, end = n, 0
    for j, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        plus = down | (~(diagonal | up) & full)
        minus = up & diagonal
        score += bool(plus & top) - bool(minus & top)
        plus = plus << 1 & full
        minus = minus << 1 & full
        up = minus | (~(diagonal | plus) & full)
        down = plus & diagonal
        if score < best:
            best, end = score, j
            if not best:
                break
    return best, end


def automaton(items: list[tuple[int, str]], rate: float):
    """Built once for each worker process and block."""
    key = hash((tuple(items), rate))
    if key not in _built:
        a, of = ahocorasick.Automaton(), {}
        for number, (_, item) in enumerate(items):
            for start, piece in pieces(item, budget(len(item), rate)):
                of.setdefault(piece, []).append((number, start))
        for piece, places in of.items():
            a.add_word(piece, (len(piece), places))
        a.make_automaton()
        _built.clear()
        _built[key] = a
    return _built[key]


def search(text: str | None, items: list[tuple[int, str]], rate: float = RATE) -> list[dict]:
    """item_id, distance and where the match ends in the normalised text, for each item within its budget of the text."""
    return scan(text, items, rate, automaton(items, rate)) if items else []


def scan(text: str | None, items: list[tuple[int, str]], rate: float, pieces_of) -> list[dict]:
    text = plain(text)
    spans: dict[int, list] = {}
    for last, (n, places) in pieces_of.iter(text):
        for number, start in places:
            item = items[number][1]
            k = budget(len(item), rate)
            lo = max(0, last + 1 - n - start - k)
            hi = last + 1 - n - start + len(item) + k
            mine = spans.setdefault(number, [])
            if mine and lo <= mine[-1][1] and lo >= mine[-1][0]:
                mine[-1][1] = max(mine[-1][1], hi)
            else:
                mine.append([lo, hi])
    out = []
    for number, regions in sorted(spans.items()):
        item_id, item = items[number]
        best, end = len(item) + 1, 0
        for lo, hi in merged(regions):
            at = text.find(item, lo, hi)
            d, e = (0, at + len(item)) if at >= 0 else myers(item, text[lo:hi])
            if d < best:
                best, end = d, e if at >= 0 else lo + e
            if not best:
                break
        if best <= budget(len(item), rate):
            out.append({"item_id": item_id, "distance": best, "ends": end})
    return out


def merged(regions: list[list[int]]) -> list[list[int]]:
    """Regions in order, those that meet as one."""
    out: list[list[int]] = []
    for lo, hi in sorted(regions):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return out


def blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most BLOCK_BYTES, or one item, one block after the other: an item is dealt to a partition
    by hash, and the driver holds one partition and one block."""
    b = benchmark.select(benchmark[id_col].cast("long").alias("item_id"), benchmark[text_col].cast("string").alias("text"))
    size = b.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    block, size_of = [], 0
    for r in b.repartition(1 + size // BLOCK_BYTES, F.xxhash64("item_id", "text")).toLocalIterator():
        text = plain(r.text)
        if text:
            if block and size_of + len(text) > BLOCK_BYTES:
                yield block
                block, size_of = [], 0
            block.append((r.item_id, text))
            size_of += len(text)
    yield block


def hits(text: Column, block: list[tuple[int, str]], rate: float = RATE) -> Column:
    """Array of (item_id, distance, ends) of a text column."""

    @F.pandas_udf("array<struct<item_id:long,distance:int,ends:int>>")
    def find(texts: pd.Series) -> pd.Series:
        if not block:
            return texts.map(lambda t: [])
        built = automaton(block, rate)
        return texts.map(lambda t: scan(t, block, rate, built))

    return find(text)


def block_by_block(start: DataFrame, benchmark: DataFrame, one: Callable[[DataFrame, list], DataFrame]) -> Iterator[DataFrame]:
    """What one(start, block) gives for each block: stored where another block follows."""
    before = None
    for block in blocks(benchmark):
        if before is not None:
            yield stored(one(start, before), "block")
        before = block
    yield one(start, before)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance and ends, for every document and item within budget."""
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    one = lambda df, block: df.select("doc_id", F.inline(hits(F.col("text"), block, rate)))
    return functools.reduce(DataFrame.unionByName, block_by_block(d, benchmark, one))


def decontaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """docs without the rows that hold an item of the benchmark; each block sees what the blocks before it kept."""
    before = None
    for block in blocks(benchmark):
        if before is not None:
            docs = stored(docs.where(F.size(hits(docs["text"].cast("string"), before, rate)) == 0), "block")
        before = block
    return docs.where(F.size(hits(docs["text"].cast("string"), before, rate)) == 0)
