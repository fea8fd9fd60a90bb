"""Removal of every 200-byte string that occurs twice, by suffix arrays.

Windows are all 200-byte strings of the texts. Each belongs to its anchor, the gram of 48 bytes in it with the least
hash, and equal windows have equal anchors, so they meet when anchors are dealt out by hash. Windows of one anchor form a
stretch. Stretches whose whole content occurs twice are settled by their hash; of the others with the same anchor, the
bytes go to shards. Each shard has its suffix array built by Larsson-Sadakane refinement, doubling the sorted depth of
unsettled groups only, and its common prefixes by Kasai's lower bound; neighbours with 200 bytes in common are
duplicates. An anchor with more than SHARD stretches is split over several shards; their windows, one for each class, are
merged by binary search among those of the other shards. Everything is exact up to 64-bit hashes of equal anchors and
128-bit keys of texts.

Texts are first reduced to distinct ones with their number of copies, in a table bucketed by content key, so that fetching
stretches and applying the result move no text again. A stretch is at most 352 bytes and a shard's group at most SHARD
stretches; what one text needs is bounded by the text.

Defined cases: null text is empty; texts under 200 bytes lose nothing; a text that occurs twice loses all of its bytes if
it has 200; doc_id may be null or repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, id_and_text, partitions, stored

WINDOW, GRAM = 200, 48
ODD = 0x9E3779B97F4A7C15 | 1
_powers: list = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
BYTES = np.random.Generator(np.random.PCG64(20260801)).integers(0, 1 << 63, (2, 256), dtype=np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD and its inverse to the power 0 to n."""
    if len(_powers[0]) <= n:
        for i, base in enumerate((ODD, pow(ODD, -1, 1 << 64))):
            x = np.full(n + 1, base, np.uint64)
            x[0] = 1
            _powers[i] = np.multiply.accumulate(x)
    return _powers[0][: n + 1], _powers[1][: n + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sums(buf: np.ndarray, which: int = 0) -> np.ndarray:
    up, _ = powers(len(buf))
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(BYTES[which][buf] * up[:-1], out=out[1:])
    return out


def strings(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of buf[start:end] out of sums()."""
    _, down = powers(len(prefix) - 1)
    return mixed((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))


def anchors(buf: np.ndarray, ends: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """buf: the bytes of documents, one after the other; ends: where each ends. Every window has as its anchor the gram in it
    with the least hash, the leftmost of equals, and so equal windows have it at the same place. Windows with the same
    anchor follow each other. Returns for each anchor: document, hash of the gram, hash of the stretch, first window, last window."""
    n = len(buf)
    if n < window:
        return (np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    prefix = sums(buf)
    at = np.arange(n - gram + 1)
    g = strings(prefix, at, at + gram)
    val = (g & ~np.uint64((1 << 24) - 1)) | at.astype(np.uint64)
    width, size = window - gram + 1, 1
    m = val
    while size * 2 <= width:
        m = np.minimum(m[:-size], m[size:])
        size *= 2
    if size < width:
        m = np.minimum(m[: len(m) - (width - size)], m[width - size :])
    pick = (m & np.uint64((1 << 24) - 1)).astype(np.int64)  # for each window start, where its anchor is
    doc = np.searchsorted(ends, np.arange(len(pick)), "right")
    ok = np.arange(len(pick)) + window <= ends[doc]
    i = np.flatnonzero(ok)
    if not len(i):
        return (np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    p = pick[i]
    first = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (i[1:] != i[:-1] + 1)])
    last = np.r_[first[1:] - 1, len(i) - 1]
    lo, hi = i[first], i[last]
    return doc[lo], g[p[first]], strings(prefix, lo, hi + window) ^ (p[first] - lo).astype(np.uint64), lo, hi


#: Stretches of one anchor in a shard; rows of one anchor held at once; bytes that are sorted at once.
SHARD, HELD, SORTED = 512, 100_000, 1 << 20
APART = 0xFF  # in no UTF-8 text
PLAIN, MANY, DONE = 0, 1, 2


def suffix_order(buf: np.ndarray) -> np.ndarray:
    """The suffix array of buf, complete: Kasai's bound does not hold in one that is sorted to a fixed depth."""
    n = len(buf)
    key = packed(buf)[:n]
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    slots = np.arange(n)
    fresh = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.full(n + 1, n, np.int64)  # the end counts as greater than any byte
    h = 8
    while True:
        start = np.maximum.accumulate(np.where(fresh, slots, 0))
        rank[order[slots]] = start
        alone = fresh & np.r_[fresh[1:], True]
        slots = slots[~alone]
        if not len(slots):
            return order
        pos = order[slots]
        both = (rank[pos] << 32) | (rank[np.minimum(pos + h, n)] + 1)
        by = np.argsort(both, kind="stable")
        order[slots] = pos[by]
        both = both[by]
        fresh = np.r_[True, both[1:] != both[:-1]]
        h *= 2


def packed(buf: np.ndarray) -> np.ndarray:
    """For each position the next eight bytes as a number, APART beyond the end."""
    n = len(buf)
    wide = np.full((n + 8 + WINDOW + 15) // 8 * 8 + 8, APART, np.uint8)
    wide[:n] = buf
    out = np.empty(len(wide) - 8, np.uint64)
    for o in range(8):
        out[o::8] = wide[o : o + len(wide) - 8].view(">u8")
    return out


def common_prefixes(key: np.ndarray, pos: np.ndarray, before: np.ndarray, step: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Bytes that the suffixes at pos have in common with those before them in the order, up to most (a multiple of 8).
    step: how far pos is from the start of its run of positions. Kasai: one position on, at most one byte is lost; so every
    16th is compared from the first byte on, and the others from what those leave."""
    out = np.zeros(len(pos), np.int64)
    first = step % 16 == 0
    for todo in (np.flatnonzero(first), np.flatnonzero(~first)):
        back = todo - step[todo] % 16
        out[todo] = np.maximum(0, out[back] - (todo - back)) if len(todo) else 0
        live = todo
        while len(live):
            at = out[live]
            x = key[pos[live] + at] ^ key[before[live] + at]
            same = np.where(x == 0, 8, 0)
            odd = x != 0
            if odd.any():
                y = x[odd]
                lead = np.zeros(len(y), np.int64)
                for bits in (32, 16, 8):
                    high = (y >> np.uint64(64 - bits)) == 0
                    lead += np.where(high, bits // 8, 0)
                    y = np.where(high, y << np.uint64(bits), y)
                same[odd] = lead
            out[live] = at + same
            live = live[(same == 8) & (out[live] < most)]
    return np.minimum(out, most)


def repeated(stretches: list[bytes], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window of the stretches, in order: its stretch, its start, and the class of equal windows it is in."""
    sizes = np.array([len(s) for s in stretches], np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    buf = np.frombuffer(b"".join(s + b"\xff" for s in stretches), np.uint8)
    n_win = np.maximum(0, sizes - window + 1)
    which = np.repeat(np.arange(len(stretches)), n_win)
    step = np.arange(len(which)) - np.repeat(np.cumsum(n_win) - n_win, n_win)
    pos = starts[which] + step
    order = suffix_order(buf)
    place = np.empty(len(buf), np.int64)
    place[order] = np.arange(len(buf))
    slot = place[pos]
    before = order[np.maximum(slot - 1, 0)]
    lcp = common_prefixes(packed(buf), pos, before, step, window)
    new = np.ones(len(buf), np.int64)
    new[slot[(lcp >= window) & (slot > 0)]] = 0
    return which, step, np.cumsum(new)[slot]


def batches_of(columns, names, kinds):
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)


I64, I32, I8, BIN = pa.int64(), pa.int32(), pa.int8(), pa.binary()
MARK = ["k1", "k2", "lo", "hi", "h", "shard", "split", "settled"]
MARKED = "k1 long, k2 long, lo long, hi long, h long, shard int, split boolean, settled boolean"


def find_anchors(batches):
    """k1, k2, text -> h, c, k1, k2, at (first window, and their number less one in the last byte) and state. Stretches that
    occur twice in a piece of a batch are settled there (DONE, dealt out by any hash); one of them goes on for the others (MANY)."""
    names, kinds = ["h", "c", "k1", "k2", "at", "state"], [I64] * 5 + [I8]
    for b in batches:
        k1, k2 = (b.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        texts = [t.encode() for t in b.column(2).to_pylist()]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= 1 << 20):
                size += len(texts[j])
                j += 1
            whole = b"".join(texts[i:j])
            # a text over 8 MB is taken in overlapping pieces, so that positions fit the minimum's low bits
            for off in range(0, max(1, len(whole) - WINDOW + 1), 8 << 20):
                buf = np.frombuffer(whole[off : off + (8 << 20) + WINDOW - 1], np.uint8)
                ends = np.array([len(buf)]) if j == i + 1 else np.cumsum([len(t) for t in texts[i:j]])
                doc, h, c, lo, hi = anchors(buf, ends)
                base = (np.cumsum([0, *(len(t) for t in texts[i : j - 1])]))[doc] - off
                at = ((lo - base) << 8) | (hi - lo)
                order = np.lexsort((c, h))
                new = np.r_[True, (h[order][1:] != h[order][:-1]) | (c[order][1:] != c[order][:-1])][: len(h)]
                size = np.diff(np.r_[np.flatnonzero(new), len(h)])
                state = np.zeros(len(h), np.int8)
                state[order] = np.where(np.repeat(size, size) > 1, np.where(new, MANY, DONE), PLAIN)
                h = np.where(state == DONE, mixed(h ^ at.astype(np.uint64) ^ k1[i + doc].view(np.uint64)), h)
                yield batches_of([h.view(np.int64), c.view(np.int64), k1[i + doc], k2[i + doc], at, state], names, kinds)
            i = j


def judge(rows: list[np.ndarray], base: int, forced: bool):
    """rows: whole anchors, or with forced a part of one, whose shards are numbered from base. A MARK batch and the number of shards."""
    done = rows[5] == DONE
    settled_before = [x[done] for x in rows]
    h, c, k1, k2, at, state = (x[~done] for x in rows)
    if not len(h):
        return marked(settled_before, np.zeros(0, np.int32), np.zeros(0, bool), [h, c, k1, k2, at]), 0
    gram = np.r_[True, h[1:] != h[:-1]]
    first = np.flatnonzero(gram | np.r_[True, c[1:] != c[:-1]])  # of each kind of stretch
    size = np.diff(np.r_[first, len(h)])
    many = np.maximum.reduceat(state, first) == MANY
    settled = np.flatnonzero(np.repeat((size > 1) | many, size))
    group = (np.cumsum(gram) - 1)[first]
    kinds = np.bincount(group)
    nth = np.arange(len(first)) - (np.cumsum(kinds) - kinds)[group]
    seen = (kinds[group] > 1) | forced
    ask = first[seen]
    shard = base + nth[seen] // SHARD
    split = (kinds[group][seen] > SHARD) | forced
    yes = [np.concatenate([x[settled], y]) for x, y in zip((h, c, k1, k2, at), settled_before)]
    return marked(yes, shard, split, [x[ask] for x in (h, c, k1, k2, at)]), int(nth[-1]) // SHARD + 1


def marked(settled: list[np.ndarray], shard: np.ndarray, split: np.ndarray, ask: list[np.ndarray]):
    """A MARK batch of settled stretches and of those that a shard must see."""
    n, m = len(settled[0]), len(ask[0])
    h, _, k1, k2, at = (np.concatenate([a, b]) for a, b in zip(settled[:5], ask[:5]))
    shards, splits = np.zeros(n + m, np.int32), np.zeros(n + m, bool)
    shards[n:], splits[n:] = shard, split
    return batches_of([k1, k2, at >> 8, (at >> 8) + (at & 255), h, shards, splits, np.arange(n + m) < n], MARK, [I64] * 5 + [I32, pa.bool_(), pa.bool_()])


def classify(batches):
    """Rows of find_anchors, sorted by h, then c -> MARK: settled stretches, and one of each kind whose bytes a shard must see.
    An anchor over HELD rows is judged in parts, each with further shards."""
    held, part_of, base = None, None, 0
    for b in batches:
        if not b.num_rows:
            continue
        rows = [b.column(i).to_numpy(zero_copy_only=False) for i in range(6)]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        h = rows[0]
        last = int(np.flatnonzero(np.r_[True, h[1:] != h[:-1]])[-1])
        begun = 0
        if part_of is not None and (h[0] != part_of or last):
            begun = int(np.argmax(h != part_of)) if h[0] == part_of else 0
            if begun:
                yield judge([x[:begun] for x in rows], base, True)[0]
            part_of, base = None, 0
        if last > begun:
            yield judge([x[begun:last] for x in rows], 0, False)[0]
        held = [x[last:] for x in rows]
        if len(held[0]) > HELD:
            out, shards = judge(held, base, True)
            yield out
            part_of, base, held = h[-1], base + shards, None
    if held is not None:
        yield judge(held, base, part_of is not None)[0]


def fetch(batches):
    """k1, k2, text, wanted (array of lo, hi, h, shard, split) -> one row for each stretch with its bytes."""
    names, kinds = ["h", "shard", "split", "k1", "k2", "lo", "data"], [I64, I32, pa.bool_(), I64, I64, I64, BIN]
    for b in batches:
        out = [[] for _ in names]
        for k1, k2, text, wanted in zip(*(b.column(i).to_pylist() for i in range(4))):
            data = text.encode()
            for w in wanted:
                for column, x in zip(out, (w["h"], w["shard"], w["split"], k1, k2, w["lo"], data[w["lo"] : w["hi"] + WINDOW])):
                    column.append(x)
            if len(out[0]) > 20_000:
                yield batches_of(out, names, kinds)
                out = [[] for _ in names]
        yield batches_of(out, names, kinds)


FOUND = "k1 long, k2 long, lo long, hi long, part int, run binary"
#: A window of a run: its key, whether its shard has it twice, and where it is.
WINDOWS = np.dtype([("w1", "<u8"), ("w2", "<u8"), ("known", "?"), ("k1", "<i8"), ("k2", "<i8"), ("lo", "<i8")])


def sort_shards(batches, parts: int):
    """Stretches by h and shard -> duplicate windows lo to hi of texts; of split anchors also the shard's sorted run of window
    keys, one for each class of equal windows, cut into `parts` ranges of keys."""
    names, kinds = ["k1", "k2", "lo", "hi", "part", "run"], [I64] * 4 + [I32, BIN]
    held, size = [], 0

    def sorted_out():
        split = np.array([r[2] for r in held])
        k1, k2, lo = (np.array([r[i] for r in held], np.int64) for i in (3, 4, 5))
        which, step, kind = repeated([r[6] for r in held])
        n = np.bincount(kind)
        twice = n[kind] > 1
        i = np.flatnonzero(twice)
        cut = np.r_[True, (which[i][1:] != which[i][:-1]) | (i[1:] != i[:-1] + 1)] if len(i) else np.zeros(0, bool)
        a = i[cut]
        e = i[np.r_[np.flatnonzero(cut)[1:] - 1, len(i) - 1]] if len(i) else i
        cols = [k1[which[a]], k2[which[a]], lo[which[a]] + step[a], lo[which[a]] + step[e]]
        yield batches_of([*cols, [None] * len(a), [None] * len(a)], names, kinds)
        if split.any():
            s = np.flatnonzero(split[which])
            s = s[np.unique(kind[s], return_index=True)[1]]  # one of each class
            buf = np.frombuffer(b"".join(r[6] for r in held), np.uint8)
            at = (np.cumsum([0, *(len(r[6]) for r in held)])[:-1])[which[s]] + step[s]
            run = np.empty(len(s), WINDOWS)
            run["w1"], run["w2"] = (strings(sums(buf, x), at, at + WINDOW) for x in (0, 1))
            run["known"], run["k1"], run["k2"], run["lo"] = twice[s], k1[which[s]], k2[which[s]], lo[which[s]] + step[s]
            run = run[np.argsort(run["w1"], kind="stable")]
            part = ((run["w1"] >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
            ends = np.searchsorted(part, np.arange(parts + 1))
            some = np.flatnonzero(ends[1:] > ends[:-1])
            none = [None] * len(some)
            yield batches_of([none, none, none, none, some, [run[ends[i] : ends[i + 1]].tobytes() for i in some]], names, kinds)

    for b in batches:
        for row in zip(*(b.column(i).to_pylist() for i in range(7))):
            if held and size > SORTED and row[:2] != held[-1][:2]:
                yield from sorted_out()
                held, size = [], 0
            held.append(row)
            size += len(row[6])
    if held:
        yield from sorted_out()


def merge_shards(batches):
    """Runs sorted by part -> windows of shards that another shard has too, found by binary search in the merged run of a range."""

    def met(runs):
        run = np.concatenate(runs)
        order = np.lexsort((run["w2"], run["w1"]))
        w1, w2 = run["w1"][order], run["w2"][order]
        first = np.flatnonzero(np.r_[True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])])
        copies = np.empty(len(run), np.int64)
        copies[order] = np.diff(np.r_[first, len(run)])[np.searchsorted(first, np.arange(len(run)), "right") - 1]
        i = np.flatnonzero((copies > 1) & ~run["known"])
        return batches_of([run["k1"][i], run["k2"][i], run["lo"][i], run["lo"][i]], ["k1", "k2", "lo", "hi"], [I64] * 4)

    held, of = [], None
    for b in batches:
        for part, run in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if held and part != of:
                yield met(held)
                held = []
            of = part
            held.append(np.frombuffer(run, WINDOWS))
    if held:
        yield met(held)


RESULT = "k1 long, k2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def cut_out(with_bytes: bool):
    """k1, k2, text, copies, spans (windows lo to hi that go) -> RESULT."""

    def run(batches):
        for b in batches:
            out = [[] for _ in range(7)]
            for k1, k2, text, copies, spans in zip(*(b.column(i).to_pylist() for i in range(5))):
                data = text.encode()
                n, goes = len(data), []
                if copies > 1 and n >= WINDOW:
                    goes = [[0, n]]
                else:
                    for lo, hi in sorted((s["lo"], s["hi"] + WINDOW) for s in spans or ()):
                        if goes and lo <= goes[-1][1]:
                            goes[-1][1] = max(goes[-1][1], hi)
                        else:
                            goes.append([lo, hi])
                ends = [0, *(x for g in goes for x in g), n]
                kept = b"".join(data[ends[i] : ends[i + 1]] for i in range(0, len(ends), 2))
                row = (k1, k2, n, n - len(kept), len(goes), hashlib.sha256(kept).hexdigest(), kept if with_bytes else None)
                for column, x in zip(out, row):
                    column.append(x)
            yield batches_of(out, [x.split()[0] for x in RESULT.split(", ")], [I64] * 5 + [pa.string(), BIN])

    return run


def content_keys(docs: DataFrame) -> DataFrame:
    d = id_and_text(docs)
    return d.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit("other"), "text").alias("k2"))


def remove_repeats(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept (the bytes that remain) if asked for."""
    spark = docs.sparkSession
    n = partitions(spark)
    keyed = content_keys(docs)
    texts = bucketed(keyed.groupBy("k1", "k2").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies")), "texts", "k1", "k2")
    found = texts.where(F.octet_length("text") >= WINDOW).select("k1", "k2", "text").mapInArrow(find_anchors, "h long, c long, k1 long, k2 long, at long, state byte")
    marks = found.repartition(n, "h").sortWithinPartitions("h", "c").mapInArrow(classify, MARKED)
    marks = stored(marks, "marks")
    wanted = marks.where("not settled").groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi", "h", "shard", "split")).alias("wanted"))
    asked = texts.join(wanted, ["k1", "k2"]).select("k1", "k2", "text", "wanted").mapInArrow(fetch, "h long, shard int, split boolean, k1 long, k2 long, lo long, data binary")
    parts = max(256, n)
    shards = asked.repartition(n, "h", "shard").sortWithinPartitions("h", "shard").mapInArrow(lambda b: sort_shards(b, parts), FOUND)
    shards = stored(shards, "shards")
    again = shards.where("run is not null").select("part", "run").repartition(n, "part").sortWithinPartitions("part").mapInArrow(merge_shards, "k1 long, k2 long, lo long, hi long")
    spans = marks.where("settled").select("k1", "k2", "lo", "hi").unionByName(shards.where("run is null").select("k1", "k2", "lo", "hi")).unionByName(again)
    spans = spans.groupBy("k1", "k2").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    done = texts.join(spans, ["k1", "k2"], "left").select("k1", "k2", "text", "copies", "spans").mapInArrow(cut_out(with_bytes), RESULT)
    done = stored(done, "cut")
    out = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_bytes else [])]
    return keyed.select("doc_id", "k1", "k2").join(done, ["k1", "k2"]).select("doc_id", *out)
