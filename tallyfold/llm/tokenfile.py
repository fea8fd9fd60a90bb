"""Token ids of a corpus as coded files, and the files read back.

Writing: documents are sorted by ranges of doc_id; each range is one shard. A task encodes its shard's texts, appends END to
each and cuts the ids into blocks of BLOCK. A block is coded by itself with an adaptive range coder. Three models predict
an id: those of order 2 and order 1 keep, under the two ids or the one id before, one candidate and a confidence, and for
each confidence the share of hits so far; that of order 0 counts the ids' high bytes. Their forecasts are mixed with weights
that follow Bayes' rule with a fixed share, so P(id) is the weighted sum of what they forecast. Candidates and confidences
change with every id, weights and shares of hits after RENEW ids, from every other id of them. The mixture drives three
steps of the coder: candidate of order 2, candidate of order 1, or another; another is coded as a high byte by the counts
of order 0, and its low byte stands as it is behind the coder's words. Blocks of a shard are coded side by side, one to a lane of numpy arrays, and
coder and decoder share the models' code. Arithmetic is in whole numbers and in sums, products and quotients of floating
point, which are the same on every machine with IEEE 754.

The files are Parquet, a row for each block: shard, block, first id's place in the shard, ids, CRC-32 of the ids (32 bits,
little-endian), the coded bytes, and the documents that have ids in it with their start in the shard and their length.
Reading decodes blocks wherever their rows lie, in any split, checks each block's CRC-32 and cuts documents out; a document
over several blocks is put together from its pieces' lengths and CRC-32s, so no task reads a whole document or shard.

Texts are encoded by chunks: the vocabulary's pattern matches no white space and its normaliser composes nothing across it,
so the ids are those of the whole text, and a chunk seen before is looked up. New parts of simple texts are encoded together.

Defined cases: null text is empty, and has END alone; a null doc_id sorts first; rows with the same doc_id sort by text,
equal rows stand in any order; an empty table makes no block and an empty result; other columns are ignored; a text of any
length spans as many blocks as it needs. A block whose CRC-32 differs, or a document with missing pieces, raises.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_path, partitions, stored

VOCABULARY, END = "word_bpe_49k.json", 2
#: Ids in a block, blocks coded side by side, distinct chunks that a worker remembers, and new parts encoded together.
BLOCK, LANES, CHUNKS, TOGETHER = 2048, 4096, 1 << 19, 64
#: Contexts of a block under order 1 and candidates of each, the first that of order 1 and the others those of order 2 with the
#: same last id (powers of two, 16 bytes a context), and confidences of a candidate.
SLOTS1, WAYS, SURE = 1024, 4, 8
#: Bits of the coder's frequencies for candidates and for high bytes, and ids after which high bytes are counted anew, then
#: after twice as many each time.
SCALE, SCALE0, ANEW = 12, 10, 32
#: Ids after which weights and hit shares are renewed (at a block's begin sooner), of which every other one counts; least share
#: of a model's weight, an id's share under a model that did not name it, and rate of hit shares.
RENEW, SHARE, ELSE, RATE = 64, 0.02, 1 / 256, 1 / 8
#: Bits of a word of the coder, whose range has two words at most.
WORD = 24
U, ONE = np.uint32, np.float32(1)
#: By confidence, and whether the candidate was hit (8): what is added to a slot. A hit raises the confidence, a miss halves it,
#: and a candidate without any gives way.
MOVED = np.array([-((c + 1) >> 1) for c in range(SURE)] + [c < SURE - 1 for c in range(SURE)]).astype(U)
#: The part of a hit share that n more ids leave.
LEFT = np.cumprod([ONE, *[np.float32(1 - RATE)] * RENEW], dtype=np.float32)


class Models:
    """The mixture over `lanes` blocks. Each step: forecast(), then learned() with the ids that came."""

    def __init__(self, lanes: int):
        lane = np.arange(lanes)
        self.lines = np.zeros(lanes * SLOTS1, np.complex128)  # a context's candidates, moved as one value
        start = np.linspace(0.05, 0.9, SURE, dtype=np.float32)
        self.hits1, self.hits2 = np.tile(start, (lanes, 1)), np.tile(start, (lanes, 1))
        self.w0, self.w1, self.w2 = (np.full(lanes, 1 / 3, np.float32) for _ in range(3))
        # ids are ranks of merges: small ones are likelier before any is seen
        self.counts = np.tile((8 / (1 + np.arange(256))).astype(np.float32), lanes)
        self.base, self.base_hits, self.base_met, self.base_line = lane * SLOTS1, lane * SURE, lane * (2 * SURE), lane * WAYS
        self.line, self.at2, self.way = self.base, self.base_line + 1, self.base_line + 1
        self.met1, self.met2 = np.zeros((RENEW // 2, lanes), np.uint8), np.zeros((RENEW // 2, lanes), np.uint8)
        self.highs, self.others, self.counted = np.zeros((BLOCK // 2, lanes), np.uint8), np.zeros((BLOCK // 2, lanes), bool), 0
        self.steps, self.since = 0, 0
        self.weighed()
        self.count_anew()

    def weighed(self) -> None:
        """By lane and confidence, the frequencies of 2 ** SCALE that the candidates of order 1 and 2 have."""
        scale = np.float32((1 << SCALE) - 64)
        self.parts1, self.parts2 = ((np.floor(p * (w * scale)[:, None]) + np.float32(16)).astype(np.float64).reshape(-1) for p, w in ((self.hits1, self.w1), (self.hits2, self.w2)))

    def renewed(self) -> None:
        """Weights by Bayes' rule and hit shares, after the ids since the last time."""
        rows = self.since + 1 >> 1
        # likelihoods in proportion to the root of ELSE for each id: a power of two, and products stay within the numbers' range
        other = ELSE**0.5
        m0, m, self.since = self.w0 * other**rows, [], 0
        for name, w, met in (("hits1", self.w1, self.met1[:rows]), ("hits2", self.w2, self.met2[:rows])):
            p = getattr(self, name)
            likely = np.hstack([(ONE - p) * other, p / other]).astype(np.float64).reshape(-1)
            at = met + self.base_met
            m.append(w * np.multiply.reduce(likely.take(at, mode="clip"), axis=0))
            of = np.bincount(at.reshape(-1), minlength=len(likely)).reshape(-1, 2 * SURE)
            hit, found = of[:, SURE:], of[:, :SURE] + of[:, SURE:]
            share = (hit / np.maximum(found, 1)).astype(np.float32)
            setattr(self, name, share + (p - share) * LEFT.take(found))
        back = (1 - 3 * SHARE) / (m0 + m[0] + m[1])
        self.w0, self.w1, self.w2 = ((x * back + SHARE).astype(np.float32) for x in (m0, *m))
        self.weighed()

    def count_anew(self) -> None:
        """Of 2 ** SCALE0 slots of each lane, which high byte has which: spans (begin and size, moved as one value). Each byte has one
        at least."""
        new = slice(self.counted, self.steps)
        lane, place = np.nonzero(np.ascontiguousarray(self.others[new].T))  # a lane's places together
        self.counts += np.bincount((lane << 8) + np.ascontiguousarray(self.highs[new].T)[lane, place], minlength=len(self.counts))
        self.counted, self.cut = self.steps, None
        c = self.counts.reshape(-1, 256)
        size = (c * (np.float32((1 << SCALE0) - 256) / c.sum(1, keepdims=True))).astype(U) + U(1)
        size[:, 255] += U(1 << SCALE0) - size.sum(1, dtype=U)
        self.size = size.reshape(-1)
        spans = np.empty((len(self.size), 2), np.uint16)
        spans[:, 0], spans[:, 1] = (np.cumsum(size, 1, dtype=U) - size).reshape(-1), self.size
        self.spans = spans.view(U).reshape(-1)

    def slots(self) -> np.ndarray:
        """The high byte of each of the slots, lane by lane."""
        if self.cut is None:
            self.cut = np.repeat(np.tile(np.arange(256, dtype=np.uint8), len(self.size) >> 8), self.size)
        return self.cut

    def forecast(self) -> None:
        """one, two: the candidates; f1, f2: their frequencies of 2 ** SCALE; what is left is another id's."""
        self.slots_of = self.lines.take(self.line, mode="clip").view(U)
        self.slot1, self.slot2 = self.slots_of[::WAYS].copy(), self.slots_of.take(self.at2, mode="clip")
        self.one, self.two = self.slot1 >> U(3), self.slot2 >> U(3)
        self.sure1, self.sure2 = (self.slot1 & U(7)).astype(np.uint8), (self.slot2 & U(7)).astype(np.uint8)
        self.f1 = self.parts1.take(self.base_hits + self.sure1, mode="clip")
        self.f2 = self.parts2.take(self.base_hits + self.sure2, mode="clip")
        same = self.f1 - 16
        same *= self.one == self.two
        self.f1 -= same
        self.f2 += same
        self.named = self.f1 + self.f2

    def learned(self, ids: np.ndarray) -> None:
        fresh, eight, row = ids << U(3), np.uint8(SURE), self.since >> 1
        for slot, sure, candidate, met, at in ((self.slot1, self.sure1, self.one, self.met1[row], slice(0, None, WAYS)), (self.slot2, self.sure2, self.two, self.met2[row], self.at2)):
            np.multiply(candidate == ids, eight, out=met)
            met |= sure
            slot += MOVED.take(met, mode="clip")
            self.slots_of[at] = np.where(met == 0, fresh, slot)
        self.lines[self.line] = self.slots_of.view(np.complex128)
        mixed = ids * U(2654435761)
        self.line = self.base + (mixed >> U(33 - SLOTS1.bit_length()))
        self.at2, self.way = self.way, self.base_line + np.maximum(mixed >> U(16) & U(WAYS - 1), U(1))
        self.steps += 1
        self.since += 1
        seldom = self.steps & (self.steps - 1) == 0
        if self.since == RENEW or seldom and self.steps < RENEW:
            self.renewed()
        if seldom and self.steps >= ANEW:
            self.count_anew()

    def span(self, at: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the high bytes at these places; where no other id comes, all slots."""
        found = self.spans.take(at, mode="clip").view(np.uint16)
        return found[::2] * other, np.where(other, found[1::2], np.uint16(1 << SCALE0))

    def came(self, high: np.ndarray, other: np.ndarray) -> None:
        """Keeps the high bytes of other ids, while they will be counted anew."""
        if self.steps < BLOCK // 2:
            self.highs[self.steps], self.others[self.steps] = high, other


#: Numbers of the coder are whole and under 2 ** 53, so double precision has them exactly, and their quotients' whole parts.
LEAST, WHOLE = float(1 << WORD), float(1 << 2 * WORD)


class Coder:
    """Range coders side by side: low has two words and its carry goes into the word before; a word leaves when the range is
    under one. An id takes both its steps before that: the range keeps a 128th of a word's size then."""

    #: Words of a block at most: an id costs under 17.3 bits, 7.1 for the candidates and 10.2 for a high byte.
    MOST = BLOCK * 3 // 4 + 64

    def __init__(self, lanes: int):
        self.low, self.range = np.zeros(lanes), np.full(lanes, WHOLE)
        # a row for each word and a column for each lane, in one
        self.words, self.lanes, self.at = np.zeros(self.MOST * lanes, U), lanes, np.arange(lanes)

    def put(self, *steps) -> None:
        """steps: begin, size and bits of each."""
        low, r = self.low, self.range
        for start, size, bits in steps:
            r *= 1 / (1 << bits)
            np.floor(r, out=r)
            low += r * start
            r *= size
        if (over := np.flatnonzero(low >= WHOLE)).size:
            self.words[self.at.take(over) - self.lanes] += U(1)
            low[over] -= WHOLE
        if (full := np.flatnonzero(r < LEAST)).size:
            at, part = self.at.take(full), low.take(full)
            word = np.floor(part * (1 / LEAST))
            self.words[at] = word
            self.at[full] = at + self.lanes
            low[full] = (part - word * LEAST) * LEAST
            r[full] = r.take(full) * LEAST

    def ended(self) -> list[bytes]:
        """The words of each lane, little-endian, with the carries passed on."""
        self.words[self.at] = np.ceil(self.low * (1 / LEAST))  # what lies behind is nought
        n = self.at // self.lanes + 1
        words = self.words.reshape(-1, self.lanes)[: int(n.max())]
        for i in range(len(words) - 1, 0, -1):
            words[i - 1] += words[i] >> U(WORD)
        out = np.ascontiguousarray(words.T).astype("<u4", copy=False).view(np.uint8).reshape(self.lanes, -1, 4)
        return [out[i, :k, : WORD // 8].tobytes() for i, k in enumerate(n.tolist())]


def coded(ids: np.ndarray) -> list[bytes]:
    """The coded bytes of each row of ids, a matrix of lanes and BLOCK: number of words (4 bytes), words, low bytes."""
    lanes, columns = len(ids), np.ascontiguousarray(ids.T.astype(U))
    m, c = Models(lanes), Coder(lanes)
    plain, base = np.zeros(columns.shape, bool), np.arange(lanes) << 8
    for t, x in enumerate(columns):
        m.forecast()
        is2, is1 = m.two == x, m.one == x
        other = np.logical_or(is2, is1, out=plain[t])
        np.logical_not(other, out=other)
        start, size = np.where(is1, m.f2, m.named), np.where(is2, m.f2, np.where(is1, m.f1, (1 << SCALE) - m.named))
        start *= ~is2
        high = x >> U(8)
        c.put((start, size, SCALE), (*m.span(base + high, other), SCALE0))
        m.came(high, other)
        m.learned(x)
    low, plain = ids.astype(np.uint8), np.ascontiguousarray(plain.T)
    return [np.uint32(len(w) // (WORD // 8)).tobytes() + w + row[p].tobytes() for w, row, p in zip(c.ended(), low, plain)]


def decoded(blocks: list[bytes]) -> np.ndarray:
    """The ids, a row of BLOCK for each block."""
    size, lanes = WORD // 8, len(blocks)
    n = np.array([int.from_bytes(b[:4], "little") for b in blocks])
    words = np.frombuffer(b"".join(b[4 : 4 + size * k] + bytes(2 * size) for b, k in zip(blocks, n.tolist())), np.uint8).reshape(-1, size)
    words = sum(words[:, i].astype(np.float64) * (1 << 8 * i) for i in range(size))
    at = np.cumsum(n + 2) - (n + 2)
    last, value = at + n + 1, words[at] * LEAST + words[at + 1]
    at += 2
    lows = np.frombuffer(b"".join(b[4 + size * k :] for b, k in zip(blocks, n.tolist())) + b"\0", np.uint8)
    n = np.array([len(b) - 4 - size * k for b, k in zip(blocks, n.tolist())])
    low_at = np.cumsum(n) - n

    m, out, r = Models(lanes), np.empty((BLOCK, lanes), U), np.full(lanes, WHOLE)
    most, base, base_slots = (1 << SCALE0) - 1, np.arange(lanes) << 8, np.arange(lanes) << SCALE0
    for t, x in enumerate(out):
        m.forecast()
        r *= 1 / (1 << SCALE)
        np.floor(r, out=r)
        to2, to1 = r * m.f2, r * m.named
        is2, other = value < to2, value >= to1
        start, size = np.where(other, to1, to2), np.where(is2, m.f2, np.where(other, (1 << SCALE) - m.named, m.f1))
        start *= ~is2
        value -= start
        r *= size
        r *= 1 / (1 << SCALE0)
        np.floor(r, out=r)
        high = m.slots().take(base_slots + np.minimum(value / r, most).astype(np.int64), mode="clip")
        start, size = m.span(base + high, other)
        value -= r * start
        r *= size
        np.copyto(x, high)
        x <<= U(8)
        x |= lows.take(low_at, mode="clip")
        low_at += other
        m.came(high, other)
        x[:] = np.where(is2, m.two, np.where(other, x, m.one))
        if (full := np.flatnonzero(r < LEAST)).size:
            of = at.take(full)
            value[full] = value.take(full) * LEAST + words.take(of, mode="clip")
            r[full] = r.take(full) * LEAST
            at[full] = np.minimum(of + 1, last.take(full))  # a damaged block reads no other's words
        m.learned(x)
    return np.ascontiguousarray(out.T)


def crc_powers(n: int = 44) -> np.ndarray:
    """[k, byte, value]: what a byte of a CRC-32 becomes after 2 ** k more zero bytes."""
    step = np.array([zlib.crc32(bytes([i])) for i in range(256)], np.uint32)
    step ^= step[0]  # linear: without the inversions
    byte = np.arange(256, dtype=np.uint32) << np.arange(0, 32, 8, dtype=np.uint32)[:, None]
    out = [step[byte & 255] ^ byte >> 8]
    for _ in range(n - 1):
        out.append(shifted_once(out[-1], out[-1]))
    return np.array(out)


def shifted_once(power: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return power[0][crc & 255] ^ power[1][crc >> 8 & 255] ^ power[2][crc >> 16 & 255] ^ power[3][crc >> 24]


POWERS = crc_powers()


def crc_shift(crc: np.ndarray, n: np.ndarray) -> np.ndarray:
    """CRC-32s after n more zero bytes each. The CRC-32 of a concatenation is the sum (xor) of its parts' CRC-32s, each shifted
    by the bytes behind its part."""
    crc = crc.astype(np.uint32)
    for k in range(int(n.max(initial=0)).bit_length()):
        crc = np.where(n >> k & 1, shifted_once(POWERS[k], crc), crc)
    return crc


#: Texts of ASCII and the Latin-1 letters beyond it: these have one form, and their lower case is a letter for a letter.
SIMPLE = r"^[\x00-\x7fÀ-ÖØ-öø-ÿ]*$"
#: How the vocabulary's pattern sees a byte of such a text in lower case.
WHITE, LETTER, DIGIT, SIGN = range(4)
BLANKS = b"\t\n\v\f\r "
#: Lower case of such a text's bytes: the second byte of a letter beyond ASCII tells its case.
LOWER = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))
KINDS = bytes(WHITE if b in BLANKS else LETTER if 97 <= b <= 122 or b >= 128 else DIGIT if 48 <= b <= 57 else SIGN for b in range(256))
#: The letters that the vocabulary's contractions have behind the apostrophe.
SHORT1, SHORT2 = np.isin(np.arange(256), list(b"smdt")), [int.from_bytes(x, "big") for x in (b"re", b"ve", b"ll")]


def byte_letters() -> np.ndarray:
    """The character that stands for each byte in vocabularies of bytes; the blank is left, for it never is within a part."""
    out, n = np.arange(256, dtype="<u4"), 0
    for b in range(256):
        if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174):
            out[b] = b if b == 32 else 256 + n
            n += 1
    return out


LETTERS = byte_letters()


def parts_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The parts that the vocabulary's pattern cuts of simple texts, in lower case and one after the other, and how many each text has."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    plain = bytes(memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]).translate(LOWER)
    ends -= ends[0]
    data, kind = np.frombuffer(plain, np.uint8), np.frombuffer(plain.translate(KINDS), np.uint8)
    begins = np.ones(len(data), bool)
    np.not_equal(kind[1:], kind[:-1], out=begins[1:])
    begins |= kind == DIGIT
    begins[ends[:-1][ends[:-1] < len(data)]] = True
    begins &= kind != WHITE
    mark = np.flatnonzero((data == ord("'")) & begins)
    if mark.size:
        end = ends[np.searchsorted(ends, mark, "right")]
        after = np.concatenate([data, np.zeros(2, np.uint8)]).astype(np.int64)
        one, two = after[mark + 1], after[mark + 1] << 8 | after[mark + 2]
        size = np.where(SHORT1[one] & (mark + 1 < end), 2, np.where(np.isin(two, SHORT2) & (mark + 2 < end), 3, 0))
        mark, end, size = mark[size > 0], end[size > 0], size[size > 0]
        begins[mark + 1] = False
        mark += size
        begins[mark[(mark < end) & (kind.take(mark, mode="clip") != WHITE)]] = True
    first, solid = np.flatnonzero(begins), plain.translate(None, BLANKS)
    before = (kind != WHITE).astype(np.int32)
    offsets = np.append(np.cumsum(before, dtype=np.int32, out=before).take(first) - np.int32(1), np.int32(len(solid)))
    flat = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(solid))
    return flat, np.diff(np.searchsorted(first, ends))


class Memory:
    """The ids of strings seen before: each has a number, and the ids of number k are ids[begin[k] : begin[k + 1]]."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.begin, self.ids = np.zeros(1, np.int64), np.empty(0, "<u4")

    def numbers(self, names: list[str], encode) -> np.ndarray:
        """encode: the ids of a list of strings, one after the other, and how many each has. A string is encoded once."""
        found = np.fromiter(map(self.number.get, names, repeat(-1)), np.int64, len(names))
        fresh = np.flatnonzero(found < 0)
        if len(self.number) + len(fresh) > CHUNKS and self.number:
            self.__init__()
            return self.numbers(names, encode)
        if fresh.size:
            new = [names[i] for i in fresh.tolist()]
            ids, sizes = encode(new)
            n = len(self.number)
            self.number.update(zip(new, range(n, n + len(new))))
            found[fresh] = np.arange(n, n + len(new))
            self.ids = np.concatenate([self.ids, ids])
            self.begin = np.concatenate([self.begin, self.begin[-1] + np.cumsum(sizes)])
        return found

    def looked_up(self, flat: pa.Array, counts: np.ndarray, encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all strings, none with a blank, one after the other; counts: strings of each text; how many ids each text has."""
        flat = flat.dictionary_encode()
        words = flat.dictionary
        names = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py().split(" ") if len(words) else []
        own = self.numbers(names, encode)[flat.indices.to_numpy()]
        starts = self.begin.take(own, mode="clip")
        n = self.begin.take(own + 1, mode="clip") - starts
        ends = np.cumsum(n)
        place = np.repeat(starts - (ends - n), n)
        place += np.arange(len(place))
        total = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        return self.ids.take(place, mode="clip"), np.diff(total)


_encoders: dict = {}


class Encoder:
    """The tokenizer with a memory of parts of texts. Simple texts are cut into the pattern's parts, in lower case, which skip
    the tokenizer's normaliser and pattern: new ones are encoded together, in the vocabulary's letters for bytes and with blanks
    between them, and each ends with the one id of its end. Any other text, or one that may hold a special token's name, is cut
    at blanks, and the chunks are left to the tokenizer as a whole."""

    def __init__(self, vocabulary: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        if "/" not in vocabulary:
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer, self.bare = Tokenizer.from_file(vocabulary), Tokenizer.from_file(vocabulary)
        self.bare.normalizer = normalizers.Sequence([])
        self.bare.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        tokens = self.bare.get_vocab(with_added_tokens=False)
        self.final = np.zeros(max(tokens.values()) + 1, bool)  # ids that end a part
        self.final[[i for t, i in tokens.items() if t.endswith(self.bare.model.end_of_word_suffix)]] = True
        self.parts, self.chunks = Memory(), Memory()

    def of_parts(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        joined = "\n".join(" ".join(new[k : k + TOGETHER]) for k in range(0, len(new), TOGETHER))
        letters = LETTERS.take(np.frombuffer(joined.encode(), np.uint8)).tobytes().decode("utf-32-le")
        found = self.bare.encode_batch_fast(letters.split(chr(LETTERS[10])), add_special_tokens=False)
        ids = np.concatenate([np.array(e.ids, "<u4") for e in found])
        last = np.flatnonzero(self.final[ids])
        if len(last) != len(new):
            raise ValueError("the vocabulary does not mark the ends of parts")
        return ids, np.diff(last, prepend=-1)

    def of_chunks(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)]
        return np.array([i for x in ids for i in x], "<u4"), np.array(list(map(len, ids)))

    def encoded(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and how many each has."""
        simple = pc.and_(pc.match_substring_regex(texts, SIMPLE), pc.invert(pc.match_substring(texts, "<|")))
        some, some_n = self.parts.looked_up(*parts_of(texts.filter(simple)), self.of_parts)
        cut = pc.ascii_split_whitespace(texts.filter(pc.invert(simple)))
        if not len(cut):
            return some, some_n
        rest, rest_n = self.chunks.looked_up(cut.flatten(), pc.list_value_length(cut).to_numpy(), self.of_chunks)
        mask, sizes = simple.to_numpy(zero_copy_only=False), np.empty(len(texts), np.int64)
        sizes[mask], sizes[~mask] = some_n, rest_n
        of_simple = np.repeat(mask, sizes)
        ids = np.empty(len(of_simple), "<u4")
        ids[of_simple], ids[~of_simple] = some, rest
        return ids, sizes


def encoder_of(vocabulary: str) -> Encoder:
    """One for each vocabulary and Python worker."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = Encoder(vocabulary)
    return _encoders[vocabulary]


DOC = pa.struct([("doc_id", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
FILE = "shard int, block int, first long, n int, crc32 long, coded binary, docs array<struct<doc_id:long,start:long,n:long>>"
FILE_TYPE = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int32()), ("crc32", pa.int64()), ("coded", pa.binary()), ("docs", pa.list_(DOC))])


def with_end(ids: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    return np.insert(ids, np.cumsum(sizes), end)


def coded_blocks(batches, vocabulary: str, end: int):
    """File rows of one shard from its sorted rows (shard, doc_id, text), at most LANES blocks in memory."""
    encoder, held, docs = None, [], []
    ids, block, first, place, shard = np.empty(0, U), 0, 0, 0, None

    def written(ids: np.ndarray, last: bool):
        """Rows of the full blocks in ids, or of all of it."""
        nonlocal block, first, docs
        while len(ids) >= BLOCK or last and len(ids):
            part = ids[: LANES * BLOCK] if last else ids[: min(LANES, len(ids) // BLOCK) * BLOCK]
            ids = ids[len(part) :]
            n = -(-len(part) // BLOCK)
            grid = np.zeros(n * BLOCK, U)
            grid[: len(part)] = part
            rows = []
            for i, data in enumerate(coded(grid.reshape(n, BLOCK))):
                own = part[i * BLOCK : (i + 1) * BLOCK]
                inside = []
                for d in docs:
                    if d["start"] >= first + len(own):
                        break
                    inside.append(d)
                docs = docs[len(inside) - (inside[-1]["start"] + inside[-1]["n"] > first + len(own)) :]
                rows.append((shard, block, first, len(own), zlib.crc32(own.astype("<u4").tobytes()), data, inside))
                block, first = block + 1, first + len(own)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), FILE_TYPE.types)], schema=FILE_TYPE)
        held[:] = [ids]

    for b in batches:
        encoder = encoder or encoder_of(vocabulary)
        if b.num_rows:
            shard = b.column(0)[0].as_py()
        names, texts = b.column(1).to_pylist(), b.column(2)
        size = np.cumsum(pc.binary_length(texts).to_numpy())
        at = 0
        while at < len(texts):  # texts of some MB at a time
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (8 << 20))))
            new, sizes = encoder.encoded(texts.slice(at, to - at))
            for name, n in zip(names[at:to], (sizes + 1).tolist()):
                docs.append({"doc_id": name, "start": place, "n": n})
                place += n
            held.append(with_end(new, sizes, end))
            at = to
            if sum(map(len, held)) >= LANES * BLOCK:
                yield from written(np.concatenate(held), False)
    if held:
        yield from written(np.concatenate(held), True)


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, end: int = END) -> None:
    d = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    key: list[str | Column] = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]  # copies of one doc_id are dealt out too
    d = d.repartitionByRange(partitions(d.sparkSession), *key).sortWithinPartitions(*key, "text")
    d.select(F.spark_partition_id().alias("shard"), "doc_id", "text").mapInArrow(lambda batches: coded_blocks(batches, vocabulary, end), FILE).write.parquet(path)


PIECE = "shard int, start long, doc_id long, n long, size long, crc long"
PIECE_TYPE = pa.schema([("shard", pa.int32()), *[(n, pa.int64()) for n in ("start", "doc_id", "n", "size", "crc")]])


def pieces_of(batches):
    """A row for each document and block that it has ids in; crc: that of the piece, shifted by what follows in the document."""
    for b in batches:
        for lo in range(0, b.num_rows, LANES):
            part = b.slice(lo, LANES)
            n, first, shard = (part[c].to_numpy() for c in ("n", "first", "shard"))
            data = decoded(part["coded"].to_pylist()).astype("<u4", copy=False)
            for k, crc in enumerate(part["crc32"].to_pylist()):
                if zlib.crc32(data[k, : n[k]]) != crc:
                    raise ValueError(f"shard {shard[k]}: the block of ids from {first[k]} does not have the checksum stated")
            docs = part["docs"].flatten()
            names, start, size = (docs.field(c) for c in ("doc_id", "start", "n"))
            start, size = start.to_numpy(), size.to_numpy()
            row = np.repeat(np.arange(len(part)), pc.list_value_length(part["docs"]).to_numpy())
            a, z = np.maximum(start - first[row], 0), np.minimum(start + size - first[row], n[row])
            crcs = np.fromiter((zlib.crc32(data[k, i:j]) for k, i, j in zip(row.tolist(), a.tolist(), z.tolist())), np.int64, len(row))
            crcs = crc_shift(crcs, 4 * (start + size - first[row] - z)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(shard[row]), pa.array(start), names, pa.array(size), pa.array(z - a), pa.array(crcs)], schema=PIECE_TYPE)


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, from the files."""
    files = spark.read.schema(FILE).parquet(path)
    pieces = stored(files.mapInArrow(pieces_of, PIECE), "pieces")
    alone = F.col("size") == F.col("n")
    whole = pieces.where(alone).select("shard", "start", "doc_id", "n", F.col("crc").alias("ids_crc32"))
    parts = pieces.where(~alone).groupBy("shard", "start").agg(F.first("doc_id").alias("doc_id"), F.first("n").alias("n"), F.bit_xor("crc").alias("ids_crc32"), F.sum("size").alias("found"))
    complete = F.when(F.col("found") == F.col("n"), F.col("n")).otherwise(F.raise_error(F.lit("ids of a document are missing")).cast("long"))
    parts = parts.select("shard", "start", "doc_id", complete.alias("n"), "ids_crc32")
    sizes = files.groupBy("shard").agg(F.sum("n").cast("long").alias("ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    offsets = stored(sizes.select("shard", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("before")), "shards")
    both = whole.unionByName(parts).join(offsets, "shard")
    return both.select("doc_id", (F.col("before") + F.col("start")).alias("start"), F.col("n").alias("n_tokens"), "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY, end: int = END) -> DataFrame:
    path = new_path(docs.sparkSession, "ids")
    write_ids(docs, path, vocabulary=vocabulary, end=end)
    return read_ids(docs.sparkSession, path)
