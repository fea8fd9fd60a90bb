"""SentencePiece encoding by forward filtering and backward sampling over the piece lattice, and lossless decoding.

A vocabulary with log-probabilities is used as it is. One of ranked merges has none, so a piece of rank r gets
-log(r + 2), a Zipf prior; `alpha` sharpens it. The lattice of a text falls apart where no piece crosses: before a blank
that follows another character, and at line ends. So the distinct parts of a batch are filtered forward together, one
numpy step for each character, and the parts of all its rows sampled backward together, one step for each piece.
Characters that are not in the vocabulary become byte pieces. The random number of a step is a hash of the seed, the row's key, the part's
place in the text and the step: results do not depend on partitions or batches. A part too long for the range of a double takes the same products one
by one with its sums scaled by powers of two, which is exact: both ways map a random number to the same piece.

Defined cases: null text is empty and has no pieces; a null key counts as -1; the blank mark in a text is written as
bytes, so that decoding gives back every text exactly; an empty table gives an empty result; rows repeated with one key
and text get the same pieces; other columns are ignored by encoded() and kept by with_pieces().
"""

from __future__ import annotations

import hashlib
import math
import re
from array import array
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA, SEED = 1.0, 20260801
MARK = "▁"
#: A part over this many characters is sampled by itself. Weights of a piece are raised by LIFT for each of its characters, so that products stay in range.
WHOLE, LIFT = 64, 3.0
#: Characters that are sampled together.
TOGETHER = 1 << 18
#: Log-probability of a character written as bytes.
AS_BYTES = -12.0
#: Weight of a character that is in no piece.
STRAY = math.exp(AS_BYTES + LIFT)
#: A line's end; blanks and the word after them; blanks before a line's end.
PART = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
#: The blank becomes the mark of the vocabulary; a mark in the text becomes a blank, which is in no piece.
ROLL = 0x100000001B3
_models: dict = {}


def swapped(text: str) -> str:
    if MARK in text:
        return text.translate({32: MARK, ord(MARK): " "})
    return text.replace(" ", MARK)


def swapped_back(c: int) -> str:
    return MARK if c == 32 else chr(c)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chances(keys: np.ndarray, step: int) -> np.ndarray:
    """Uniform in [0, 1) with 28 bits, for each key."""
    return (mixed(keys + np.uint64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) >> np.uint64(36)) * 2.0**-28


class Pieces:
    """A vocabulary, and the lattices of the parts seen so far."""

    def __init__(self, model: bytes, alpha: float = ALPHA):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        scores = [sp.get_score(i) for i in range(n)]
        ranked = all(s == int(s) for s in scores)
        self.byte, self.id, self.log_p, self.raw = {}, {}, {}, []
        for i in range(n):
            piece = sp.id_to_piece(i)
            special = sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
            if sp.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
                self.raw.append(bytes([int(piece[3:5], 16)]))
                continue
            self.raw.append(b"" if special else piece.replace(MARK, " ").encode())
            if special or "\n" in piece or " " in piece:
                continue
            if MARK in piece.lstrip(MARK):
                raise ValueError(f"{piece!r} has a blank inside: the parts of a text would not be independent")
            self.id[piece] = i
            self.log_p[piece] = alpha * (-math.log(2 - scores[i]) if ranked else scores[i])
        if len(self.byte) != 256:
            raise ValueError("the vocabulary has no piece for every byte")
        self.longest = max(map(len, self.log_p))
        steepest = max([-AS_BYTES, *(-w for w in self.log_p.values())]) * 1.0 - LIFT
        self.whole = int(min(WHOLE, 650 / max(steepest, 1.0), 650 / (LIFT * 1.0)))
        self.hash_prefixes()

    def hash_prefixes(self) -> None:
        """An open hash table of all beginnings of pieces: key, weight (0: not a piece), id, and whether longer ones go on."""
        known: dict[str, list] = {}
        for piece, i in self.id.items():
            for n in range(1, len(piece)):
                known.setdefault(piece[:n], [0.0, -1, False])[2] = True
            entry = known.setdefault(piece, [0.0, -1, False])
            entry[0], entry[1] = math.exp(self.log_p[piece] + LIFT * len(piece)), i
        bits = max(4, (4 * len(known)).bit_length())
        self.shift, self.slots = np.uint64(64 - bits), 1 << bits
        self.key = np.zeros(self.slots + 64, np.uint64)
        self.weight, self.piece, self.more = np.zeros(self.slots + 64), np.full(self.slots + 64, -1, np.int32), np.zeros(self.slots + 64, bool)
        for text, (w, i, more) in known.items():
            h = 0
            for c in text:
                h = (h * ROLL + ord(c) + 1) & (1 << 64) - 1
            at = int(mixed(np.array([h], np.uint64))[0] >> self.shift)
            while self.key[at]:
                at += 1
            self.key[at], self.weight[at], self.piece[at], self.more[at] = h, w, i, more

    def find(self, h: np.ndarray) -> np.ndarray:
        """Slots of the keys, -1 if there is none."""
        at = (mixed(h) >> self.shift).astype(np.int64)
        found = self.key[at]
        out = np.where(found == h, at, -1)
        todo = np.flatnonzero((found != h) & (found != 0))
        while len(todo):
            at[todo] += 1
            found = self.key[at[todo]]
            hit = found == h[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (found != 0)]
        return out

    def lattice(self, parts: list[str]):
        """parts: distinct, none over self.whole characters. For every character the chances (summed up) of the lengths of the
        piece that ends there, and the codes of those pieces; and where each part's characters begin."""
        size = np.array([len(p) for p in parts], np.int64)
        begin = np.cumsum(size) - size
        chars = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.uint64)
        n = len(chars)
        left = np.repeat(begin + size, size) - np.arange(n)  # characters of the part from here on
        edges = []  # for each length: where the pieces end, their weights and their ids
        live, h = np.arange(n), np.zeros(n, np.uint64)
        for length in range(1, self.longest + 1):
            h = h * np.uint64(ROLL) + chars[live + length - 1] + np.uint64(1)
            at = self.find(h)
            known = at >= 0
            piece = np.flatnonzero(known & (self.piece[at] >= 0))
            edges.append((live[piece] + length - 1, self.weight[at[piece]], self.piece[at[piece]]))
            on = known & self.more[at] & (left[live] > length)
            live, h = live[on], h[on]
            if not len(live):
                break
        while len(edges) > 1 and not len(edges[-1][0]):
            edges.pop()
        way, code = np.zeros((len(edges), n)), np.zeros((len(edges), n), np.int32)
        way[0], code[0] = STRAY, -1 - chars.astype(np.int32)
        for i, (end, weight, piece) in enumerate(edges):
            way[i, end], code[i, end] = weight, piece
        # forward sums, all parts at once from the longest to the shortest
        by = np.argsort(-size, kind="stable")
        start, longest = begin[by], size[by]
        forward = np.zeros(n + len(parts))  # each part has one place more than characters
        zero = begin + np.arange(len(parts))
        forward[zero] = 1.0
        zero = zero[by]
        for j in range(1, int(size.max(initial=0)) + 1):
            m = int(np.searchsorted(-longest, -j, "right"))
            char, here = start[:m] + j - 1, zero[:m] + j
            total = way[0][char] * forward[here - 1]
            for length in range(2, min(j, len(edges)) + 1):
                total += way[length - 1][char] * forward[here - length]
            forward[here] = total
        place = np.arange(n) + np.repeat(np.arange(len(parts)), size) + 1
        way[0] *= forward[place - 1] / forward[place]
        for i, (end, _, _) in enumerate(edges[1:], 1):
            to = place[end]
            way[i, end] *= forward[to - i - 1] / forward[to]
        np.cumsum(way, axis=0, out=way)
        return np.ascontiguousarray(way.T, np.float32), np.ascontiguousarray(code.T), begin, size

    def sample_one(self, part: str, key: int) -> list[int]:
        """Codes of a long part, last piece first: what lattice() and encode() do, in the same order of operations, for each
        character by itself. Only ways that exist are kept, so memory follows their number."""
        forward = [1.0]  # sums up to each of the last self.longest characters, times a power of two
        chance, code, size, begin = array("f"), array("i"), array("b"), array("q", [0])
        for j in range(1, len(part) + 1):
            ways = []
            for n in range(1, min(j, self.longest) + 1):
                w = self.log_p.get(part[j - n : j])
                if w is not None:
                    ways.append((math.exp(w + LIFT * n), n, self.id[part[j - n : j]]))
                elif n == 1:
                    ways.append((STRAY, 1, -1 - ord(part[j - 1])))
            total = 0.0
            for w, n, _ in ways:
                total += w * forward[-n]
            sofar = 0.0
            for w, n, c in ways:
                sofar += w * (forward[-n] / total)
                chance.append(sofar)
                code.append(c)
                size.append(n)
            begin.append(len(chance))
            forward.append(total)
            if len(forward) > self.longest:
                del forward[0]
            if not 2.0**-200 < total < 2.0**200:
                by = -math.frexp(total)[1]
                forward = [math.ldexp(f, by) for f in forward]
        j, step, out = len(part), 0, []
        keys = np.array([key], np.uint64)
        while j:
            u = float(chances(keys, step).astype(np.float32)[0])
            at = next((i for i in range(begin[j - 1], begin[j]) if chance[i] > u), begin[j] - 1)
            out.append(code[at])
            j, step = j - size[at], step + 1
        return out

    def codes_of(self, c: int) -> list[int]:
        """Ids for a code: itself, or the bytes of a character."""
        return [c] if c >= 0 else [self.byte[b] for b in swapped_back(-1 - c).encode()]

    def encode(self, texts: list[str], keys: list[int | None], seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in one array, and where each text's end."""
        row_keys = mixed(np.array([-1 if k is None else k for k in keys], np.int64).view(np.uint64) + mixed(np.array([seed], np.uint64)))
        parts, counts = [], []
        for text in texts:
            found = PART.findall(MARK + swapped(text)) if text else ()
            parts += found
            counts.append(len(found))
        short = [p for p in dict.fromkeys(parts) if len(p) <= self.whole]
        which = np.fromiter(map(dict(zip(short, range(len(short)))).get, parts, repeat(-1)), np.int64, len(parts))
        long_ones = [(n, parts[n]) for n in np.flatnonzero(which < 0).tolist()]
        counts = np.array(counts, np.int64)
        ends = np.cumsum(counts)
        row = np.repeat(np.arange(len(texts)), counts)
        nth = np.arange(len(which)) - (ends - counts)[row]
        part_keys = mixed(row_keys[row] ^ (nth.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
        chance, code, begin, size = self.lattice(short)
        live = np.flatnonzero(which >= 0)
        state, steps = size[which[live]], []  # characters of the part that are left
        base, left_keys = begin[which[live]], part_keys[live]
        while len(live):
            char = base + state - 1
            u = chances(left_keys, len(steps)).astype(np.float32)
            length = np.minimum((chance[char] <= u[:, None]).sum(1), np.minimum(state, code.shape[1]) - 1)
            codes = code[char, length]
            stray = np.flatnonzero(codes == 0)  # rounding led past the last piece: the longest there is
            for i in stray:
                length[i] = int(np.flatnonzero(code[char[i]])[-1])
            codes[stray] = code[char[stray], length[stray]]
            steps.append((live, codes))
            state = state - length - 1
            on = state > 0
            live, state, base, left_keys = live[on], state[on], base[on], left_keys[on]
        for n, part in long_ones:
            codes = self.sample_one(part, int(part_keys[n]))
            steps.append((np.full(len(codes), n), np.array(codes[::-1])))
        if not steps:
            return np.zeros(0, np.int32), ends * 0
        part_of, codes = (np.concatenate([s[i] for s in reversed(steps)]) for i in (0, 1))
        by = np.argsort(part_of, kind="stable")
        part_of, codes = part_of[by], codes[by]
        sizes = np.ones(len(codes), np.int64)
        spelt = {c: self.codes_of(c) for c in np.unique(codes[codes < 0]).tolist()}
        for c, ids in spelt.items():
            sizes[codes == c] = len(ids)
        at = np.cumsum(sizes) - sizes
        out = np.zeros(int(sizes.sum()), np.int32)
        out[at[codes >= 0]] = codes[codes >= 0]
        for c, ids in spelt.items():
            for i, x in enumerate(ids):
                out[at[codes == c] + i] = x
        per_part = np.bincount(part_of, sizes, len(which)).astype(np.int64)
        total = np.r_[0, np.cumsum(per_part)]
        return out, total[ends]

    def decode(self, ids) -> str:
        """The text: all pieces' bytes, without the blank that encoding puts first."""
        return b"".join([self.raw[i] for i in ids]).decode()[1:]


def loaded(model: bytes, alpha: float) -> Pieces:
    key = (hash(model), alpha)
    if key not in _models:
        _models[key] = Pieces(model, alpha)
    return _models[key]


def groups(texts: list[str]):
    """Slices of texts of about TOGETHER characters."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= TOGETHER):
            size += len(texts[j])
            j += 1
        yield slice(i, j)
        i = j


def with_pieces(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """docs with an array of sampled piece ids, which takes the place of a column of that name. model: a file on the driver, of fixed size."""
    data = Path(model).read_bytes()
    docs = docs.drop(out_col)
    of_id, of_text = docs.columns.index(id_col), docs.columns.index(text_col)
    names = docs.columns

    def run(batches):
        p = loaded(data, alpha)
        for b in batches:
            keys, texts = b.column(of_id).to_pylist(), [t or "" for t in b.column(of_text).to_pylist()]
            for s in groups(texts):
                ids, ends = p.encode(texts[s], keys[s], seed)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, ends].astype(np.int32)), pa.array(ids))
                part = b.slice(s.start, s.stop - s.start)
                yield pa.RecordBatch.from_arrays([*part.columns, lists], [*names, out_col])

    return docs.mapInArrow(run, docs.select("*", F.array().cast("array<int>").alias(out_col)).schema)


def round_trip(docs: DataFrame, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED) -> DataFrame:
    """doc_id, n_pieces, pieces_sha256 (of the ids as little-endian 32-bit integers) and lossless: decoding gives the text."""
    data = Path(model).read_bytes()
    encoded = with_pieces(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")), model, alpha, seed)

    def run(batches):
        p = loaded(data, alpha)
        for b in batches:
            out = []
            for doc_id, text, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                ids = ids.values.to_numpy()
                out.append((doc_id, len(ids), hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest(), p.decode(ids.tolist()) == (text or "")))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.bool_()))], ["doc_id", "n_pieces", "pieces_sha256", "lossless"])

    return encoded.mapInArrow(run, "doc_id long, n_pieces long, pieces_sha256 string, lossless boolean")
