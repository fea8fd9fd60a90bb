"""Token counts by section: a document is encoded once, and its tokens' spans are joined to the spans of its sections.

The vocabulary is byte-level, so the tokens' lengths in bytes give their offsets and code points follow from the bytes.
Spans of sections ascend and do not overlap; a binary search over their ends is the interval join. A token that lies in
several sections, or partly in none, is allocated by `rule`: "first" gives it to the section of its first byte, "most" to
the section with most of its bytes (the earlier of equals), "share" a fraction to each in proportion to its bytes.

Sections are by default the lines of the text, each with its line end; others come as an array column of (start, end) in
code points. A run of white space over LONG characters is cut out before the pattern sees it: all of the run but its last
character is one pre-token of the pattern whatever stands around it, so the tokens are the same and the matcher, which steps
back through such runs, never meets a long one. Defined cases: null text is empty and has no tokens and one empty section; a token outside every section
counts for the document only; doc_id may be null or repeated; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how texts are cut before merging, as this vocabulary was made.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the encoder's pattern has it, in runs that the pattern does not get to see.
LONG = 10_000
RUN = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{%d,}" % LONG)
RULES = ("first", "most", "share")
_built: dict = {}


def encoding(data: bytes) -> tuple[tiktoken.Encoding, np.ndarray]:
    key = hash(data)
    if key not in _built:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            sizes[i] = len(token)
        _built[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return _built[key]


def encoded(enc: tiktoken.Encoding, text: str) -> np.ndarray:
    """The tokens of a whole text. Before a long run of white space and before its last character the pattern always cuts."""
    parts, at = [], 0
    for run in RUN.finditer(text):
        last = run.end() if run.end() == len(text) else run.end() - 1
        parts += [enc.encode_to_numpy(text[at : run.start()], disallowed_special=()), np.asarray(enc._encode_single_piece(text[run.start() : last]))]
        at = last
    parts.append(enc.encode_to_numpy(text[at:], disallowed_special=()))
    return np.concatenate([np.asarray(p, np.int64) for p in parts])


def line_ends(data: np.ndarray) -> np.ndarray:
    """Where each line's bytes end; a line end belongs to its line, and what follows the last one is a line too."""
    return np.r_[np.flatnonzero(data == 10) + 1, len(data)]


def allocate(ends: np.ndarray, starts_at: np.ndarray, ends_at: np.ndarray, rule: str) -> tuple[np.ndarray, int]:
    """Tokens for each section, and how many lie in more than one or not wholly in one. ends: of tokens; starts_at, ends_at: of sections."""
    begins = np.r_[0, ends[:-1]]
    n = len(ends_at)
    if not n or not len(ends):
        return np.zeros(n), 0
    a = np.searchsorted(ends_at, begins, "right")  # the first section that ends after the token begins
    inside = (a < n) & (starts_at[np.minimum(a, n - 1)] <= begins)
    whole = inside & (ends_at[np.minimum(a, n - 1)] >= ends)
    out = np.bincount(a[whole], minlength=n).astype(float)
    for i in np.flatnonzero(~whole):
        parts = {}
        s = int(a[i])
        while s < n and starts_at[s] < ends[i]:
            if (size := min(ends_at[s], ends[i]) - max(starts_at[s], begins[i])) > 0:
                parts[s] = size
            s += 1
        if rule == "share":
            for s, size in parts.items():
                out[s] += size / (ends[i] - begins[i])
        elif rule == "most" and parts:
            out[max(parts, key=lambda s: (parts[s], -s))] += 1
        elif rule == "first" and inside[i]:
            out[a[i]] += 1
    return out, int((~whole).sum())


def section_tokens(docs: DataFrame, rule: str = "first", sections_col: str | None = None, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_sections, n_crossing, section_tokens (array of double) and tokens_sha256 (of the ids as
    little-endian 32-bit integers). vocabulary: a file on the driver, of fixed size."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    data = Path(vocabulary).read_bytes()
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), *([docs[sections_col].alias("sections")] if sections_col else []))

    def run(batches):
        enc, sizes = encoding(data)
        for b in batches:
            out = [[] for _ in range(6)]
            sections = b.column(2).to_pylist() if sections_col else None
            for row, (doc_id, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
                text = text or ""
                ids = encoded(enc, text)
                raw = np.frombuffer(text.encode(), np.uint8)
                ends = np.cumsum(sizes[ids])
                if sections is None:
                    ends_at = line_ends(raw)
                    starts_at = np.r_[0, ends_at[:-1]]
                else:
                    at = np.r_[np.flatnonzero((raw & 0xC0) != 0x80), len(raw)]  # the byte at which each code point begins
                    starts_at, ends_at = (at[np.clip(np.array([s[i] for s in sections[row] or []], np.int64), 0, len(at) - 1)] for i in ("start", "end"))
                per, crossing = allocate(ends, starts_at, ends_at, rule)
                for column, x in zip(out, (doc_id, len(ids), len(ends_at), crossing, per, hashlib.sha256(ids.astype("<i4").tobytes()).hexdigest())):
                    column.append(x)
            flat = pa.array(np.concatenate(out[4]) if out[4] else np.zeros(0))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(x) for x in out[4]])].astype(np.int32)), flat)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(x, pa.int64()) for x in out[:4]), lists, pa.array(out[5], pa.string())], ["doc_id", "n_tokens", "n_sections", "n_crossing", "section_tokens", "tokens_sha256"]
            )

    return d.mapInArrow(run, "doc_id long, n_tokens long, n_sections long, n_crossing long, section_tokens array<double>, tokens_sha256 string")
