"""Secrets in texts: a keyword automaton, anchored patterns at its hits, embedded checksums.

One automaton runs over the lower-case bytes of many texts at once. Only where it finds
a keyword does the pattern of that keyword's kind run, anchored at the hit. Runs of hex
digits have no keyword: eight bytes are looked at as one word, as a long run fills two
neighbouring words, and the pattern runs at such words only. Tokens that carry a
checksum of themselves count only if it is right.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorleaf.llm.arrow import FOLD, slices, small_batches, text_bytes

KINDS = ("assign", "access", "hex", "github", "npm")
BASE = 3  # the first kinds have no checksum
HEX = re.compile(rb"[0-9a-f]+")
HEX_CHARS = 24
# Keywords in lower case, and the pattern that is tried where one of them begins.
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "github": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "npm": ("npm_",),
}
PATTERNS = {
    "assign": re.compile(rb"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(rb"AKIA[A-Z0-9]+"),
    "github": re.compile(rb"gh[pousr]_([A-Za-z0-9]+)"),
    "npm": re.compile(rb"npm_([A-Za-z0-9]+)"),
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
CHECKED, CHECKSUM = 36, 6  # characters after the prefix, the last of which are the checksum

_IS_HEX = np.zeros(256, bool)
_IS_HEX[list(b"0123456789abcdef")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] = FOLD[65:91]


def checksum(body: bytes) -> bytes:
    """CRC-32 of ``body`` in six digits of base 62."""
    value, out = zlib.crc32(body), ""
    for _ in range(CHECKSUM):
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out.encode()


def _checked(match: re.Match) -> bool:
    token = match[1]
    return len(token) == CHECKED and checksum(token[:-CHECKSUM]) == token[-CHECKSUM:]


# Whether a match of a kind counts; one that doesn't still takes up its place.
ACCEPTS = {
    "assign": lambda m: len(m[1]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "github": _checked,
    "npm": _checked,
}


@lru_cache(1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for kind, keywords in KEYWORDS.items():
        for word in keywords:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def _hex_spans(data: np.ndarray, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int, int]]:
    """(text, start, end) of the longest runs of hex digits, of HEX_CHARS bytes or more."""
    whole = len(data) // 8 * 8
    full = _IS_HEX[data[:whole].reshape(-1, 8)].all(axis=1)
    if not full.any():
        return []
    pairs = np.flatnonzero(full[1:] & full[:-1]) * 8  # a run of 23 bytes or more fills two words
    text = np.searchsorted(ends, pairs, "right")
    spans, done = [], -1
    for at, t in zip(pairs.tolist(), text.tolist(), strict=True):
        # a pair that reaches over the end of a text may belong to runs of both
        while t < len(starts) and starts[t] < at + 16:
            begin = max(at, int(starts[t]), done)
            while begin > starts[t] and begin > done and _IS_HEX[raw[begin - 1]]:
                begin -= 1
            found = HEX.match(raw, begin, int(ends[t])) if begin < ends[t] else None
            if found:
                done = max(done, found.end())
                if found.end() - found.start() >= HEX_CHARS:
                    spans.append((t, found.start(), found.end()))
            t += 1
    return spans


def find_spans(texts: pa.Array) -> list[np.ndarray]:
    """[text, kind, start, end] of the secrets in all texts, in order of text, start and kind; in code points."""
    data, offsets = text_bytes(texts)
    raw = data.tobytes()
    starts, ends = offsets[:-1], offsets[1:]
    found: list[tuple[int, int, int, int]] = []
    hits: dict[str, list[int]] = {kind: [] for kind in KEYWORDS}
    for last, (kind, size) in automaton().iter(_LOWER[data].tobytes().decode("latin-1")):
        hits[kind].append(last - size + 1)
    for kind, places in hits.items():
        number, done = KINDS.index(kind), -1
        places = np.sort(np.array(places, np.int64))
        for at, t in zip(places.tolist(), np.searchsorted(ends, places, "right").tolist(), strict=True):
            if at < done:
                continue
            match = PATTERNS[kind].match(raw, at, int(ends[t]))
            if match:
                done = match.end()
                if ACCEPTS[kind](match):
                    found.append((t, number, match.start(), match.end()))
    found += [(t, KINDS.index("hex"), a, b) for t, a, b in _hex_spans(data, raw, starts, ends)]
    if not found:
        return [np.zeros(0, np.int64)] * 4
    text, kind, start, end = np.array(found, np.int64).T
    chars = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=chars[1:])
    first = chars[starts[text]]
    start, end = chars[start] - first, chars[end] - first
    order = np.lexsort((kind, start, text))
    return [x[order] for x in (text, kind, start, end)]


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
SCHEMA = "doc_id bigint, secrets array<struct<kind:string,start:bigint,end:bigint>>"


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            text, kind, start, end = find_spans(batch.column("text"))
            names = pa.array(KINDS).take(pa.array(kind))
            values = pa.StructArray.from_arrays([names, pa.array(start), pa.array(end)], fields=list(SPAN))
            borders = np.searchsorted(text, np.arange(batch.num_rows + 1))
            spans = pa.ListArray.from_arrays(pa.array(borders, pa.int32()), values)
            yield pa.record_batch([batch.column("doc_id"), spans], ["doc_id", "secrets"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, secrets) for each row of ``docs``: the spans (kind, start, end) of its secrets.

    Of each kind, matches are leftmost and don't overlap; spans are code points, the end
    exclusive, in order of start, then of KINDS. Assignments of a password, secret, token
    or key have six characters or more, access keys 20, runs of hex digits 24; tokens of
    the last two kinds have a right checksum. Null and empty texts have no spans. Repeated
    rows get equal rows each; an empty table gives none; ids are integers, other columns
    are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(_scanned, SCHEMA)
