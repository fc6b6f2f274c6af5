"""Texts turned into fill-in-the-middle form, cut at tokens found by word-wide arithmetic.

The UTF-8 bytes of many texts are viewed as 64-bit words. In each word, additions that
never carry from byte to byte mark the bytes at which a unit ends; bit counts and their
running sums number the units. The k-th unit of a text is found by a search in the
running sums, which names the word, and a select among the marks of that word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorleaf.llm.arrow import slices, small_batches, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
_ONES = np.uint64(0x0101010101010101)
_HIGH = np.uint64(0x8080808080808080)
_LOW = ~_HIGH


def _at_least(low: np.ndarray, least: int) -> np.ndarray:
    """High bit of each byte, below 0x80 in ``low``, that is ``least`` or more."""
    return low + _ONES * np.uint64(0x80 - least)


def space_marks(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that is a space or one of the bytes 9 to 13."""
    low = words & _LOW
    blank = _at_least(low, 0x09) & ~_at_least(low, 0x0E) | _at_least(low, 0x20) & ~_at_least(low, 0x21)
    return blank & ~words & _HIGH


def char_marks(words: np.ndarray) -> np.ndarray:
    """High bit of each byte that begins a character, that is of all but 0x80 to 0xBF."""
    return ~(words & ~(words << np.uint64(1))) & _HIGH


class Marks:
    """Marked bytes, numbered by running sums over 64-bit words."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marks stand in front of each byte."""
        word = at >> 3
        low = (np.uint64(1) << (np.uint64(8) * (at & 7).astype(np.uint64))) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The byte of each k-th mark, from 1."""
        word = np.searchsorted(self.before, k, "left") - 1
        left, rest = self.words[word], k - self.before[word] - 1
        for step in range(7):
            left = np.where(rest > step, left & (left - np.uint64(1)), left)
        return 8 * word + (np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1)) >> 3)


def unit_marks(data: np.ndarray, offsets: np.ndarray) -> tuple[Marks, Marks]:
    """(ends of units, beginnings of characters) of texts that stand one after the other.

    A unit is a run of other bytes with the white space before it, or the white space
    at the end of a text.
    """
    padded = np.zeros(len(data) // 8 * 8 + 16, np.uint8)
    padded[: len(data)] = data
    words = padded.view("<u8").astype(np.uint64, copy=False)
    space = space_marks(words)
    follows = space >> np.uint64(8)
    follows[:-1] |= space[1:] << np.uint64(56)
    ends = ~space & follows & _HIGH
    last = offsets[1:][offsets[1:] > offsets[:-1]] - 1
    np.bitwise_or.at(ends, last >> 3, np.uint64(0x80) << (np.uint64(8) * (last & 7).astype(np.uint64)))
    chars = char_marks(words)
    for marks in (ends, chars):  # the padding has none
        marks[len(data) >> 3] &= (np.uint64(1) << np.uint64(8 * (len(data) & 7))) - np.uint64(1)
        marks[(len(data) >> 3) + 1 :] = 0
    return Marks(ends), Marks(chars)


def _cut_points(marks: Marks, first: np.ndarray, begin: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The byte after unit k of each text, or its first byte where k is 0."""
    out = begin.copy()
    some = np.flatnonzero(k)
    out[some] = marks.select(first[some] + k[some]) + 1
    return out


FIELDS = "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"


def _transformed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = {PSM: (PREFIX, 0, SUFFIX, 2, MIDDLE, 1), SPM: (SUFFIX, 2, PREFIX, 0, MIDDLE, 1)}
    for whole in batches:
        for batch in slices(whole, "text"):
            data, offsets = text_bytes(batch.column("text"))
            ends, chars = unit_marks(data, offsets)
            ranks = ends.rank(offsets)
            n = np.diff(ranks)
            draws = np.stack([batch.column(c).to_numpy() % (n + 1) for c in ("h1", "h2")])
            begin = offsets[:-1]
            a, b = (_cut_points(ends, ranks[:-1], begin, f(draws)) for f in (lambda x: x.min(axis=0), lambda x: x.max(axis=0)))
            prefix, middle = chars.rank(a) - chars.rank(begin), chars.rank(b) - chars.rank(a)
            forms = batch.column("form").to_pylist()
            plain = np.array([f == PLAIN for f in forms], bool)
            raw = data.tobytes()
            output = []
            for form, s, x, y, e in zip(forms, begin.tolist(), a.tolist(), b.tolist(), offsets[1:].tolist(), strict=True):
                if form == PLAIN:
                    output.append(raw[s:e])
                    continue
                parts = (raw[s:x], raw[x:y], raw[y:e])
                output.append(b"".join(p.encode() if isinstance(p, str) else parts[p] for p in order[form]))
            columns = {
                "doc_id": batch.column("doc_id"),
                "n": pa.array(n, pa.int64()),
                "form": batch.column("form").cast(pa.string()),
                "prefix_chars": pa.array(prefix, pa.int64(), mask=plain),
                "middle_chars": pa.array(middle, pa.int64(), mask=plain),
                "output": pa.array(output, pa.string()),
            }
            yield pa.record_batch(list(columns.values()), list(columns))


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, fim_percent: int = 50, spm_percent: int = 80
) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``docs``.

    A text of n units is cut after two of 0 to n units, drawn from the SHA-256 of
    ``seed``, a colon and the id (of a null id: nothing). ``fim_percent`` of the texts
    are changed: to psm, which is <P>prefix<S>suffix<M>middle, or, for ``spm_percent`` of
    them, to spm, which is <S>suffix<P>prefix<M>middle. Others stay plain, and so do null
    and empty texts (n is 0) and those that hold one of the three marks; their two
    lengths are null. Lengths are code points. Repeated rows get equal rows each; an
    empty table gives none; ids are integers, other columns are not read.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    id_ = F.col(id_col).cast("bigint")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    draw = lambda k: F.conv(F.substring(digest, 8 * k - 7, 8), 16, 10).cast("bigint")
    marked = (text == "") | F.contains(text, F.lit(PREFIX)) | F.contains(text, F.lit(SUFFIX)) | F.contains(text, F.lit(MIDDLE))
    form = F.when(marked | (draw(3) % 100 >= fim_percent), PLAIN).when(draw(4) % 100 < spm_percent, SPM).otherwise(PSM)
    rows = docs.select(id_.alias("doc_id"), text.alias("text"), draw(1).alias("h1"), draw(2).alias("h2"), form.alias("form"))
    return rows.mapInArrow(_transformed, FIELDS)


def restored(output: str = "output", form: str = "form") -> Column:
    """The text that ``fill_in_middle`` made an output from. No part of a changed text holds a mark."""
    parts = F.split(F.col(output), f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    part = lambda k: F.element_at(parts, k)
    return (
        F.when(F.col(form) == PSM, F.concat(part(2), part(4), part(3)))
        .when(F.col(form) == SPM, F.concat(part(3), part(4), part(2)))
        .otherwise(F.col(output))
    )
