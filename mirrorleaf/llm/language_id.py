"""Languages by rank-order profiles of character n-grams.

The most frequent n-grams of a language, in order, are its profile. A document's own
most frequent n-grams are compared to each profile by how far each is out of place.
N-grams have 1 to 3 letters and stay within words; a mark stands before and after each
word. They are counted by array operations over whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mirrorleaf.llm.arrow import slices

TOP = 300
UNKNOWN = "und"
NGRAM = 3
POINT_BITS = 21  # of a code point


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> code point in lower case, or 0 if it is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def _symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text number, symbol) of the letters of all texts, in lower case, with a mark (0) around each word."""
    joined = "\n".join(t or "" for t in texts)
    points = _letters()[np.frombuffer(joined.encode("utf-32-le"), np.uint32)]
    inside = points != 0
    # a run of other characters becomes one mark
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    doc = np.repeat(np.arange(len(texts)), [len(t or "") + 1 for t in texts])[:-1][keep]
    symbols = points[keep]
    # a mark in front of the first word of each text, and behind the last word of all
    first = np.flatnonzero(np.diff(doc, prepend=-1))
    symbols, doc = np.insert(symbols, first, 0), np.insert(doc, first, doc[first])
    if len(symbols) and symbols[-1]:
        symbols, doc = np.append(symbols, np.uint32(0)), np.append(doc, doc[-1])
    return doc, symbols


def _counts(texts: list[str | None], groups: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram, count), by group and then n-gram; each text is a group if none are given.

    An n-gram holds a code point in each 21 bits, 1 is the mark. Inside, letters are
    numbered, so that group and n-gram are one small number, which is sorted.
    """
    doc, symbols = _symbols(texts) if texts else (np.zeros(0, np.int64), np.zeros(0, np.uint32))
    if not len(doc):
        return doc, symbols.astype(np.uint64), doc
    letters = np.flatnonzero(np.bincount(symbols))
    base = len(letters) + 1
    size = base + base**2 + base**3
    if size * len(texts) >= 1 << 63:  # very many letters: in two parts
        half = len(texts) // 2
        parts = [_counts(t, np.arange(len(t)) + k if groups is None else groups[k : k + len(t)]) for k, t in ((0, texts[:half]), (half, texts[half:]))]
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    if letters[0] != 0:
        letters = np.append(0, letters)
    group = doc if groups is None else groups[doc]
    kind = np.uint32 if size * (int(group.max()) + 1) < 1 << 32 else np.uint64
    number = np.zeros(int(letters[-1]) + 1, kind)
    number[letters] = np.arange(len(letters))
    own = number[symbols]
    start = group.astype(kind) * kind(size)
    letter = own != 0
    keys = [(start + own)[letter]]
    gram, low = own, 0
    for n in range(2, NGRAM + 1):
        gram = gram[:-1] * kind(base) + own[n - 1 :]
        low += base ** (n - 1)
        ok = doc[: len(gram)] == doc[n - 1 :]
        if n > 2:  # no mark inside
            ok &= letter[1 : len(gram) + 1]
        keys.append((start[: len(gram)] + gram + kind(low))[ok])
    key = np.concatenate(keys)
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(new, len(key)))
    group, gram = np.divmod(key[new].astype(np.uint64), np.uint64(size))
    # back to code points; n-grams of each length have numbers of their own
    names = np.maximum(letters, 1).astype(np.uint64)
    code = np.zeros(len(gram), np.uint64)
    low = 0
    for n in range(1, NGRAM + 1):
        high = low + base**n
        at = np.flatnonzero((gram >= low) & (gram < high))
        rest = gram[at] - np.uint64(low)
        for k in range(n):
            rest, symbol = np.divmod(rest, np.uint64(base))
            code[at] |= names[symbol] << np.uint64(k * POINT_BITS)
        low = high
    return group.astype(np.int64), code, count


def _language_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in slices(whole, "text"):
            langs = batch.column("lang").to_pylist()
            names = sorted(set(langs))
            of = np.array([names.index(x) for x in langs], np.int64)
            lang, gram, count = _counts(batch.column("text").to_pylist(), of)
            yield pa.record_batch(
                [pa.array([names[k] for k in lang.tolist()], pa.string()), pa.array(gram.astype(np.int64)), pa.array(count, pa.int64())],
                ["lang", "gram", "n"],
            )


def profiles(labelled: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, gram, rank): the ``top`` most frequent n-grams of each language of ``labelled`` (text, lang)."""
    parts = labelled.where("lang IS NOT NULL AND text IS NOT NULL").select("text", "lang")
    counts = parts.mapInArrow(_language_counts, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    # a limit on the number itself is applied before the shuffle too
    first = counts.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return first.withColumn("rank", F.col("rank") - 1).drop("n")


class Ranks:
    """Profiles as one sorted table of n-grams with a column of ranks for each language."""

    def __init__(self, rows: list, top: int):
        self.top = top
        self.names = sorted({r.lang for r in rows})
        self.grams = np.array(sorted({r.gram for r in rows}), np.uint64)
        # a rank of -1 says that the profile does not have the n-gram
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), -1, np.int64)
        for r in rows:
            self.ranks[np.searchsorted(self.grams, np.uint64(r.gram)), self.names.index(r.lang)] = r.rank

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        doc, gram, count = _counts(texts)
        names, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
        if not len(doc) or not self.names:
            return names, score
        # n-grams of a text are in order: of equal counts the first comes first
        order = np.argsort((doc << 32) - count, kind="stable")
        doc, gram = doc[order], gram[order]
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        rank = np.arange(len(doc)) - np.repeat(starts, np.diff(np.append(starts, len(doc))))
        own = rank < self.top
        doc, gram, rank = doc[own], gram[own], rank[own]
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        theirs = self.ranks[at]
        distance = np.where(theirs < 0, self.top, np.abs(theirs - rank[:, None]))
        starts = np.flatnonzero(np.diff(doc, prepend=-1))
        total = np.add.reduceat(distance, starts, axis=0)
        most = np.diff(np.append(starts, len(doc))) * self.top
        best = total.argmin(axis=1)
        for d, k in zip(doc[starts].tolist(), best.tolist(), strict=True):
            names[d] = self.names[k]
        score[doc[starts]] = 1 - total[np.arange(len(best)), best] / most
        return names, score


def _predict(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                names, score = shared.value.predict(batch.column("text").to_pylist())
                rest = [c for c in batch.schema.names if c != "text"]
                yield pa.record_batch(
                    [*(batch.column(c) for c in rest), pa.array(names, pa.string()), pa.array(score)], [*rest, "lang_pred", "score"]
                )

    return run


def predict_languages(
    docs: DataFrame, labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    labelled_text_col: str = "text", lang_col: str = "lang", top: int = TOP,
) -> DataFrame:
    """(id, lang_pred, score) for each row of ``docs``, from the profiles of ``labelled``.

    score is 1 less the distance to the nearest profile, as a share of the greatest
    possible distance. Null texts and texts without a letter give "und" and 0, and so
    does every text if nothing is labelled; rows of ``labelled`` without a text or a
    language teach nothing. Equal distances go to the first language by name. Repeated
    rows get a row each; an empty table gives none. The driver holds ``top`` n-grams
    for each language.
    """
    taught = labelled.select(F.col(labelled_text_col).alias("text"), F.col(lang_col).alias("lang"))
    ranks = Ranks(list(profiles(taught, top).toLocalIterator()), top)
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_predict(shared), f"id {dict(rows.dtypes)['id']}, lang_pred string, score double")
