"""Quality of documents: an ordinal regression on graded ratings.

Features are hashed from the text: its words and pairs of neighbouring words, in lower
case, each text's vector of them having length WORD_LENGTH, and the shapes of its tokens (AB!!
is X!, 12.5 is 9.9), repetition of a token right after itself, repeated tokens and
repeated lines, as shares of the text. So long and short texts compare. Words and pairs
share a table of 2^WORD_BITS weights, which all thresholds share in turn.
"""

from __future__ import annotations

import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorleaf.llm import ordinal
from mirrorleaf.llm.arrow import Memory, mix, words

_RUNS = ((re.compile(r"[^\W\d_]+"), lambda m: "X" if m[0].isupper() else "Xx" if m[0][0].isupper() else "x"), (re.compile(r"\d+"), lambda m: "9"))
_SAME = re.compile(r"([^\w\s])\1+")
SHAPES = 30_000  # shapes a worker remembers, of tokens of 30 letters or fewer
WORD_BITS = 18
WORD_LENGTH = 0.5  # chosen with 0.25 and 1 by cross-validation; the penalty weighs more on shorter ones
STEPS = 10  # a share is told in as many levels


class Shapes(dict):
    """Shape of a token, as a feature hash, remembered."""

    def __missing__(self, token: str) -> int:
        shape = token
        for pattern, put in _RUNS:
            shape = pattern.sub(put, shape)
        found = xxhash.xxh3_64_intdigest("shape " + _SAME.sub(r"\1+", shape))
        if len(token) <= 30:
            if len(self) >= SHAPES:
                self.clear()
            self[token] = found
        return found


class ShapeMemory(Memory):
    def __init__(self):
        super().__init__()
        self.shapes = Shapes()

    def forget(self) -> None:
        self.shapes.clear()


@lru_cache(1)
def memory() -> ShapeMemory:
    return ShapeMemory()


_LEVELS = {
    name: [xxhash.xxh3_64_intdigest(f"{name} {k}") for k in range(STEPS + 1)]
    for name in ("again", "repeated", "lines", "mean length")
}


def word_features(texts: list[str | None]) -> list[np.ndarray]:
    """The distinct places of each text's words and word pairs in the table of weights."""
    hashes, _, _, offsets = words(pa.array(texts, pa.large_string()))
    single = mix(hashes) >> np.uint64(64 - WORD_BITS)
    pairs = mix((hashes[:-1] * np.uint64(3)) ^ hashes[1:]) >> np.uint64(64 - WORD_BITS)
    return [np.unique(np.concatenate([single[a:b], pairs[a : max(a, b - 1)]])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def features(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    known = memory()
    known.touch()
    for text, places in zip(texts, word_features(texts), strict=True):
        tokens = (text or "").split()
        if not tokens:
            out.append((np.array([xxhash.xxh3_64_intdigest("empty")], np.uint64), np.ones(1)))
            continue
        n = len(tokens)
        shapes: Counter = Counter()
        counts = Counter(tokens)
        for token, often in counts.items():
            shapes[known.shapes[token]] += often
        again = sum(map(str.__eq__, tokens, tokens[1:])) / n
        lines = [x for x in text.split("\n") if x]
        shares = {
            "again": again,
            "repeated": 1 - len(counts) / n if n >= 20 else 0.0,
            "lines": 1 - len(set(lines)) / len(lines),
            "mean length": min(1.0, sum(map(len, tokens)) / n / 20),
        }
        hashes, values = list(shapes), [2.0 * c / n for c in shapes.values()]
        for name, share in shares.items():
            hashes.append(_LEVELS[name][int(share * STEPS)])
            values.append(1.0)
        # the rest are 64-bit hashes, far above the places of words
        length = np.full(len(places), WORD_LENGTH / max(1.0, len(places)) ** 0.5)
        out.append((np.concatenate([np.array(hashes, np.uint64), places]), np.concatenate([values, length])))
    return out


def quality_model(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  label_id_col: str = "doc_id", grade_col: str = "quality", **options) -> ordinal.Ordinal:
    """Fit the ratings of ``labels`` on the texts of ``docs``; see ordinal.train."""
    return ordinal.train(docs, labels, features, id_col, text_col, label_id_col, grade_col, **options)


def grade_quality(docs: DataFrame, model: ordinal.Ordinal, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """(id, expected_grade, p_good, selected) for each row of ``docs``.

    p_good is the probability of more than the lowest grade, ``least`` of which selects
    a row. Null and empty texts are graded by a feature of their own. If the labels have
    fewer than two grades, p_good is null and every row is selected. Repeated rows get a
    row each; an empty table gives none.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = ordinal.graded(rows, model, features)
    p = F.try_element_at("tail", F.lit(1))
    return out.select("id", "expected_grade", p.alias("p_good"), F.coalesce(p >= least, F.lit(True)).alias("selected"))


def drop_low_quality(docs: DataFrame, model: ordinal.Ordinal, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, with all columns, that grade_quality selects."""
    test = lambda tails: tails[:, 0] >= least if tails.shape[1] else np.ones(len(tails), bool)
    return ordinal.rows_where(docs, model, features, text_col, test)
