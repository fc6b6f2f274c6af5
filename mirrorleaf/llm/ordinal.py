"""Cumulative-link ordinal regression on hashed text features.

Grades are ordered. One weight vector w is shared by all thresholds t1 < t2 < ...:
P(grade <= k) = sigmoid(t_k - w x). From it follow the expected grade and the tail
probabilities P(grade >= k). The model is fitted on a bounded sample of labelled rows;
features that few of these rows have are left out, so its size is bounded too.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorleaf.llm.arrow import slices, small_batches

SAMPLE_ROWS = 12_000  # labelled rows that a model is fitted on, at most
PART = 1 << 19
MIN_ROWS = 4  # rows of the sample that must have a feature
# For each text: (hashes of its features, values). A feature occurs once in a text.
Features = Callable[[list[str | None]], list[tuple[np.ndarray, np.ndarray]]]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Ordinal:
    grades: list[float]
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def scores(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        out = np.zeros(len(rows))
        counts = [len(h) for h, _ in rows]
        if not len(self.hashes) or not sum(counts):
            return out
        hashes = np.concatenate([h for h, _ in rows])
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        part = np.where(self.hashes[at] == hashes, self.weights[at], 0) * np.concatenate([v for _, v in rows])
        return np.bincount(np.repeat(np.arange(len(rows)), counts), part, len(rows))

    def tails(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= k) of each row, for every grade but the least."""
        return _sigmoid(scores[:, None] - self.thresholds[None, :])

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades) if self.grades else np.full(len(tails), np.nan)


def _parts(n: int) -> list[slice]:
    """Sums go over so many values at a time, as their 64-bit copies are what memory goes to."""
    return [slice(k, min(k + PART, n)) for k in range(0, n, PART)]


def _screened(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, min_rows: int, screen: float) -> tuple[np.ndarray, ...]:
    """(row, column, value) of each feature that counts, and the hashes that the columns stand for."""
    counts = np.array([len(h) for h, _ in rows])
    hashes = np.concatenate([h for h, _ in rows])
    ordered = np.sort(hashes)
    first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
    names, often = ordered[first], np.diff(first, append=len(ordered))
    del ordered, first
    kept = often >= min_rows
    names, often = names[kept], often[kept]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), counts)
    column = np.full(len(hashes), -1, np.int32)
    for part in _parts(len(hashes) if len(names) else 0):
        at = np.minimum(np.searchsorted(names, hashes[part]), len(names) - 1)
        column[part] = np.where(names[at] == hashes[part], at, -1)
    del hashes
    values = np.concatenate([v for _, v in rows])
    keep = column >= 0
    row, column, values = row[keep], column[keep], values[keep]
    if screen > 0:
        mean, spread = y.mean(), max(y.std(), 1e-9)
        total = np.zeros(len(names))
        for part in _parts(len(row)):
            total += np.bincount(column[part], y[row[part]], len(names))
        clear = np.abs(total / often - mean) * np.sqrt(often) / spread >= screen
        keep = clear[column]
        row, column, values = row[keep], (np.cumsum(clear) - 1)[column[keep]].astype(np.int32), values[keep]
        names = names[clear]
    return row, column, values, names


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[float], steps: int = 200, penalty: float = 1e-4, min_rows: int = MIN_ROWS, screen: float = 0.0) -> Ordinal:
    """Maximum likelihood with an L2 penalty, by Adam on all rows; equal input gives an equal model.

    A feature counts if ``min_rows`` rows have it, and if the mean grade of these rows is
    at least ``screen`` standard errors away from the mean grade of all.
    """
    kinds = sorted(set(grades))
    empty = np.zeros(0)
    if len(kinds) < 2:
        return Ordinal(kinds, np.zeros(0, np.uint64), empty, empty)
    y = np.searchsorted(kinds, grades)
    row, column, values, names = _screened(rows, y, min_rows, screen)
    n_rows = len(rows)
    del rows  # the sample, if the caller doesn't hold it
    # thresholds start at the shares of the grades; gaps are kept as logarithms
    share = np.clip([(y <= k).mean() for k in range(len(kinds) - 1)], 1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    state = np.concatenate([np.zeros(len(names)), start[:1], gaps])
    m, v = np.zeros_like(state), np.zeros_like(state)
    n = len(names)

    def thresholds(s):
        return s[n] + np.append(0, np.cumsum(np.exp(s[n + 1 :])))

    parts = _parts(len(row))
    for step in range(1, steps + 1):
        t = thresholds(state)
        score = np.zeros(n_rows)
        for part in parts:
            score += np.bincount(row[part], state[column[part]] * values[part], n_rows)
        upper = np.where(y < len(t), _sigmoid(t[np.minimum(y, len(t) - 1)] - score), 1.0)
        lower = np.where(y > 0, _sigmoid(t[np.maximum(y - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        by_score = -(upper + lower - 1)  # of the loss
        by_upper, by_lower = -upper * (1 - upper) / p, lower * (1 - lower) / p
        by_t = np.bincount(np.minimum(y, len(t) - 1), np.where(y < len(t), by_upper, 0), len(t))
        by_t += np.bincount(np.maximum(y - 1, 0), np.where(y > 0, by_lower, 0), len(t))
        after = np.cumsum(by_t[::-1])[::-1]
        by_weight = np.zeros(n)
        for part in parts:
            by_weight += np.bincount(column[part], values[part] * by_score[row[part]], n)
        gradient = np.concatenate(
            [by_weight / n_rows + penalty * state[:n], after[:1] / n_rows, after[1:] * np.exp(state[n + 1 :]) / n_rows]
        )
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient * gradient
        state = state - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    weights = state[:n]
    used = np.abs(weights) > 1e-6
    return Ordinal(kinds, names[used], weights[used], thresholds(state))


def _featured(features: Features):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                rows = features(batch.column("text").to_pylist())
                yield pa.record_batch(
                    [
                        batch.column("id"),
                        batch.column("grade"),
                        # equal values and hashes of few bits take little room
                        pa.array([zlib.compress(h.astype("<u8").tobytes(), 1) for h, _ in rows], pa.binary()),
                        pa.array([zlib.compress(v.astype("<f4").tobytes(), 1) for _, v in rows], pa.binary()),
                    ],
                    ["id", "grade", "hashes", "values"],
                )

    return run


def labelled(rows: DataFrame, grades: DataFrame, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, text, grade): ``rows`` (id, text) of the ``sample_rows`` graded ids that come first by hash.

    Of several grades or texts of an id, the least counts; null ids and grades don't.
    """
    grades = grades.where("id IS NOT NULL AND grade IS NOT NULL").groupBy("id").agg(F.min("grade").alias("grade"))
    some = grades.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    return rows.join(F.broadcast(some), "id").groupBy("id").agg(
        F.min("grade").cast("double").alias("grade"), F.min("text").alias("text")
    )


def train(docs: DataFrame, labels: DataFrame, features: Features, id_col: str, text_col: str, label_id_col: str,
          grade_col: str, sample_rows: int = SAMPLE_ROWS, **options) -> Ordinal:
    """Fit the grades of ``labels`` on the texts of ``docs`` with the same id; see labelled for the sample."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    grades = labels.select(F.col(label_id_col).cast("bigint").alias("id"), F.col(grade_col).alias("grade"))
    sample = labelled(rows, grades, sample_rows)
    parts = sample.mapInArrow(_featured(features), "id bigint, grade double, hashes binary, values binary").collect()
    parts.sort(key=lambda r: r["id"])
    grades = [r.grade for r in parts]
    unpacked = lambda r: (np.frombuffer(zlib.decompress(r["hashes"]), "<u8"), np.frombuffer(zlib.decompress(r["values"]), "<f4"))
    parts[:] = map(unpacked, parts)
    return fit([parts.pop() for _ in grades][::-1], grades, **options)


def _applied(shared, features: Features, names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, text_col):
                tails = model.tails(model.scores(features(batch.column(text_col).to_pylist())))
                known = len(model.grades) > 0
                columns = {c: batch.column(c) for c in names if c in batch.schema.names}
                columns["expected_grade"] = pa.array(model.expected(tails) if known else [None] * batch.num_rows, pa.float64())
                columns["tail"] = pa.array(list(tails), pa.list_(pa.float64()))
                yield pa.record_batch(list(columns.values()), list(columns))

    return run


def graded(docs: DataFrame, model: Ordinal, features: Features) -> DataFrame:
    """(id, expected_grade, tail) for each row of ``docs`` (id, text); tail lists P(grade >= k).

    Without a labelled row expected_grade is null, with one grade it is that grade;
    tail is empty then.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"id {dict(docs.dtypes)['id']}, expected_grade double, tail array<double>"
    return docs.mapInArrow(_applied(shared, features, ["id"], "text"), schema)


def rows_where(docs: DataFrame, model: Ordinal, features: Features, text_col: str, test: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The rows of ``docs``, with all columns, whose tail probabilities pass ``test``."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for batch in slices(whole, text_col):
                tails = model.tails(model.scores(features(batch.column(text_col).to_pylist())))
                yield batch.select(names).filter(pa.array(test(tails)))

    return docs.mapInArrow(run, docs.schema)
