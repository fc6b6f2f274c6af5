"""Hard negatives of anchors, with score bounds from angles to reference directions.

1. A bounded sample gives reference directions. Every row stores its angle to each of
   them, and rows are dealt and sorted by the nearest direction and the angle to it, so
   that a window of neighbouring rows has narrow ranges of angles.
2. By the triangle inequality of angles, the ranges of a window and the angles of an
   anchor bound the cosine between them; the norms turn it into bounds of the score,
   widened by more than rounding can do. Only windows whose bounds overlap the scores
   that an anchor still looks for are scored, by exact integer products.
3. The first pass finds the positives of each anchor, the second the rows below them.
   A task keeps a few rows for each anchor; ranks over anchors merge the tasks.

Anchors are taken in blocks of bounded size, each is broadcast and meets all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorleaf.session import persist_table, work_folder

REFERENCES = 16
SAMPLE = 2_048  # rows that the directions, and the first bounds of positives, come from
ANCHORS = 8_192  # in one broadcast, if they have no more than ...
ANCHOR_BYTES = 32 << 20
WINDOW_ROWS = 256
TILE = 1_024  # anchors scored at once
MARGIN = 1e-6  # of an angle, far above the error of an arc cosine
NULL_ID = -(1 << 63)
LEAST = -(1 << 63)
NORM = float(1 << 31)  # below it, scores fit 62 bits


def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of numbers; shorter rows end in zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(size) and (size == size[0]).all():
        return values.reshape(len(size), size[0])
    out = np.zeros((len(size), int(size.max(initial=0))))
    out[np.arange(out.shape[1]) < size[:, None]] = values
    return out


def widened(x: np.ndarray, columns: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, columns - x.shape[1]))) if x.shape[1] < columns else x


def products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of integers (norms below NORM): float64 where that is exact, else int64."""
    columns = max(left.shape[1], right.shape[1])
    left, right = widened(left, columns), widened(right, columns)
    bound = np.sqrt((left**2).sum(axis=1).max(initial=0) * (right**2).sum(axis=1).max(initial=0))
    return left @ right.T if bound < 1 << 52 else left.astype(np.int64) @ right.T.astype(np.int64)


def directions(sample: np.ndarray, n: int = REFERENCES, rounds: int = 6) -> np.ndarray:
    """Unit vectors that the rows of ``sample`` lie around (spherical k-means from far-apart rows)."""
    norm = np.linalg.norm(sample, axis=1)
    rows = sample[norm > 0] / norm[norm > 0][:, None]
    if not len(rows):
        return np.zeros((0, sample.shape[1]))
    chosen, near = [0], rows @ rows[0]
    while len(chosen) < min(n, len(rows)) and near.min() < 1 - 1e-9:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[chosen[-1]])
    centers = rows[chosen]
    for _ in range(rounds):
        own = (rows @ centers.T).argmax(axis=1)
        sums = np.zeros_like(centers)
        np.add.at(sums, own, rows)
        size = np.linalg.norm(sums, axis=1)
        centers = np.where(size[:, None] > 1e-9, sums / np.maximum(size, 1e-9)[:, None], centers)
    return centers


def angles_to(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Angle of each row to each direction; a zero vector has a right angle to all."""
    columns = max(rows.shape[1], centers.shape[1])
    rows, centers = widened(rows, columns), widened(centers, columns)
    norm = np.linalg.norm(rows, axis=1)[:, None]
    return np.arccos(np.clip(rows @ centers.T / np.where(norm > 0, norm, 1), -1, 1))


ROW = "row bigint, vec_id bigint, label bigint, anchor boolean, q array<double>, norm double, angles array<double>, cell int, angle double"


def _placed(centers: np.ndarray, scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = batch.column("vector")
            q = np.floor(scale * matrix(lists))
            with np.errstate(over="ignore"):
                norm = np.sqrt((q**2).sum(axis=1))
            good = norm < NORM
            q[~good] = 0
            angles = angles_to(q, centers)
            cell = angles.argmin(axis=1) if len(centers) else np.zeros(len(q), np.int64)
            angle = angles[np.arange(len(q)), cell] if len(centers) else np.zeros(len(q))
            grid = lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64())) if x.shape[1] else pa.array([[]] * len(x), pa.list_(pa.float64()))
            columns = {c: batch.column(c) for c in ("row", "vec_id", "label", "anchor")}
            columns |= {"q": grid(q), "norm": pa.array(norm), "angles": grid(angles), "cell": pa.array(cell, pa.int32()), "angle": pa.array(angle)}
            yield pa.record_batch(list(columns.values()), list(columns)).filter(pa.array(good))

    return run


@dataclass
class Anchors:
    """Anchors of one block; ``least`` is the lowest score that may still count for each."""

    row: np.ndarray
    vec_id: np.ndarray
    label: np.ndarray
    q: np.ndarray
    norm: np.ndarray
    angles: np.ndarray
    least: np.ndarray
    positives: list[list[tuple[int, int]]] | None = None  # (vec_id, score), best first

    def __len__(self) -> int:
        return len(self.row)


def score_bounds(anchors: Anchors, angles: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bound of each anchor's scores with the rows that have these angles and norms."""
    low, high = angles.min(axis=0), angles.max(axis=0)
    own = anchors.angles
    if own.shape[1]:
        near = np.maximum(np.maximum(low - own, own - high).max(axis=1), 0)
        far = np.minimum(np.minimum(own + high, 2 * np.pi - own - low).min(axis=1), np.pi)
    else:
        near, far = np.zeros(len(own)), np.full(len(own), np.pi)
    most, least = anchors.norm * norm.max(), anchors.norm * norm.min()
    top, bottom = np.cos(np.maximum(near - MARGIN, 0)), np.cos(np.minimum(far + MARGIN, np.pi))
    room = 1 + MARGIN * most
    return np.where(bottom >= 0, bottom * least, bottom * most) - room, np.where(top >= 0, top * most, top * least) + room


class Best:
    """The ``k`` best rows of each group so far: higher scores first, then smaller ids."""

    def __init__(self, groups: int, k: int):
        self.k = k
        self.rows = np.zeros((4, 0), np.int64)  # group, score, vec_id, row
        self.least = np.full(groups, LEAST, np.int64)  # score of the last of k

    def add(self, group: np.ndarray, score: np.ndarray, vec_id: np.ndarray, row: np.ndarray) -> None:
        if not len(group):
            return
        rows = np.concatenate([self.rows, np.stack([group, score.astype(np.int64), vec_id, row])], axis=1)
        rows = rows[:, np.lexsort((rows[3], rows[2], ~rows[1], rows[0]))]
        group = rows[0]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        self.rows = rows[:, place < self.k]
        last = rows[:, place == self.k - 1]
        self.least[last[0]] = last[1]


def _windows(batches: Iterator[pa.RecordBatch]):
    """(row, vec_id, label, q, norm, angles) of neighbouring rows of one cell."""
    for batch in batches:
        cell = batch.column("cell").to_numpy()
        cuts = np.unique(np.concatenate([[0], np.flatnonzero(np.diff(cell)) + 1, np.arange(0, len(cell), WINDOW_ROWS), [len(cell)]]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            part = batch.slice(a, b - a)
            yield *(part.column(c).to_numpy() for c in ("row", "vec_id", "label")), matrix(part.column("q")), part.column("norm").to_numpy(), matrix(part.column("angles"))


def _tiles(which: np.ndarray) -> Iterator[np.ndarray]:
    for k in range(0, len(which), TILE):
        yield which[k : k + TILE]


def _candidates(scores: np.ndarray, mask: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places under ``mask`` that can be among the k best of their line."""
    if scores.shape[1] > k:
        low = scores.dtype.type(LEAST)
        kth = np.partition(np.where(mask, scores, low), scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        mask = mask & (scores >= kth[:, None])
    return np.nonzero(mask)


def best_positives(anchors: Anchors, windows, k: int) -> tuple[np.ndarray, int]:
    """([anchor, score, vec_id, row] of the k best rows of each anchor's label, pairs scored)."""
    best, scored = Best(len(anchors), k), 0
    for row, vec_id, label, q, norm, angles in windows:
        least = np.maximum(best.least, anchors.least)
        _, top = score_bounds(anchors, angles, norm)
        for some in _tiles(np.flatnonzero((top >= least) & np.isin(anchors.label, label))):
            scores = products(anchors.q[some], q)
            scored += scores.size
            mask = (anchors.label[some][:, None] == label) & (anchors.row[some][:, None] != row) & (scores >= least[some][:, None])
            a, b = _candidates(scores, mask, k)
            best.add(some[a], scores[a, b], vec_id[b], row[b])
    return best.rows, scored


def best_negatives(anchors: Anchors, windows, k: int, share: tuple[int, int]) -> tuple[np.ndarray, int]:
    """([positive, score, vec_id, row], pairs scored): the k best rows of other labels for
    each positive of each anchor, numbered through, between a share of its score and it."""
    of = np.repeat(np.arange(len(anchors)), [len(p) for p in anchors.positives])
    high = np.array([s for p in anchors.positives for _, s in p], np.int64)
    low = np.array([-(-share[0] * s // share[1]) for s in high.tolist()], np.int64)
    first = np.searchsorted(of, np.arange(len(anchors) + 1))
    filled = np.flatnonzero(first[1:] > first[:-1])
    lowest, highest = np.full(len(anchors), 1 << 62, np.int64), np.full(len(anchors), LEAST, np.int64)
    if len(filled):
        lowest[filled], highest[filled] = np.minimum.reduceat(low, first[filled]), np.maximum.reduceat(high, first[filled])
    best, scored = Best(len(of), k), 0
    for row, vec_id, label, q, norm, angles in windows:
        bottom, top = score_bounds(anchors, angles, norm)
        for some in _tiles(np.flatnonzero((top >= lowest) & (bottom <= highest))):
            scores = products(anchors.q[some], q)
            scored += scores.size
            mask = (anchors.label[some][:, None] != label) & (scores >= lowest[some][:, None]) & (scores <= highest[some][:, None])
            a, b = np.nonzero(mask)
            found, a = scores[a, b].astype(np.int64), some[a]
            for place in range(int(np.diff(first).max(initial=0))):  # the first, second, ... positive of all anchors
                own = first[a] + place
                fits = np.flatnonzero(own < first[a + 1])
                fits = fits[(found[fits] >= np.maximum(low, best.least)[own[fits]]) & (found[fits] <= high[own[fits]])]
                best.add(own[fits], found[fits], vec_id[b[fits]], row[b[fits]])
    return best.rows, scored


POSITIVE = "anchor bigint, anchor_id bigint, score bigint, vec_id bigint, row bigint"


def _positives(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        a, score, vec_id, row = best_positives(anchors, _windows(batches), k)[0]
        columns = {"anchor": anchors.row[a], "anchor_id": anchors.vec_id[a], "score": score, "vec_id": vec_id, "row": row}
        yield pa.record_batch([pa.array(c, pa.int64()) for c in columns.values()], list(columns))

    return run


NEGATIVE = "anchor bigint, place int, anchor_id bigint, positive_id bigint, positive_score bigint, score bigint, vec_id bigint, row bigint"


def _negatives(shared, k: int, share: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors: Anchors = shared.value
        rows = best_negatives(anchors, _windows(batches), k, share)[0]
        of = np.repeat(np.arange(len(anchors)), [len(p) for p in anchors.positives])
        places = np.concatenate([np.arange(len(p)) for p in anchors.positives]) if len(of) else of
        ids, scores = (np.array([x[c] for p in anchors.positives for x in p], np.int64) for c in (0, 1))
        p = rows[0]
        columns = [anchors.row[of[p]], places[p], anchors.vec_id[of[p]], ids[p], scores[p], *rows[1:]]
        names = [x.split()[0] for x in NEGATIVE.split(", ")]
        yield pa.record_batch([pa.array(c, pa.int32() if n == "place" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

    return run


def _first(df: DataFrame, groups: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*groups).orderBy(F.desc("score"), "vec_id", "row")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _blocks(rows: DataFrame, sample, most: int, most_bytes: int, k: int) -> Iterator[Anchors]:
    """The anchors in blocks of bounded size; the driver holds one."""

    def made(block) -> Anchors:
        q = matrix(pa.array([r.q for r in block], pa.list_(pa.float64())))
        numbers = [np.array([r[c] for r in block], np.int64) for c in ("row", "vec_id", "label")]
        out = Anchors(*numbers, q, np.array([r.norm for r in block]), np.array([r.angles for r in block]), np.full(len(block), LEAST, np.int64))
        for some in _tiles(np.arange(len(block))):  # the sample's k-th best can only be surpassed
            scores = products(q[some], sample[2]).astype(np.int64)
            mine = (out.label[some][:, None] == sample[1]) & (out.row[some][:, None] != sample[0])
            if scores.shape[1] >= k:
                out.least[some] = np.partition(np.where(mine, scores, LEAST), -k, axis=1)[:, -k]
        return out

    block, size = [], 0
    for row in rows.where("anchor").select("row", "vec_id", "label", "q", "norm", "angles").toLocalIterator():
        block.append(row)
        size += 8 * (len(row.q) + len(row.angles))
        if len(block) >= most or size >= most_bytes:
            yield made(block)
            block, size = [], 0
    if block:
        yield made(block)


RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    scale: float = 256, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
    anchors_per_block: int = ANCHORS, sample_rows: int = SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Components become floor(scale * x); a score is the integer inner product with an
    anchor, higher ones come first, then smaller ids (null before all). The positives of
    an anchor are its first other rows of its label. For each of them the negatives are
    the first rows of other labels whose score is ``share`` of the positive's or more,
    and no more than it.

    Rows with a null label or vector, with a null or non-finite component, or with
    components so large that scores need not fit 62 bits (norm of 2^31 after scaling)
    take no part. Shorter vectors end in zeros. Equal ids are different rows, and
    repeated anchors give rows each; an anchor without positives gives none, nor does an
    empty table. Ids and labels are integers; other columns are not read. The sample
    decides what is scored in vain, never a result.
    """
    spark: SparkSession = vectors.sparkSession
    vector = F.col(vector_col).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = vectors.select(
        F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("vec_id"),
        F.col(label_col).cast("bigint").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"), vector.alias("vector"),
    ).where(F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad))
    few = lambda df: df.orderBy(F.xxhash64("row"), "row").limit(sample_rows).collect()
    q = np.floor(scale * matrix(pa.array([r.vector for r in few(rows.select("row", "vector"))], pa.list_(pa.float64()))))
    with np.errstate(over="ignore"):
        q = q[np.sqrt((q**2).sum(axis=1)) < NORM]
    placed = rows.mapInArrow(_placed(directions(q), scale), ROW)
    # equal vectors are spread by their numbers
    placed = placed.withColumn("spread", F.xxhash64("row")).repartitionByRange("cell", "angle", "spread")
    placed = persist_table(spark, placed.sortWithinPartitions("cell", "angle").drop("spread"), "vectors")
    drawn = few(placed.select("row", "label", "q"))
    sample = (*(np.array([r[c] for r in drawn], np.int64) for c in ("row", "label")), matrix(pa.array([r.q for r in drawn], pa.list_(pa.float64()))))
    folder, parts = work_folder(spark, "hard-negatives"), []
    for anchors in _blocks(placed, sample, anchors_per_block, ANCHOR_BYTES, positives):
        shared = spark.sparkContext.broadcast(anchors)
        found = _first(placed.mapInArrow(_positives(shared, positives), POSITIVE), ["anchor"], positives)
        own: dict[int, list[tuple[int, int]]] = {}
        for r in found.orderBy("anchor", "rank").select("anchor", "vec_id", "score").toLocalIterator():
            own.setdefault(r.anchor, []).append((r.vec_id, r.score))  # as many as a block of anchors has
        anchors.positives = [own.get(r, []) for r in anchors.row.tolist()]
        windows = spark.sparkContext.broadcast(anchors)
        found = _first(placed.mapInArrow(_negatives(windows, negatives, share), NEGATIVE), ["anchor", "place"], negatives)
        null = F.lit(NULL_ID)
        found.select(
            F.nullif("anchor_id", null).alias("anchor_id"), F.nullif("positive_id", null).alias("positive_id"), "rank",
            F.nullif("vec_id", null).alias("negative_id"), "positive_score", F.col("score").alias("negative_score"),
        ).write.parquet(part := f"{folder}/block-{len(parts)}")
        parts.append(part)
        shared.unpersist()
        windows.unpersist()
    return spark.read.schema(RESULT).parquet(*parts) if parts else spark.createDataFrame([], RESULT)
