import math
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from mirrorleaf.llm import hard_negatives as hn

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=100, positives=5, negatives=5):
    """(anchor, positive, rank, negative, scores) by comparing all with all, in Python's integers."""
    good = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in vector]
        if math.sqrt(sum(x * x for x in q)) < 2**31:
            good.append((vec_id, q, label))
    order = lambda x: (-x[0], x[1] is not None, x[1] or 0)
    for k, (anchor, a, label) in enumerate(good):
        if anchor is None or anchor % every:
            continue
        scores = [(sum(x * y for x, y in zip(a, q)), v, other) for j, (v, q, other) in enumerate(good) if j != k]
        for p, positive, _ in sorted([s for s in scores if s[2] == label], key=order)[:positives]:
            fits = [s for s in scores if s[2] != label and 80 * p <= 100 * s[0] <= 100 * p]
            for rank, (n, negative, _) in enumerate(sorted(fits, key=order)[:negatives], 1):
                yield anchor, positive, rank, negative, p, n


def check(spark, rows, every=100, **options):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = hn.mine_hard_negatives(docs, F.col("vec_id") % every == 0, **options)
    assert found.dtypes == [tuple(x.split()) for x in hn.RESULT.split(", ")]
    found = sorted(map(tuple, found.collect()), key=repr)
    assert found == sorted(brute(rows, every), key=repr)
    return found


def clustered(n, seed, spread=0.3, dim=8):
    rnd = np.random.default_rng(seed)
    centers = rnd.normal(size=(6, dim))
    own = rnd.integers(0, 6, n)
    x = centers[own] + spread * rnd.normal(size=(n, dim))
    return [(k, [float(v) for v in row], int((own[k] + rnd.integers(0, 2)) % 4)) for k, row in enumerate(x)]


def test_against_brute_force(spark):
    assert len(check(spark, clustered(900, 1), every=50)) > 100


def test_blocks_of_anchors_and_small_samples(spark):
    rows = clustered(300, 2)
    assert check(spark, rows, every=10, anchors_per_block=7, sample_rows=3)
    assert check(spark, rows, every=10, sample_rows=1)


def test_odd_rows(spark):
    rnd = random.Random(4)
    rows = [(k % 120, [rnd.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)], k % 3) for k in range(200)]  # ties, repeated ids
    rows += [(500, [0.0] * 4, 1), (501, [0.0] * 4, 2), (502, [], 1), (503, [1.0], 0), (504, [1.0, 1.0, 1.0, 1.0, 1.0], 2)]
    rows += [(600, None, 1), (601, [1.0] * 4, None), (602, [1.0, None, 1.0, 1.0], 1), (603, [math.nan] * 4, 1), (604, [math.inf, 0.0, 0.0, 0.0], 1)]
    rows += [(None, [1.0] * 4, 0), (None, [0.9] * 4, 1), (-100, [1.0] * 4, 7), (-10, [1.0, 0.4, 0.4, 1.0], 8)]
    rows += [(700, [3.0e38] * 4, 1), (710, [9e6, 0.0, 0.0, 0.0], 1), (720, [4e6, 4e6, 0.0, 0.0], 1), (721, [4e6, 3.9e6, 0.0, 1.0], 2), (722, [4e6, 4e6, 0.0, 1.0], 1)]
    assert check(spark, rows, every=10)
    assert check(spark, [(0, [1.0], 1)]) == [] and check(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []
    assert check(spark, []) == []


def test_many_equal_vectors(spark):
    rows = [(k, [0.5, 0.5, 0.1], k % 2) for k in range(2500)] + [(3000 + k, [0.5, 0.4, 0.1 * k], k % 2) for k in range(9)]
    found = check(spark, rows, every=500)
    assert {1, 3, 5, 7, 9} <= {f[3] for f in found}


def test_clashing_names(spark):
    rows = clustered(120, 3)
    docs = spark.createDataFrame([(*r, "x", 1.0, 2) for r in rows], SCHEMA + ", row string, angle double, rank int")
    found = hn.mine_hard_negatives(docs, F.col("vec_id") % 20 == 0).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute(rows, 20), key=repr)


def test_query_with_changed_labels(spark, tmp_path):
    from mirrorleaf.llm.queries import QUERIES

    rows = clustered(400, 6)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = sorted(map(tuple, QUERIES["op11_hard_negatives"](spark, str(tmp_path)).collect()))
    shifted = [(v, x, (y + 1) % 10 if v % 7 == 0 else y) for v, x, y in rows]
    assert found == sorted(brute(shifted)) and found


def anchors_of(q, labels, centers):
    n = len(q)
    return hn.Anchors(np.arange(n), np.arange(n), labels, q, np.linalg.norm(q, axis=1), hn.angles_to(q, centers), np.full(n, hn.LEAST, np.int64))


def test_bounds_hold_and_spare_work():
    rnd = np.random.default_rng(7)
    centers = rnd.normal(size=(8, 16))
    own = np.sort(rnd.integers(0, 8, 4000))
    q = np.floor(256 * (centers[own] + 0.1 * rnd.normal(size=(4000, 16))) * rnd.uniform(0.1, 2, (4000, 1)))
    q[5] = 0
    found = hn.directions(q[::9], 8)
    angles, norm, labels = hn.angles_to(q, found), np.linalg.norm(q, axis=1), rnd.integers(0, 3, 4000)
    anchors = anchors_of(q[::40], labels[::40], found)
    windows = []
    for k in range(0, 4000, 100):
        part = slice(k, k + 100)
        low, high = hn.score_bounds(anchors, angles[part], norm[part])
        scores = hn.products(anchors.q, q[part])
        assert (scores >= low[:, None]).all() and (scores <= high[:, None]).all()
        windows.append((np.arange(k, k + 100) + 10_000, np.arange(k, k + 100), labels[part], q[part], norm[part], angles[part]))
    rows, scored = hn.best_positives(anchors, windows, 5)
    assert scored < 0.6 * 100 * 4000
    assert sorted(rows[0].tolist()) == sorted(list(range(100)) * 5)
    anchors.positives = [[(0, int(s)) for s in rows[1][rows[0] == k]] for k in range(100)]
    assert hn.best_negatives(anchors, windows, 5, (80, 100))[1] < 0.5 * 100 * 4000


def test_products_are_exact():
    big = np.array([[2.0**30, 1.0], [2.0**30 - 1, -3.0]])
    assert hn.products(big, big).tolist() == [[int(sum(int(x) * int(y) for x, y in zip(a, b))) for b in big] for a in big]
    assert hn.products(np.ones((2, 3)), np.ones((1, 5))).tolist() == [[3], [3]]


def test_matrix_of_ragged_lists():
    assert hn.matrix(pa.array([[1.0], [], [2.0, 3.0]], pa.list_(pa.float64()))).tolist() == [[1, 0], [0, 0], [2, 3]]
