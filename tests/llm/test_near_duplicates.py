import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from mirrorleaf.llm import near_duplicates as nd
from mirrorleaf.llm.components import components
from tests.llm.conftest import ROWS, colliding
from tests.llm.test_decontaminate import words


def shingles(text):
    own = words(text)
    n = min(5, len(own))
    return frozenset(" ".join(own[k : k + n]) for k in range(len(own) - n + 1)) if own else (text or "",)


def brute(rows, threshold=0.8):
    """[(id, least id of the class, links)] of each row, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]

    def linked(a, b):
        if isinstance(a, tuple) or isinstance(b, tuple):
            return a == b
        return len(a & b) / len(a | b) >= threshold

    near = [[j for j in range(len(rows)) if j != k and linked(sets[k], sets[j])] for k in range(len(rows))]
    out = []
    for k, (doc, _) in enumerate(rows):
        met, todo = {k}, [k]
        while todo:
            for j in near[todo.pop()]:
                if j not in met:
                    met.add(j)
                    todo.append(j)
        least = min(nd.NULL_ID if rows[j][0] is None else rows[j][0] for j in met)
        out.append((nd.NULL_ID if doc is None else doc, least, len(near[k])))
    return sorted(out)


def corpus():
    rnd = random.Random(7)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(5))
    rows = []
    for _ in range(12):
        base = [word() for _ in range(rnd.choice([30, 90, 200]))]
        for _ in range(rnd.choice([1, 2, 9])):
            copy = list(base)
            for _ in range(rnd.choice([0, 0, 1, 2, 6])):
                copy[rnd.randrange(len(copy))] = word()
            rows.append((len(rows), " ".join(copy) + rnd.choice(["", ".", " !"])))
    return rows


def found(docs, **options):
    return sorted((r.id, r.class_id, r.n_links) for r in nd.near_duplicates(docs, **options).collect())


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    expected = brute(rows)
    assert found(docs) == expected
    assert len({c for _, c, _ in expected}) < len(rows)
    # components in many blocks give the same
    assert found(docs, block_rows=2) == expected


def test_odd_rows(odd, none):
    assert found(odd) == brute([r[:2] for r in ROWS])
    kept = nd.keep_one(odd)
    assert kept.columns == odd.columns
    texts = Counter((r.doc_id, r.text) for r in kept.collect())
    # copies of one row go, empty texts leave one, other texts of the same id stay
    assert texts[(8, ROWS[7][1])] == 1 and texts[(8, ROWS[9][1])] == 1 and texts[(None, ROWS[12][1])] == 1
    assert sum(n for (_, t), n in texts.items() if not t) == 1
    assert found(none) == [] and nd.keep_one(none).count() == 0


def test_keep_one_of_each_class(spark):
    rows = corpus()
    kept = {r.doc_id for r in nd.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert kept == {c for _, c, _ in brute(rows)}


def test_prefix_is_shortened_to_the_recall():
    assert nd.prefix_length(0.8, nd.TREES, nd.LEVELS, 0.5) == nd.LEVELS
    length = nd.prefix_length(0.8, nd.TREES, nd.LEVELS, nd.RECALL)
    miss = lambda n: (1 - 0.8**n) ** nd.TREES
    assert miss(length) <= 1 - nd.RECALL < miss(length + 1)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 1 << 63, 200).astype(np.uint64)])
    x, y = nd.signatures([a, b], 400)
    assert abs((x == y).mean() - 800 / 1200) < 0.1


def test_common_shingles():
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 5000, rng.integers(1, 4000))) for _ in range(9)]
    expected = [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]
    assert (nd.common_shingles(sets[:4], sets[4:]) == expected).all()
    assert [len(s) for s in nd.text_sets(pa.array(["a b", None, "a b c d e f"]))] == [1, 0, 2]


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(60), rnd.randrange(60)) for _ in range(35)] + [(k, k + 1) for k in range(100, 130)]
    label = {n: n for e in edges for n in e}
    for _ in edges:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    alone = {n for n in label if all(n not in e or e == (n, n) for e in edges)}
    rows = components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    assert {r.node: r.component for r in rows} == {n: c for n, c in label.items() if n not in alone}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_texts_of_one_hash_are_two(spark):
    x, y = colliding()
    rows = [(1, x), (2, y), (3, x), (4, f"{x} and more words follow here"), (5, f"{y} and more words follow here")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted((r.id, r.class_id, r.n_links) for r in nd.near_duplicates(docs).collect()) == brute(rows)
