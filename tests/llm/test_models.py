import numpy as np
import pytest

from mirrorleaf.llm import ordinal, quality, toxicity
from mirrorleaf.llm.queries import op5_quality, op10_toxicity
from tests.llm.conftest import ROWS


def sample(n=600, grades=4, seed=0):
    rng = np.random.default_rng(seed)
    x = (rng.random((n, 12)) < 0.4).astype(float)
    score = x @ np.array([2, 1, 0.5, -1, -2, 1.5, 0, 0, 0, 0, 0, 0]) + rng.logistic(size=n) * 0.3
    cuts = np.quantile(score, [0.3, 0.6, 0.9][: grades - 1])
    rows = [(np.flatnonzero(r).astype(np.uint64) + 100, np.ones(int(r.sum()))) for r in x]
    return rows, np.searchsorted(cuts, score).astype(float).tolist()


def test_four_grades_share_weights_over_ordered_thresholds():
    rows, grades = sample()
    model = ordinal.fit(rows[:400], grades[:400])
    assert (np.diff(model.thresholds) > 0).all() and len(model.thresholds) == 3
    tails = model.tails(model.scores(rows[400:]))
    assert (np.diff(tails, axis=1) <= 0).all()
    expected = model.expected(tails)
    assert np.corrcoef(expected, grades[400:])[0, 1] > 0.85
    assert ((tails[:, 1] > 0.5) == (np.array(grades[400:]) >= 2)).mean() > 0.85


def test_gradient_by_differences():
    rows, grades = sample(80, seed=4)
    model = ordinal.fit(rows, grades, steps=400)

    def loss(weights, thresholds):
        m = ordinal.Ordinal(model.grades, model.hashes, weights, thresholds)
        tails = np.column_stack([np.ones(len(rows)), m.tails(m.scores(rows)), np.zeros(len(rows))])
        y = np.array(grades, int)
        p = tails[np.arange(len(y)), y] - tails[np.arange(len(y)), y + 1]
        return -np.log(p).mean() + 1e-4 / 2 * (weights**2).sum()

    at = loss(model.weights, model.thresholds)
    for k in range(len(model.weights)):  # a minimum: no step to either side is better
        for step in (-0.05, 0.05):
            moved = model.weights.copy()
            moved[k] += step
            assert loss(moved, model.thresholds) > at - 1e-3
    for k in range(3):
        moved = model.thresholds.copy()
        moved[k] += 0.05
        assert loss(model.weights, moved) > at - 1e-3


def test_few_grades():
    rows, grades = sample(20)
    one = ordinal.fit(rows, [1.0] * 20)
    assert one.tails(one.scores(rows)).shape == (20, 0) and (one.expected(one.tails(one.scores(rows))) == 1).all()
    assert ordinal.fit([], []).grades == []


LABELS = [(1, 1), (2, 1), (3, 0), (6, 1), (7, 0), (9, None), (None, 1), (8, 0), (8, 1), (404, 1)]


@pytest.mark.parametrize("module, make, grade", [
    (quality, quality.quality_model, quality.grade_quality), (toxicity, toxicity.toxicity_model, toxicity.grade_toxicity),
])
def test_odd_rows(spark, odd, none, module, make, grade):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, grade int")
    model = make(odd, labels, grade_col="grade", min_rows=1, screen=0.0)
    assert model.grades == [0.0, 1.0]
    rows = grade(odd, model).collect()
    assert len(rows) == len(ROWS) and all(0 <= r[1] <= 1 and 0 <= r[2] <= 1 for r in rows)
    assert grade(none, model).count() == 0
    nothing = make(odd, labels.limit(0), grade_col="grade")
    row = grade(odd, nothing).first()
    assert row[1] is None and row[2] is None and row[3] is (module is quality)
    single = make(odd, labels.where("grade = 1"), grade_col="grade")
    assert {r[1] for r in grade(odd, single).collect()} == {1.0}


def test_only_words_tell_these_apart():
    """Texts of equal shapes, lengths and repetition, graded by which words they hold."""
    rng = np.random.default_rng(5)
    shared = [f"ab{a}{b}" for a in "cdefghij" for b in "klmnop"]
    kinds = [["pills", "rates", "offer"], ["novel", "essay", "music"], ["proof", "lemma", "axiom"]]

    def text(grade):
        own = rng.choice(shared, 17, replace=False).tolist() + rng.choice(kinds[grade], 2, replace=False).tolist()
        return " ".join(w.ljust(5, "x") for w in rng.permutation(own))

    grades = [k % 3 for k in range(600)]
    rows = quality.features([text(g) for g in grades])
    shapes = {tuple(h[h >= 1 << quality.WORD_BITS].tolist()) for h, _ in rows}
    assert len(shapes) == 1
    model = ordinal.fit(rows[:400], [float(g) for g in grades[:400]])
    tails = model.tails(model.scores(rows[400:]))
    assert (np.rint(model.expected(tails)) == grades[400:]).mean() > 0.95


def test_order_of_words_counts():
    """Pairs of neighbours tell texts of the same words apart."""
    good, bad = "alpha beta gamma delta", "delta gamma beta alpha"
    rows = quality.features([good, bad] * 10)
    model = ordinal.fit(rows, [1.0, 0.0] * 10)
    assert (model.tails(model.scores(rows))[:, 0] > 0.5).tolist() == [True, False] * 10


def test_word_features_by_hand():
    a, b, both, none, mark = quality.word_features(["Word", "two", "word two", None, "!?"])
    assert len(a) == len(b) == 1 and len(both) == 3 and set(a) | set(b) < set(both)
    assert len(none) == len(mark) == 0
    # a pair never reaches over the end of a text
    assert [len(x) for x in quality.word_features(["word", "two"])] == [1, 1]


def test_filter_keeps_columns(spark, odd, none):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, grade int")
    model = quality.quality_model(odd, labels, grade_col="grade", min_rows=1)
    kept = quality.drop_low_quality(odd, model)
    assert kept.columns == odd.columns
    selected = sorted((r.id for r in quality.grade_quality(odd, model).where("selected").collect()), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == selected
    assert quality.drop_low_quality(none, model).count() == 0


def test_sample_is_bounded(spark):
    rows = spark.range(50).selectExpr("id", "cast(id as string) as text")
    grades = spark.range(80).selectExpr("id", "cast(id % 2 as int) as grade")
    assert ordinal.labelled(rows, grades, 10).count() <= 10


@pytest.mark.parametrize("query, predicted, label, least", [(op5_quality, "selected", "quality", 0.97), (op10_toxicity, "toxic", "toxic", 0.93)])
def test_held_out_accuracy(spark, query, predicted, label, least):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").selectExpr("doc_id", f"{label} = 1 as truth")
    rows = query(spark, sf).where("held_out").join(labels, "doc_id").collect()
    assert len(rows) > 80 and sum(r[predicted] == r.truth for r in rows) / len(rows) >= least
