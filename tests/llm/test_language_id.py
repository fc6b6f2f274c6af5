from collections import Counter

import numpy as np

from mirrorleaf.llm import language_id as li
from tests.llm.conftest import ROWS

TEXTS = [("the cat and the hat", "en"), ("the dog, the log", "en"), ("der Hund und die Katze", "de"), ("le chat et la souris", "fr"), ("Über Äpfel", "de")]


def grams(text):
    """N-grams of a text, in plain Python."""
    words = "".join(c.lower() if c.isalpha() else " " for c in text or "").split()
    out = Counter()
    for w in words:
        out.update(w)
        padded = f"\x01{w}\x01"
        for n in (2, 3):
            out.update(padded[k : k + n] for k in range(len(padded) - n + 1))
    return out


def name(code):
    out = ""
    while code:
        out = chr(int(code) & ((1 << 21) - 1)) + out
        code = int(code) >> 21
    return out


def test_counts_equal_plain_python():
    texts = [t for t, _ in TEXTS] + [None, "", "1 2", "日本 x", "a", "..a..b", "ß😀é"]
    doc, gram, count = li._counts(texts)
    for k, text in enumerate(texts):
        found = {name(g): int(c) for d, g, c in zip(doc, gram, count) if d == k}
        assert found == dict(grams(text)), text


def test_profiles_and_distances_by_brute_force(spark):
    labelled = spark.createDataFrame(TEXTS + [(None, "en"), ("x", None)], "text string, lang string")
    top = 12
    rows = li.profiles(labelled, top).collect()
    code = lambda g: sum(ord(c) << (21 * k) for k, c in enumerate(reversed(g)))
    ranked = lambda c: [g for g, _ in sorted(c.items(), key=lambda x: (-x[1], code(x[0])))][:top]
    expected = {}
    for lang in ("en", "de", "fr"):
        total = sum((grams(t) for t, x in TEXTS if x == lang), Counter())
        expected[lang] = ranked(total)
        mine = sorted((r["rank"], name(r.gram)) for r in rows if r.lang == lang)
        assert [g for _, g in mine] == expected[lang]
    texts = ["the hat", "und der Hund", "souris", "?"]
    names, score = li.Ranks(rows, top).predict(texts)
    for text, found, value in zip(texts, names, score):
        own = ranked(grams(text))
        distances = {x: sum(abs(p.index(g) - k) if g in p else top for k, g in enumerate(own)) for x, p in expected.items()}
        if not own:
            assert (found, value) == ("und", 0)
            continue
        best = min(sorted(distances), key=distances.get)
        assert found == best and np.isclose(value, 1 - distances[best] / (top * len(own)))


def test_odd_rows(odd, none):
    found = li.predict_languages(odd, odd).collect()
    assert len(found) == len(ROWS)
    assert {r.lang_pred for r in found if r.id in (2, 3, 4)} == {"und"}
    assert all(0 <= r.score <= 1 for r in found)
    assert {r.lang_pred for r in li.predict_languages(odd, none).collect()} == {"und"}
    assert li.predict_languages(none, odd).count() == 0


def test_held_out_accuracy(spark):
    from mirrorleaf.llm.queries import op2_language_id

    sf = "/root/testdata/sf0.01"
    found = op2_language_id(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id")
    test = found.where("held_out").collect()
    assert len(test) > 200 and sum(r.lang == r.lang_pred for r in test) / len(test) > 0.97


def test_the_limit_of_a_profile_is_pushed_down(spark):
    """No task ranks all n-grams of a language."""
    rows = spark.createDataFrame([("some text", "en")], "text string, lang string")
    assert li.profiles(rows)._jdf.queryExecution().executedPlan().toString().count("WindowGroupLimit") == 2
