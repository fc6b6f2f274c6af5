import random
import re

import numpy as np
import pyarrow as pa
import pytest

from mirrorleaf.llm import decontaminate as dc
from mirrorleaf.llm.suffix_array import SuffixArray
from tests.llm.conftest import PASSAGE, ROWS, colliding

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, window=10):
    """(words, hit words, items with a window) by comparing every position."""
    own, hit, found = words(text), set(), set()
    for name, item in items:
        other = words(item)
        n = min(window, len(other))
        for j in range(len(other) - n + 1 if n else 0):
            for k in range(len(own) - n + 1):
                if own[k : k + n] == other[j : j + n]:
                    hit.update(range(k, k + n))
                    found.add(name)
    return len(own), len(hit), found


@pytest.mark.parametrize("seed", range(4))
def test_suffix_array_sorts_and_finds(seed):
    rnd = np.random.default_rng(seed)
    texts = [rnd.integers(0, 3, rnd.integers(0, 40)).astype(np.uint64) * np.uint64(1 << 60) for _ in range(8)]
    offsets = np.cumsum([0, *map(len, texts)])
    flat = np.concatenate(texts)
    array = SuffixArray(flat, offsets, 7)
    ends = np.repeat(offsets[1:], np.diff(offsets))
    keys = [tuple(flat[k : min(k + 7, ends[k])]) for k in array.order]
    assert keys == sorted(keys)
    queries = rnd.integers(0, 4, (50, 7)).astype(np.uint64) * np.uint64(1 << 60)
    lengths = rnd.integers(1, 8, 50)
    low, high = array.find(array.ranks(queries.ravel()).reshape(50, 7), lengths)
    for q, n, a, b in zip(queries, lengths, low, high):
        want = [k for k in range(len(flat)) if k + n <= ends[k] and (flat[k : k + n] == q[:n]).all()]
        assert sorted(array.order[a:b]) == want


def test_spans_against_brute_force(spark):
    rnd = random.Random(5)
    item = lambda n: " ".join(rnd.choice(["Ab", "b", "c", "d9"]) for _ in range(n))
    items = [(k, item(rnd.choice([0, 1, 3, 9, 10, 11, 25]))) for k in range(12)] + [(99, None), (12, "zz" * 40)]
    docs = [(k, "--".join([item(30), rnd.choice(items)[1] or "", item(8)])) for k in range(25)] + [(50, None)]
    d = spark.createDataFrame(docs, "doc_id int, text string")
    b = spark.createDataFrame(items, "item_id int, text string")
    for block in (1 << 20, 40):  # in one block, and in many
        found = {r.id: r for r in dc.benchmark_spans(d, b, block_bytes=block).withColumn("n_hit", dc.hit_words()).collect()}
        for k, text in docs:
            n, hit, names = brute(text, items)
            assert (found[k].n_words, found[k].n_hit) == (n, hit)
            assert set(found[k]["items"]) == {str(x) for x in names}
            assert {s.item_id for s in found[k].spans} <= set(found[k]["items"])


def test_spans_are_longest_matches(spark):
    d = spark.createDataFrame([(1, "x " + PASSAGE + " y")], "doc_id int, text string")
    b = spark.createDataFrame([("i", "q " + PASSAGE + " z")], "item_id string, text string")
    (span,) = dc.benchmark_spans(d, b).first().spans
    assert (span.item_id, span.doc_word, span.item_word, span.n_words) == ("i", 1, 1, len(PASSAGE.split()))


def test_odd_rows(spark, odd, none):
    b = spark.createDataFrame([("i", PASSAGE), ("w", "word"), (None, "éléphant"), ("e", ""), ("n", None), ("w", "word")], "item_id string, text string")
    rows = dc.benchmark_spans(odd, b).collect()
    assert len(rows) == len(ROWS)
    hits = {r.id for r in rows if r.spans}
    assert hits == {6, 9, 10}
    kept = dc.drop_contaminated(odd, b)
    assert kept.columns == odd.columns and kept.count() == len(ROWS) - 3
    assert dc.benchmark_spans(none, b).count() == 0 and dc.benchmark_spans(odd, b.limit(0)).where("size(spans) > 0").count() == 0
    assert dc.drop_contaminated(odd, b.limit(0)).count() == len(ROWS)
    # repeated rows stay apart when the items come in blocks
    assert dc.benchmark_spans(odd, b, block_bytes=1).count() == len(ROWS)




def test_equal_items_are_searched_once(spark):
    items = [(f"i{k}", "The answer") for k in range(500)] + [("j", "the, answer!"), ("k", "the answer is"), (None, "the answer")]
    queries = dc.Queries(items, 10)
    assert sorted(map(len, queries.names)) == [1, 502] and len(queries.at) == 2
    d = spark.createDataFrame([(1, "the answer is " * 300), (2, "no answer")], "doc_id int, text string")
    found = {r.id: r for r in dc.benchmark_spans(d, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert len(found[1].spans) == 600 and len(found[1]["items"]) == 503 and not found[2].spans and not found[2]["items"]
    assert brute("the answer is " * 3, [("k", "the answer is")])[1] == 9


def test_long_items_in_linear_time():
    """Each word is compared once, though each of an item's windows holds it."""
    text = " ".join(f"w{k * 7919 % 100_003}" for k in range(60_000))
    queries = dc.Queries([("a", text)], 10)
    compared = []
    equal = queries.equal
    queries.equal = lambda data, starts, ends, which: compared.append(len(starts)) or equal(data, starts, ends, which)
    offsets, hits = dc._matches(pa.record_batch([pa.array([text.upper(), "x"])], ["text"]), queries)
    assert [x.tolist() for x in dc._spans(*hits)] == [[0], [0], [0], [0], [60_000]] and compared == [60_000]


def test_words_of_one_hash_are_two(spark, monkeypatch):
    x, y = colliding()
    d = spark.createDataFrame([(1, f"a {x} b"), (2, f"a {y} b"), (3, x.upper())], "doc_id int, text string")
    b = spark.createDataFrame([("i", f"a {x} b"), ("j", x)], "item_id string, text string")
    assert {r.id: sorted(r["items"]) for r in dc.benchmark_spans(d, b).collect()} == {1: ["i", "j"], 2: [], 3: ["j"]}
    # even if the hashes were equal
    real = dc.words
    monkeypatch.setattr(dc, "words", lambda texts: (np.minimum(real(texts)[0], np.uint64(1)), *real(texts)[1:]))
    queries = dc.Queries([("i", "one one")], 10)
    _, hits = dc._matches(pa.record_batch([pa.array(["one one two", "two two", "one two one one"])], ["text"]), queries)
    assert sorted(zip(hits[0].tolist(), hits[1].tolist())) == [(0, 0), (2, 2)]
