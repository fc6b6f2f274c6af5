import hashlib
import random

import pyarrow as pa
import pytest

from mirrorleaf.llm import fingerprints as fp
from tests.llm.conftest import ROWS


def test_order_does_not_count_but_number_does():
    assert fp.fingerprint("a\nb\na") == fp.fingerprint("a\na\nb")
    assert fp.fingerprint("a\nb") != fp.fingerprint("a\nb\na")
    assert fp.fingerprint(None) == fp.fingerprint("")


def test_paragraphs_are_added_and_removed():
    whole = fp.fingerprint("one. two\nthree\nfour")
    assert fp.change(fp.fingerprint("three"), added=["four", "one. two"]) == whole
    assert fp.change(whole, removed=["four", "one. two"]) == fp.fingerprint("three")
    assert fp.change(whole, added=["x"], removed=["x"]) == whole


def test_likeness_follows_the_shared_part():
    rnd = random.Random(1)
    lines = [f"sentence {rnd.random()}" for _ in range(80)]
    other = [f"sentence {rnd.random()}" for _ in range(80)]
    of = lambda *parts: fp.unpack([fp.fingerprint("\n".join(parts))])
    whole = of(*lines)
    assert fp.likeness(whole, of(*reversed(lines)))[0] == 1
    assert 0.4 < fp.likeness(whole, of(*lines[:40], *other[:40]))[0] < 0.6
    assert fp.likeness(whole, of(*other))[0] < 0.25


def expected(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for k, row in enumerate(rows):
        text, after = row[1] or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        yield (row[0], len(text), hashlib.sha256(edited.encode()).hexdigest(), fp.fingerprint(text), fp.fingerprint(edited))


def test_edits_against_one_pass_over_sorted_rows(odd):
    for buckets in (1, 4, 9):
        found = fp.fingerprints_of_edits(odd, buckets=buckets).collect()
        assert sorted((tuple(r)[:5] for r in found), key=repr) == sorted(expected([r[:2] for r in ROWS]), key=repr)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def _edits(texts):
    """As the operator edits: the second half is the start of the next text."""
    edit = lambda t, n: t[: len(t) - len(t) // 2] + n[: len(t) // 2]
    return [(k, (k + 1) % len(texts), edit(t or "", texts[(k + 1) % len(texts)] or "")) for k, t in enumerate(texts)]


def _same(a, b):
    return all((x == y).all() for x, y in zip(a, b, strict=True))


@pytest.mark.parametrize("held", [fp.SHARED, 100])
def test_vectors_of_edits_are_those_of_the_edited_texts(monkeypatch, held):
    rnd = random.Random(4)
    free = lambda n: "".join(chr(rnd.randrange(32, 0x3000)) for _ in range(n))
    texts = [
        None, "", " \n", "a", "ab" * 5000, "ab" * 4999 + "c", "\n".join(["line"] * 300), "\n".join(map(str, range(900))), free(4000),
        free(90), "x" * 3000 + free(3000), " lead " + free(500) + "\r\n\n", "y" * (fp.READ + 70), free(700) * 9,
    ]
    monkeypatch.setattr(fp, "SHARED", held)
    for _ in range(3):
        rnd.shuffle(texts)
        edits = _edits(texts)
        own, edited = fp.vectors_of_edits(texts, edits)
        assert _same(own, fp.vectors(texts)) and _same(edited, fp.vectors([e[2] for e in edits]))
    assert [len(x) for x in fp.vectors_of_edits(["a"], [])[1]] == [0, 0]


def test_lanes_are_made_once_for_parts_that_texts_share(monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(f"{rnd.random()}"[2:9] for _ in range(300)) for _ in range(20)]
    made, lanes = [], fp._lanes
    monkeypatch.setattr(fp, "_lanes", lambda parts: made.append(len(parts)) or lanes(parts))
    fp.vectors(texts)
    alone, made[:] = sum(made), []
    bucket = pa.record_batch(
        [pa.array([0] * 21), pa.array([False] * 20 + [True]), pa.array([*range(20), 0]), pa.array([*texts, texts[0]])],
        ["bucket", "tail", "id", "text"],
    )
    assert sum(b.num_rows for b in fp._with_likeness(iter([bucket]))) == 20
    assert sum(made) < 1.1 * alone


def test_one_document_is_its_own_next_and_none_gives_none(spark, none):
    one = spark.createDataFrame([(4, "abcdef")], "doc_id bigint, text string")
    row = fp.fingerprints_of_edits(one).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcabc").hexdigest() and row.near_next == 1
    assert fp.fingerprints_of_edits(none).count() == 0


@pytest.mark.parametrize("mark, words", [(" ", "word"), ("! ", "word"), ("。", "字"), ("", "字"), ("", "x")])
def test_half_of_a_text_gives_half_whatever_its_punctuation(mark, words):
    rnd = random.Random(2)
    of = lambda n: mark.join("".join(words + chr(rnd.randrange(0x4E00, 0x9000)) for _ in range(8)) for _ in range(n))
    text, other = of(40), of(40)
    half = len(text) // 2
    like = lambda x: fp.likeness(fp.unpack([fp.fingerprint(text)]), fp.unpack([fp.fingerprint(x)]))[0]
    assert 0.3 < like(text[:-half] + other[:half]) < 0.7
    assert like(other) < 0.25


def test_one_long_line_is_cut_into_stretches():
    rnd = random.Random(3)
    of = lambda: rnd.randbytes(800_000).hex()
    text, other = of(), of()
    a, b, c = (fp.vectors([t]) for t in (text, text[:800_000] + other[:800_000], other))
    assert 0.35 < fp.likeness(a, b)[0] < 0.65 and fp.likeness(a, c)[0] < 0.25


def test_repeats_count_once_each_and_blank_lines_not():
    rnd = random.Random(4)
    line = lambda: " ".join(f"{rnd.getrandbits(24):x}" for _ in range(8))
    like = lambda a, b: fp.likeness(fp.unpack([fp.fingerprint(a)]), fp.unpack([fp.fingerprint(b)]))[0]
    unrelated = ["\n \n\n".join(f"{line()}. {line()}. {line()}" for _ in range(20)) for _ in range(2)]
    assert like(*unrelated) < 0.25
    hot = "one line again and again\n"
    assert 0.8 < like(hot * 40_000, hot * 30_000) < 0.9  # 30,000 of 35,000
    assert like(hot * 40_000, hot * 40_000 + "\n") > 0.99
    apart = ["\n".join(line() for _ in range(100)) for _ in range(2)]
    assert like(*(hot * 100 + x for x in apart)) < 0.4


def test_repeated_paragraphs_are_added_and_removed():
    many = fp.fingerprint("\n".join(["the same line again"] * 5))
    assert fp.change(fp.fingerprint("the same line again"), added=["the same line again"] * 4) == many
    assert fp.change(many, removed=["the same line again"] * 3) == fp.fingerprint("the same line again\nthe same line again")
