import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from mirrorleaf.llm import fill_in_middle as fim
from mirrorleaf.llm.arrow import text_bytes
from tests.llm.conftest import ROWS

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text, fim_percent=50, spm_percent=80, seed=42):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    a, b = sorted(x % (n + 1) for x in h[:2])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim_percent:
        return doc_id, n, "plain", None, None, text
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < spm_percent:
        return doc_id, n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return doc_id, n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = fim.fill_in_middle(docs, **options)
    back = found.select("*", fim.restored().alias("back")).collect()
    assert sorted([tuple(r)[:6] for r in back], key=repr) == sorted([brute(d, t, **options) for d, t in rows], key=repr)
    assert sorted(r.back for r in back) == sorted(t or "" for _, t in rows)
    return back


def test_against_brute_force(spark):
    rnd = random.Random(3)
    letters = [" ", "\n", "\t", "\x0b", "\x0c", "\r", "\x08", "\x0e", "\x1f", "!", "a", "é", " ", "\x85", "日", "😀", "<", "P", ">"]
    rows = [(k, "".join(rnd.choices(letters, k=rnd.choice([1, 2, 7, 8, 9, 40])))) for k in range(-300, 300)]
    rows += [(700, "<P>"), (701, "a <S> b"), (702, "x<M>"), (703, " " * 9), (704, "a" * 17), (None, "two words"), (705, "< P><P >")]
    forms = {r.form for r in check(spark, rows, fim_percent=90, spm_percent=50)}
    assert forms == {"plain", "psm", "spm"}


def test_odd_rows(spark, odd, none):
    check(spark, [r[:2] for r in ROWS], fim_percent=100, spm_percent=50)
    check(spark, [(5, "one long text 日本 " * 200_000), (6, "x" * 2_000_000), (7, " " * 500_000)], fim_percent=100)
    assert fim.fill_in_middle(odd).count() == len(ROWS) and fim.fill_in_middle(none).count() == 0


def test_each_byte_is_classed_as_in_a_plain_loop():
    every = np.array([(b, 0x20, 0x80, 0xFF, b, 0, 0x7F, 0x0D) for b in range(256)], np.uint8)
    marks = fim.space_marks(every.view("<u8").ravel()).view(np.uint8)
    assert ((marks == 0x80) == np.isin(every.ravel(), [0x20, *range(9, 14)])).all() and np.isin(marks, [0, 0x80]).all()
    marks = fim.char_marks(every.view("<u8").ravel()).view(np.uint8)
    assert ((marks == 0x80) == ((every.ravel() & 0xC0) != 0x80)).all()


def test_rank_and_select_are_inverse():
    texts = pa.array(["a b", None, "", " ", "éé é\n", "a" * 30 + " b" * 30])
    data, offsets = text_bytes(texts)
    ends, chars = fim.unit_marks(data, offsets)
    for marks in (ends, chars):
        n = int(marks.before[-1])
        at = marks.select(np.arange(1, n + 1))
        assert (marks.rank(at) == np.arange(n)).all() and (marks.rank(at + 1) == np.arange(1, n + 1)).all()
    assert np.diff(ends.rank(offsets)).tolist() == [2, 0, 0, 1, 3, 31]
    assert np.diff(chars.rank(offsets)).tolist() == [3, 0, 0, 1, 5, 90]
