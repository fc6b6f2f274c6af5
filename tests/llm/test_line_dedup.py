import random
from collections import Counter

import pytest

from mirrorleaf.llm import line_dedup as ld
from tests.llm.conftest import ROWS, texts_of

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_docs, keep):
    """(id, text, lines, dropped) in plain Python."""
    count = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    drop = {k for k, n in count.items() if n >= min_docs}
    first = {k: min((d is not None, d or 0) for d, t in rows if k in [key(x) for x in (t or "").split("\n")]) for k in drop}
    for d, t in rows:
        kept, met = [], set()
        lines = (t or "").split("\n")
        for x in lines:
            k = key(x)
            if k not in drop:
                kept.append(x)
            elif keep == "first" and first[k] == (d is not None, d or 0) and k not in met:
                met.add(k)
                kept.append(x)
        yield d, None if t is None else "\n".join(kept), len(lines), len(lines) - len(kept)


def result(df):
    return sorted(((r.doc_id, r.text, r[ld.N_LINES], r[ld.N_DROPPED]) for r in df.collect()), key=repr)


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("key_rows", [0, 1000])
def test_against_brute_force(spark, odd, keep, key_rows):
    rnd = random.Random(2)
    line = lambda: rnd.choice(["a", " A", "b\t", "c", "É", "é", "", " \r", f"u{rnd.random()}"])
    rows = [(k // 2, "\n".join(line() for _ in range(rnd.randrange(1, 9)))) for k in range(40)] + [(None, "a\nb"), (77, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    found = ld.drop_repeated_lines(docs, min_docs=10, keep=keep, key_rows=key_rows)
    assert result(found) == sorted(brute(rows, 10, keep), key=repr)
    found = ld.drop_repeated_lines(odd, min_docs=3, keep=keep, key_rows=key_rows)
    assert result(found) == sorted(brute([r[:2] for r in ROWS], 3, keep), key=repr)
    assert found.columns == [*odd.columns, ld.N_LINES, ld.N_DROPPED]


def test_a_full_filter_changes_nothing(spark):
    rows = [(k, f"own {k}\nshared {k % 3}\n" + "\n".join(f"{k} {j}" for j in range(300))) for k in range(12)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert result(ld.drop_repeated_lines(docs, min_docs=4, most_bytes=8)) == sorted(brute(rows, 4, "none"), key=repr)


def test_filter_has_every_repeated_key(spark):
    rows = [(k, f"x{k // 2}\ny{k}") for k in range(200)]
    bits, data = ld.repeated_filter(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7))
    known = ld.Bits(bits, data)
    has = lambda texts: known.has(known.probes([ld._digest(t.encode()) for t in texts]))
    assert has([f"x{k}" for k in range(100)]).all() and has([f"y{k}" for k in range(200)]).mean() < 0.05


def test_size_of_the_filter():
    assert ld.filter_bits(0, 1 << 20) == ld.SEGMENT_BITS
    assert ld.filter_bits(10**15, 64 << 20) == 64 << 23


def test_empty_table(none):
    assert ld.drop_repeated_lines(none).count() == 0 and len(texts_of()) == len(ROWS)
