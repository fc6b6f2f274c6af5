import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
# Columns with names that operators use themselves.
CLASH = "id string, key int, line int, ids string, node int, row int, decoded string, block int, kept int, tail int, words int"
PASSAGE = "a quick passage of more than ten words that both tables hold together today"
ROWS = [
    (1, "Plain words in a line.\n  Shared LINE \nlast one here", "en", "a", 10),
    (2, None, None, None, None),
    (3, "", "en", "", 0),
    (4, "\n\n \t\n", "en", "a", 4),
    (5, "!!! ??? 、", "fr", "b", 3),
    (6, "word", "en", "b", 4),
    (7, "shared line\n" + "long text " * 30_000, "en", "b", 1),
    (8, "one two three four five six seven eight nine ten\nshared line", "en", "c", 9),
    (8, "one two three four five six seven eight nine ten\nshared line", "en", "c", 9),
    (8, "another text of the very same id", "de", "c", 9),
    (9, "éléphant ÀÉÎ ß Ω 日本語 😀   á", "fr", "c", 9),
    (10, f"Before it. {PASSAGE.upper()}, after it\nshared line", "en", "c", 9),
    (None, "a document without an id", "en", "c", 9),
    (None, "a document without an id", None, "c", 9),
    (-5, "x" * 50_000, "xx", "c", 9),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and clashing columns."""
    rows = [(*r, None, 1, 2, "x", 3, 4, "y", 5, 6, 7, 8) for r in ROWS]
    return spark.createDataFrame(rows, f"{SCHEMA}, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


def texts_of(rows=ROWS):
    return [r[1] for r in rows]


def colliding(first="a", second="q", doublings=11):
    """Two texts of 2,048 letters with one hash under every polynomial modulo 2^64 (Thue-Morse)."""
    x, y = first, second
    for _ in range(doublings):
        x, y = x + y, y + x
    return x, y
