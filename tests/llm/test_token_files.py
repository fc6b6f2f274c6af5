import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from mirrorleaf.llm import arrow, remembered
from mirrorleaf.llm import token_files as tf
from tests.llm.conftest import ROWS, colliding, texts_of

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(40))
def test_coding_round_trip(seed):
    rng = np.random.default_rng(seed)
    counts = rng.integers(0, 250, rng.integers(0, 8))
    bits = rng.integers(0, 65, counts.sum()) if seed % 2 else np.full(counts.sum(), rng.integers(0, 17))
    values = np.array([int(rng.integers(0, 1 << 63)) * 2 >> (64 - int(b)) if b else 0 for b in bits], np.uint64)
    words, firsts = tf.encode(values, counts)
    assert (tf.decode(words, firsts, counts) == values).all()
    for k, (first, n) in enumerate(zip(firsts, counts)):  # a document alone
        stop = firsts[k + 1] if k + 1 < len(firsts) else len(words)
        begin = counts[:k].sum()
        assert (tf.decode(words[first:stop], np.zeros(1, np.int64), np.array([n])) == values[begin : begin + n]).all()


def test_packing_is_greedy():
    ones = np.ones(130, np.uint32)
    words, _ = tf.encode(ones, np.array([130]))
    assert [int(w) >> 60 for w in words] == [2, 2, 2]  # the last one partly empty
    assert len(tf.encode(np.zeros(240, np.uint32), np.array([240]))[0]) == 2
    words, _ = tf.encode(np.array([1 << 62], np.uint64), np.array([1]))
    assert words.tolist() == [0, 1 << 62]


def test_ids_equal_the_library():
    library, own = Tokenizer.from_file(PATH), tf.Tokenizer(PATH)
    rnd = random.Random(1)
    letters = "aBé É.,'!<|>12 \ńßж—\t×s t"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(25))) for _ in range(1500)]
    texts += [t or "" for t in texts_of()] + ["<|endoftext|>.", "don't, O'Neil's", "ΣΑΣ İx", "a b c", "x̸≠"]
    for _ in range(2):  # the second time from memory
        ids, counts = own.encode(pa.array(texts), 2)
        ends = np.cumsum(counts)
        for text, e, n in zip(texts, ends, counts):
            assert ids[e - n : e].tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]


def test_files_against_the_library(spark, odd, none):
    library = Tokenizer.from_file(PATH)
    folder = tf.write_token_files(odd, PATH)
    rows = tf.read_token_files(spark, folder).orderBy("start").collect()
    before = 0
    ordered = sorted([r[:2] for r in ROWS], key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(rows) == len(ordered)
    for (doc, text), row in zip(ordered, rows):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        assert (row.doc_id, row.start, row.n_tokens, row.ids) == (doc, before, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        before += len(ids)
    assert tf.read_token_files(spark, tf.write_token_files(none, PATH)).count() == 0


def test_texts_of_one_hash_keep_their_own_ids():
    """Both in one batch, and one after the other; long ones collide under polynomials."""
    library, own = Tokenizer.from_file(PATH), tf.Tokenizer(PATH)
    x, y = colliding()
    for texts in ([x, y, f"word {y} {x}"], [y], [x]):
        ids, counts = own.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_memory_tells_equal_hashes_apart(monkeypatch):
    """Even if every part had the same hash."""
    monkeypatch.setattr(remembered, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    library, own = Tokenizer.from_file(PATH), tf.Tokenizer(PATH)
    texts = ["some words of a text", "a text of some words", "words", "Other words, é!", "x" * 300, ""]
    for _ in range(2):
        ids, counts = own.encode(pa.array(texts))
        assert ids.tolist() == [i for t in texts for i in library.encode(t, add_special_tokens=False).ids]


def test_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(remembered, "BYTES", 2_000)
    library, own = Tokenizer.from_file(PATH), tf.Tokenizer(PATH)
    for k in range(30):
        text = " ".join(f"w{k}x{j}" for j in range(40))
        assert own.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.known.nbytes() < 10_000
    arrow.worker().text_bytes += 2 * arrow.RELEASE_BYTES  # others work here
    arrow.worker().release()
    assert len(own.known.hashes) == 0
    assert own.encode(pa.array(["once more"]))[0].tolist() == library.encode("once more", add_special_tokens=False).ids
