import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from mirrorleaf.llm import sentencepiece_viterbi as sv
from tests.llm.conftest import ROWS, colliding, texts_of

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def encoded(model, texts):
    ids, counts = model.encode(pa.array(texts, pa.string()))
    ends = np.cumsum(counts)
    return [ids[e - n : e].tolist() for e, n in zip(ends, counts)]


def test_ids_equal_the_library(library):
    rnd = random.Random(3)
    letters = "abcdefghij .,-=*#\n\t  日本éÄ{}()0123456789theTHEing▁😀"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 40))) for _ in range(1500)]
    texts += [t or "" for t in texts_of()] + ["a" * 300, " " * 40, "-" * 99, "end ", " \n \n"]
    assert encoded(sv.Model(PATH), texts) == library.encode(texts)


def test_decode_gives_the_text_back():
    model = sv.Model(PATH)
    texts = [t or "" for t in texts_of()] + [" two  spaces ", "\n", "ẞ\x00\x7f", "😀"]
    assert model.decode(*model.encode(pa.array(texts))) == texts
    with pytest.raises(ValueError):
        model.decode(np.array([10**6]), np.array([1]))


def brute(pieces, unknown, word):
    """The best score of all segmentations, one after the other."""
    if not word:
        return 0.0
    best = unknown + brute(pieces, unknown, word[1:])
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            best = max(best, pieces[word[:n]] + brute(pieces, unknown, word[n:]))
    return best


def test_unigram_scores_are_the_greatest(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    rnd = random.Random(1)
    scores = {"".join(rnd.choice("abc") for _ in range(rnd.randrange(1, 4))): -rnd.random() * 9 for _ in range(25)} | {"▁": -1.0}
    proto = pb.ModelProto()
    proto.pieces.add(piece="<unk>", score=0, type=2)
    for piece, score in scores.items():
        proto.pieces.add(piece=piece, score=score, type=1)
    proto.trainer_spec.model_type = 1
    proto.normalizer_spec.add_dummy_prefix = False
    proto.normalizer_spec.remove_extra_whitespaces = False
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    model = sv.Model(str(path))
    for _ in range(60):
        word = "".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 9)))
        points = np.array([[ord(c) for c in word]])
        codes, (n,) = model.viterbi(points)
        total = sum(scores[model.pieces[c]] if c >= 0 else model.unknown_score for c in codes)
        assert len(codes) == n and "".join(model.pieces[c] if c >= 0 else chr(-1 - c) for c in codes) == word
        assert np.isclose(total, brute(scores, model.unknown_score, word))


def test_odd_rows(odd, none, library):
    rows = sv.decode_ids(sv.encode_texts(odd, PATH), PATH).collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        assert r.ids == library.encode(r.text or "") and r.decoded == (r.text or "")
    assert sorted(sv.encode_texts(odd, PATH, decoded=True).collect(), key=repr) == sorted(rows, key=repr)
    assert sv.decode_ids(sv.encode_texts(none, PATH), PATH).count() == 0


def test_null_ids_decode_to_nothing(spark):
    rows = spark.createDataFrame([(1, None, "x"), (2, [], "y")], "doc_id int, ids array<int>, decoded string")
    assert [r.decoded for r in sv.decode_ids(rows, PATH).collect()] == ["", ""]


def test_texts_of_one_hash_keep_their_own_ids(library):
    model = sv.Model(PATH)
    for texts in (list(colliding()), [colliding()[1], "x " + colliding()[0]], list(colliding("日", "本"))):
        assert encoded(model, texts) == library.encode(texts)
        assert model.decode(*model.encode(pa.array(texts))) == texts


def test_a_key_does_not_prove_a_piece(library, monkeypatch):
    """Substrings are compared with the piece that their hash leads to."""
    model = sv.Model(PATH)
    monkeypatch.setattr(sv, "mix", lambda x: x & np.uint64(0xFFFFF))  # many substrings share a key
    order = np.argsort(keys := np.array([sum(ord(c) * pow(sv._BASE, len(p) - 1 - k, 1 << 64) for k, c in enumerate(p)) + len(p) & 0xFFFFF for p in model.pieces], np.uint64)[model.key_ids])
    first = np.unique(keys[order], return_index=True)[1]
    model.keys, model.key_ids, model.points = keys[order][first], model.key_ids[order][first], model.points[order][first]
    texts = ["the quick brown fox jumps over the lazy dog", "zqxj vkw", "日本語"]
    for text, ids in zip(texts, encoded(model, texts)):
        assert model.decode(np.array(ids), np.array([len(ids)])) == [text]
