"""SentencePiece encoding by a Viterbi search over many words at once, and decoding.

Texts are cut where no piece can reach over: in front of spaces, after line ends, and
between characters that stand next to each other in no piece. Distinct words of one
length advance together: at each end position, the hashes of the substrings that end
there probe the sorted keys of the pieces, and the maximum over them keeps the score and
the backpointer of every word.

Unigram models score a segmentation by the sum of its pieces' scores. Byte-pair models
have no such sum: their merges, best first, lead to the one segmentation in which every
two neighbours stay apart when they are merged alone. So for them a step is allowed only
from a piece that stays apart from the next, and each prefix has one allowed last piece.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorleaf.llm.arrow import Memory, mix, slices, small_batches, text_bytes
from mirrorleaf.llm.remembered import Remembered

SPACE = "▁"
_BASE = 0x9E3779B97F4A7C15
NORMAL, UNKNOWN, BYTE = 1, 2, 6  # piece types
UNIGRAM, BPE = 1, 2  # model types
SLICE = 2 << 20  # bytes of text encoded at once; a search costs much the same for few words as for many
CELLS = 1 << 21  # words times length in one search
SINGLES = 20_000  # of them that are remembered in a dictionary as well
PAIRS = 500_000  # pairs of pieces that a worker remembers, nine bytes each
UNKNOWN_PENALTY = 10.0


class Pairs(Memory):
    """Answers for pairs of pieces: sorted keys, and a yes or no for each."""

    def __init__(self):
        super().__init__()
        self.forget()

    def forget(self) -> None:
        self.keys, self.answers = np.zeros(0, np.int64), np.zeros(0, bool)
        self.single: dict[int, bool] = {}

    def one(self, pair: int, answer) -> bool:
        """The answer for one pair, as it is asked for along a long word."""
        found = self.single.get(pair)
        if found is None:
            if len(self.single) >= SINGLES:
                self.single.clear()
            found = self.single[pair] = bool(self.look_up(np.array([pair]), answer)[0])
        return found

    def look_up(self, pairs: np.ndarray, answer) -> np.ndarray:
        """The answers for distinct pairs; ``answer`` gives those not known yet."""
        self.touch()
        if len(self.keys) > PAIRS:
            self.forget()
        known = np.zeros(len(pairs), bool)
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, pairs), len(self.keys) - 1)
            known = self.keys[at] == pairs
        new = pairs[~known]
        if len(new):
            at = np.searchsorted(self.keys, new)
            found = np.array([answer(pair) for pair in new.tolist()], bool)
            self.keys, self.answers = np.insert(self.keys, at, new), np.insert(self.answers, at, found)
        return self.answers[np.searchsorted(self.keys, pairs)]


class Model:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        trainer, normalizer = proto.trainer_spec, proto.normalizer_spec
        if trainer.model_type not in (UNIGRAM, BPE) or normalizer.precompiled_charsmap or normalizer.remove_extra_whitespaces:
            raise ValueError("only unigram and BPE models without text normalization are read")
        if any(p.type == 4 for p in proto.pieces) or trainer.treat_whitespace_as_suffix:
            raise ValueError("user-defined pieces and spaces as suffixes are not read")
        self.prefix = normalizer.add_dummy_prefix
        self.bpe = trainer.model_type == BPE
        self.pieces = [p.piece for p in proto.pieces]
        self.types = np.array([p.type for p in proto.pieces])
        self.unknown = int(np.flatnonzero(self.types == UNKNOWN)[0])
        scores = np.array([p.score for p in proto.pieces])
        self.rank = {p.piece: p.score for p in proto.pieces if p.type == NORMAL}
        normal = [k for k in np.flatnonzero(self.types == NORMAL).tolist() if not self.bpe or self._merged(self.pieces[k]) == [self.pieces[k]]]
        self.longest = max(len(self.pieces[k]) for k in normal)
        self.powers = np.cumprod(np.append(np.uint64(1), np.full(self.longest, _BASE, np.uint64)))
        keys = np.array([self._key(self.pieces[k]) for k in normal], np.uint64)
        order = np.argsort(keys)
        self.keys, self.key_ids = keys[order], np.array(normal)[order]
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        # the pieces themselves, as a key alone does not prove that a substring is one
        self.points = np.zeros((len(normal), self.longest), np.uint32)
        for line, k in zip(self.points, self.key_ids.tolist(), strict=True):
            line[: len(self.pieces[k])] = [ord(c) for c in self.pieces[k]]
        self.scores = np.zeros(len(self.pieces)) if self.bpe else scores
        self.unknown_score = 0.0 if self.bpe else float(scores[normal].min()) - UNKNOWN_PENALTY
        self.neighbours = np.array(
            sorted({(ord(a) << 21) | ord(b) for k in normal for a, b in zip(self.pieces[k], self.pieces[k][1:])}), np.int64
        )
        # spaces and line ends are safe borders if no piece holds them after another character
        space_inside = any(SPACE in p.lstrip(SPACE) for p in self.rank)
        line_inside = any("\n" in p for p in self.rank)
        self.cuts = not space_inside and not line_inside
        bytes_ = {int(p[3:5], 16): k for k, p in enumerate(self.pieces) if self.types[k] == BYTE}
        self.byte_ids = np.array([bytes_[b] for b in range(256)]) if len(bytes_) == 256 else None
        self.apart = Pairs()
        self.known = Remembered()
        raw = [p.replace(SPACE, " ").encode() if self.types[k] == NORMAL else b"" for k, p in enumerate(self.pieces)]
        raw[self.unknown] = " ⁇ ".encode()
        for b, k in bytes_.items():
            raw[k] = bytes([b])
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(r) for r in raw], np.int64)
        self.raw_first = np.cumsum(self.raw_size) - self.raw_size

    def _merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short text, best first, leftmost first."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, 0
            for k in range(len(parts) - 1):
                score = self.rank.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _key(self, piece: str) -> np.uint64:
        value = 0
        for c in piece:
            value = (value * _BASE + ord(c)) % (1 << 64)
        return mix(np.array([value + len(piece)], np.uint64))[0]

    def _allowed(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether two pieces stay apart; an unknown character (-1) always does."""
        ok = np.ones(len(left), bool)
        if not self.bpe:
            return ok
        n = len(self.pieces)
        apart = lambda pair: self._merged(self.pieces[pair // n] + self.pieces[pair % n]) == [self.pieces[pair // n], self.pieces[pair % n]]
        if len(left) <= 2:
            self.apart.touch()
            for k, (a, b) in enumerate(zip(left.tolist(), right.tolist(), strict=True)):
                if a >= 0 and b >= 0:
                    ok[k] = self.apart.one(a * n + b, apart)
            return ok
        known = np.flatnonzero((left >= 0) & (right >= 0))
        pairs, which = np.unique(left[known] * n + right[known], return_inverse=True)
        answers = self.apart.look_up(pairs, apart)
        ok[known] = answers[which]
        return ok

    def viterbi(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces, numbers of pieces) of words of one length, a row of code points each.

        An unknown character is -1 less its code point.
        """
        n, length = words.shape
        sums = np.zeros((length + 1, n), np.uint64)
        for k in range(length):
            sums[k + 1] = sums[k] * np.uint64(_BASE) + words[:, k].astype(np.uint64)
        best = np.full((length + 1, n), -np.inf)
        best[0] = 0
        last = np.full((length + 1, n), -1, np.int64)
        back = np.zeros((length + 1, n), np.int64)
        for end in range(1, length + 1):
            for size in range(1, min(end, self.longest) + 1):
                begin = end - size
                key = mix(sums[end] - sums[begin] * self.powers[size] + np.uint64(size))
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                piece = np.full(n, -1, np.int64)
                hit = (self.keys[at] == key).nonzero()[0]
                if len(hit):
                    hit = hit[(self.points[at[hit], :size] == words[hit, begin:end]).all(axis=1)]
                    piece[hit] = self.key_ids[at[hit]]
                elif size > 1:
                    continue
                can = np.flatnonzero((piece >= 0) & (best[begin] > -np.inf) if size > 1 else best[begin] > -np.inf)
                if begin and len(can):
                    can = can[self._allowed(last[begin][can], piece[can])]
                score = best[begin][can] + np.where(piece[can] >= 0, self.scores[piece[can]], self.unknown_score)
                better = score > best[end][can]
                can = can[better]
                best[end][can], last[end][can], back[end][can] = score[better], piece[can], size
        # walk back, all words together
        at = np.full(n, length)
        steps, row = [], np.arange(n)
        while len(row):
            piece = last[at[row], row]
            code = np.where(piece >= 0, piece, -1 - words[row, at[row] - 1].astype(np.int64))
            steps.append((row, code))
            at[row] -= back[at[row], row]
            row = row[at[row] > 0]
        rows = np.concatenate([r for r, _ in steps][::-1])
        codes = np.concatenate([c for _, c in steps][::-1])
        order = np.argsort(rows, kind="stable")
        return codes[order], np.bincount(rows, minlength=n)

    def _encode(self, texts: list[str], _) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct parts of text, in which spaces are written as such."""
        joined = "".join(texts).replace(" ", SPACE)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.int64)
        text_starts = np.cumsum([0, *(len(t) for t in texts)])
        pair = (points[:-1] << 21) | points[1:]
        at = np.minimum(np.searchsorted(self.neighbours, pair), max(len(self.neighbours) - 1, 0))
        cut = np.ones(len(points), bool)
        cut[1:] = self.neighbours[at] != pair if len(self.neighbours) else True
        cut[text_starts[:-1]] = True
        starts = np.flatnonzero(cut)
        sizes = np.diff(np.append(starts, len(points)))
        counts = np.zeros(len(starts), np.int64)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for size in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == size)
            step = max(1, CELLS // (size * 32))
            for k in range(0, len(own), step):
                some = own[k : k + step]
                words = points[starts[some][:, None] + np.arange(size)]
                words, which = np.unique(words, axis=0, return_inverse=True)
                codes, n = self.viterbi(words)
                first = np.cumsum(n) - n
                which = which.ravel()
                counts[some] = n[which]
                take = np.repeat(first[which] - (np.cumsum(n[which]) - n[which]), n[which]) + np.arange(n[which].sum())
                found.append((some, codes[take], n[which]))
        # back to the order of the texts
        begin = np.cumsum(counts) - counts
        codes = np.zeros(int(counts.sum()), np.int64)
        for some, own, n in found:
            codes[np.repeat(begin[some] - (np.cumsum(n) - n), n) + np.arange(len(own))] = own
        ends = np.append(begin, len(codes))
        per_text = np.diff(ends[np.searchsorted(starts, text_starts)])
        return self._with_bytes(codes, per_text)

    def _with_bytes(self, codes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Unknown characters become the ids of their bytes, or the unknown piece."""
        missing = np.flatnonzero(codes < 0)
        if not len(missing):
            return codes, counts
        if self.byte_ids is None:
            return np.where(codes < 0, self.unknown, codes), counts
        made = [self.byte_ids[list(chr(-1 - c).encode())] for c in codes[missing].tolist()]
        size = np.ones(len(codes), np.int64)
        size[missing] = [len(m) for m in made]
        place = np.cumsum(size) - size
        out = np.repeat(codes, size)
        for at, ids in zip(place[missing].tolist(), made, strict=True):
            out[at : at + len(ids)] = ids
        ends = np.append(0, np.cumsum(size))
        return out, np.diff(ends[np.append(0, np.cumsum(counts))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each)."""
        texts = pc.replace_substring(pc.fill_null(texts, ""), SPACE, " ")
        if self.prefix:
            texts = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts, pa.scalar("", texts.type)))
        data, offsets = text_bytes(texts)
        first = np.zeros(len(data), bool)
        first[offsets[:-1][offsets[:-1] < len(data)]] = True
        if self.cuts and len(data):
            space, line = data == 32, data == 10
            first[1:] |= space[1:] & ~space[:-1] | line[1:] | line[:-1]
        starts = np.flatnonzero(first)
        ids, stops = self.known.ids(data, starts, np.append(starts[1:], len(data)) if len(starts) else starts, self._encode)
        return ids, np.diff(stops[np.searchsorted(starts, offsets)])

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of concatenated ids; ids outside the model raise."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.pieces)):
            raise ValueError("an id is not in the model")
        size = self.raw_size[ids]
        stop = np.cumsum(size)
        data = self.raw[np.repeat(self.raw_first[ids] - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0)].tobytes()
        ends = np.append(0, stop)[np.append(0, np.cumsum(counts))].tolist()
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:])]
        return [t[1:] if self.prefix and t.startswith(" ") else t for t in texts]


@lru_cache(1)
def model(path: str) -> Model:
    return Model(path)


def _encoded(path: str, id_col: str, text_col: str, decoded: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, text_col, SLICE):
                ids, counts = model(path).encode(batch.column(text_col))
                borders = pa.array(np.append(0, np.cumsum(counts)), pa.int32())
                columns = {id_col: batch.column(id_col), text_col: batch.column(text_col)}
                columns["ids"] = pa.ListArray.from_arrays(borders, pa.array(ids.astype(np.int32)))
                if decoded:
                    columns["decoded"] = pa.array(model(path).decode(ids, counts), pa.string())
                yield pa.record_batch(list(columns.values()), list(columns))

    return run


def encode_texts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False
) -> DataFrame:
    """(id, text, ids) for each row of ``docs``: the ids that the model gives to the whole text.

    With ``decoded`` also that, the text which the ids stand for, made in the same pass.
    Null and empty texts have no ids. Repeated rows get a row each; an empty table gives
    none; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias(text_col))
    more = [T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decoded]
    return rows.mapInArrow(_encoded(model_path, id_col, text_col, decoded), T.StructType([*rows.schema.fields, *more]))


def _decoded(path: str, ids_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = pc.fill_null(batch.column(ids_col), [])
            counts = pc.list_value_length(arrays).to_numpy(zero_copy_only=False).astype(np.int64)
            texts = model(path).decode(arrays.flatten().to_numpy(zero_copy_only=False).astype(np.int64), counts)
            yield pa.record_batch([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode_ids(rows: DataFrame, model_path: str, ids_col: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the text of the ids (of null: empty); a column of this name is replaced."""
    rows = rows.drop("decoded")
    schema = T.StructType([*rows.schema.fields, T.StructField("decoded", T.StringType())])
    return rows.mapInArrow(_decoded(model_path, ids_col), schema)
