"""Token ids of documents in word-aligned blocks (Simple-8b), and back.

A 64-bit word holds a selector in its top four bits and, below, as many values of
one width as fit. Selector 0 is an escape: the whole next word is one value of up
to 64 bits. Every document starts at a new word, and a block keeps the first word
and the number of ids of each of its documents, so that a document can be read
alone and a whole block is decoded by array operations, one per selector.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorleaf.llm.arrow import runs, slices, small_batches, text_bytes
from mirrorleaf.llm.remembered import Remembered
from mirrorleaf.session import work_folder

# Values per word and bits per value of selectors 1 to 15; selector 0 is the escape.
LAYOUT = ((120, 0), (60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
ESCAPE = 0


def _classes(values: np.ndarray) -> np.ndarray:
    """How many widths of LAYOUT are too narrow for each value."""
    out = np.zeros(len(values), np.uint8)
    if values.dtype != np.uint64 or not len(values) or int(values.max()) < 1 << 32:
        values = values.astype(np.uint32)
    for _, bits in LAYOUT:
        if bits < 8 * values.itemsize:
            out += (values >> values.dtype.type(bits)) != 0
    return out


def _windows(classes: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(size, largest class in the next ``size`` values) for each size of LAYOUT, small sizes first."""
    ahead = lambda x, k: np.append(x[k:], np.zeros(k, np.uint8))
    out, have = [], {1: classes}
    for size in sorted(size for size, _ in LAYOUT):
        if size not in have:
            half = max(h for h in have if h < size)
            rest = max(h for h in have if h <= size - half)
            window = np.maximum(have[half], ahead(have[rest], half))
            if half + rest < size:
                window = np.maximum(window, ahead(have[half], size - half))
            have[size] = window
        out.append((size, have[size]))
        if not (have[size] <= MOST_CLASS[size]).any():
            break  # no longer window can fit a narrower width
    return out


MOST_CLASS = {size: k for k, (size, _) in enumerate(LAYOUT)}


def encode(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each document) for concatenated unsigned values.

    At each value the widest packing is taken that fits, as a document's last word
    may stay partly empty; a value of more than 60 bits is escaped.
    """
    counts = np.asarray(counts, np.int64)
    n, gap = len(values), LAYOUT[0][0]
    ends = np.cumsum(counts)
    begins = ends - counts
    # documents stand apart by as many zeros as a word can hold, so no window reaches the next
    shift = np.arange(len(counts)) * gap
    at = np.arange(n) + np.repeat(shift, counts)
    apart = np.zeros(n + gap * len(counts) + gap, values.dtype)
    apart[at] = values
    classes = _classes(apart)
    selector = np.zeros(len(apart), np.int8)
    step = np.ones(len(apart), np.int64)
    for size, window in _windows(classes):  # a longer window that fits replaces a shorter one
        fits = window <= MOST_CLASS[size]
        selector[fits], step[fits] = MOST_CLASS[size] + 1, size
    follow = (np.arange(len(apart)) + step).tolist()
    chosen = []
    for k, end in zip((begins + shift).tolist(), (ends + shift).tolist(), strict=True):
        while k < end:
            chosen.append(k)
            k = follow[k]
    chosen = np.array(chosen, np.int64)
    kind = selector[chosen]
    escape = kind == ESCAPE
    place = np.cumsum(1 + escape) - 1 - escape
    words = np.zeros(int(len(kind) + escape.sum()), np.uint64)
    for k, (size, bits) in enumerate(LAYOUT, 1):
        own = np.flatnonzero(kind == k)
        word = np.full(len(own), k << 60, np.uint64)
        for i in range(size if bits and len(own) else 0):
            word |= apart[chosen[own] + i].astype(np.uint64) << np.uint64(i * bits)
        words[place[own]] = word
    words[place[escape] + 1] = apart[chosen[escape]]
    firsts = np.append(place, len(words))[np.searchsorted(chosen, begins + shift)]
    return words, firsts


def decode(words: np.ndarray, firsts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The values of all documents of a block, one after the other."""
    total = int(counts.sum())
    out = np.zeros(total, np.uint64)
    if not total:
        return out
    # an escape's second word is no selector: of a run of words that look like escapes, see which are
    kind = (words >> np.uint64(60)).astype(np.int64)
    payload = np.zeros(len(words), bool)
    if (kind == ESCAPE).any():
        for k in np.flatnonzero(kind == ESCAPE).tolist():
            if not payload[k]:
                payload[k + 1] = True
        # a payload that looks like another selector is masked here as well
    heads = np.flatnonzero(~payload)
    kind = kind[heads]
    sizes = np.array([1, *(s for s, _ in LAYOUT)])[kind]
    # values that a document's last word does not hold
    full = np.zeros(len(words) + 1, np.int64)
    full[heads + 1] = sizes
    full = np.cumsum(full)
    begins = np.cumsum(counts) - counts
    used = np.flatnonzero(counts)
    doc = used[np.searchsorted(firsts[used], heads, "right") - 1]
    start = begins[doc] + full[heads] - full[firsts[doc]]
    limit = begins[doc] + counts[doc]
    out_of = lambda where, value, most: out.__setitem__(where[where < most], value[where < most])
    for k, (size, bits) in enumerate(LAYOUT, 1):
        own = np.flatnonzero(kind == k)
        if len(own) and bits:
            shifts = np.arange(size, dtype=np.uint64) * np.uint64(bits)
            value = (words[heads[own]][:, None] >> shifts) & np.uint64((1 << bits) - 1)
            where = start[own][:, None] + np.arange(size)
            out_of(where, value, np.broadcast_to(limit[own][:, None], where.shape))
    own = np.flatnonzero(kind == ESCAPE)
    out[start[own]] = words[heads[own] + 1]
    return out


# Byte classes: white space, letters (all bytes above ASCII at first), punctuation, others.
SPACE, LETTER, MARK, OTHER = range(4)
CLASS = np.full(256, OTHER, np.uint8)
CLASS[list(b" \n")] = SPACE
CLASS[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = LETTER
CLASS[0x80:] = LETTER
CLASS[list(b'.,!?;:%&$#*"()')] = MARK
LATIN = 0xC3  # first byte of the letters from U+00C0 to U+00FF
SIGNS = (0x97, 0xB7)  # second bytes of the two signs among them


def _byte_letters() -> dict[int, str]:
    """What byte-level tokenizers write for U+00C0 to U+00FF: one printable letter per byte."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


def parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, is a word) of parts that the tokenizer encodes independently.

    Texts are cut at spaces and line ends, which its pattern drops and never reaches
    over. A piece of nothing but common punctuation and Latin letters is put in lower
    case, as its normalizer does, and cut at the borders between the two, as its pattern
    does. Any other piece stays as it is.
    """
    kind = CLASS[data]
    starts, ends = runs(kind != SPACE, offsets)
    if not len(starts):
        return data, starts, ends, np.zeros(0, bool)
    second = np.zeros(len(data), bool)  # follows the first byte of a Latin letter
    second[1:] = data[:-1] == LATIN
    second &= (data != SIGNS[0]) & (data != SIGNS[1])
    paired = second.copy()
    paired[:-1] |= second[1:]
    odd = (kind == OTHER) | (data >= 0x80) & ~paired
    plain = ~np.logical_or.reduceat(odd, starts)
    own = lambda at: np.searchsorted(starts, at, "right") - 1
    data = data.copy()
    capital = np.flatnonzero((data >= 65) & (data <= 90) | second & (data < 0x9F))
    data[capital[plain[own(capital)]]] += 32
    border = np.flatnonzero((kind[1:] != kind[:-1]) & (kind[1:] != SPACE) & (kind[:-1] != SPACE)) + 1
    chunk = own(border)
    border = border[plain[chunk] & (starts[chunk] != border)]
    plain = np.flatnonzero(plain)
    starts, old = np.sort(np.concatenate([starts, border])), starts
    inside = np.zeros(len(old), bool)
    inside[plain] = True
    word = inside[np.searchsorted(old, starts, "right") - 1] & (kind[starts] == LETTER)
    return data, starts, np.sort(np.concatenate([ends, border])), word


class Tokenizer:
    """The public tokenizer, with its results for parts of text remembered.

    The library encodes each new part: words go to its model in the form its normalizer hands on, many in one call, where the mark
    for word ends in the vocabulary tells where each word's ids stop.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer as Library
        from tokenizers import pre_tokenizers

        self.library = Library.from_file(path)
        self.model = Library(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.letters = _byte_letters()
        self.known = Remembered()

    def _encode(self, texts: list[str], word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = [t for t, w in zip(texts, word.tolist(), strict=True) if w]
        others = [t for t, w in zip(texts, word.tolist(), strict=True) if not w]
        made = [x.ids for x in self.library.encode_batch_fast(others, add_special_tokens=False)]
        joined = [" ".join(words).translate(self.letters)] if words else []
        ids = np.array([i for x in self.model.encode_batch_fast(joined, add_special_tokens=False) for i in x.ids], np.uint32)
        sizes = np.zeros(len(texts), np.int64)
        sizes[~word] = [len(x) for x in made]
        sizes[word] = np.diff(np.flatnonzero(self.last[ids]) + 1, prepend=0)
        out = np.zeros(int(sizes.sum()), np.uint32)
        of_word = np.repeat(word, sizes)
        out[of_word] = ids
        out[~of_word] = [i for x in made for i in x]
        return out, sizes

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each); ``end_id`` follows each text."""
        data, offsets = text_bytes(texts)
        data, starts, ends, word = parts(data, offsets)
        ids, stops = self.known.ids(data, starts, ends, lambda new, where: self._encode(new, word[where]))
        counts = np.diff(stops[np.searchsorted(starts, offsets)])
        if end_id is None:
            return ids, counts
        out = np.full(len(ids) + len(counts), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
        return out, counts + 1


@lru_cache(1)
def tokenizer(path: str) -> Tokenizer:
    return Tokenizer(path)


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        for whole in batches:
            for batch in slices(whole, "text"):
                values, counts = tokenizer(path).encode(batch.column("text"), end_id)
                words, firsts = encode(values, counts)
                columns = {
                    "shard": pa.array([shard], pa.int32()),
                    "block": pa.array([block], pa.int32()),
                    "first_id": pa.array([first], pa.int64()),
                    "n_ids": pa.array([len(values)], pa.int64()),
                    "doc_ids": pa.array([batch.column("id").to_pylist()], pa.list_(pa.int64())),
                    "doc_counts": pa.array([counts], pa.list_(pa.int64())),
                    "doc_words": pa.array([firsts], pa.list_(pa.int64())),
                    "words": pa.array([words.astype("<u8").tobytes()], pa.binary()),
                }
                yield pa.record_batch(list(columns.values()), list(columns))
                block, first = block + 1, first + len(values)

    return run


BLOCK = "shard int, block int, first_id bigint, n_ids bigint, doc_ids array<bigint>, doc_counts array<bigint>, doc_words array<bigint>, words binary"


def write_token_files(
    docs: DataFrame, tokenizer_path: str, folder: str | None = None, end_id: int = 2,
    id_col: str = "doc_id", text_col: str = "text",
) -> str:
    """Write the ids of all texts, in ascending id order, and return the folder.

    One file for each range of ids; its rows are blocks. ``end_id`` follows each
    document. Null and empty texts have that id alone; a null document id comes first;
    repeated ids are ordered by text; an empty table gives an empty folder of files.
    Ids are integers; other columns of ``docs`` are not read.
    """
    small_batches(docs.sparkSession)
    folder = folder or work_folder(docs.sparkSession, "token-files")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    ordered.mapInArrow(_write(tokenizer_path, end_id), BLOCK).write.parquet(folder)
    return folder


def _read(starts: dict[int, int], with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                counts = np.array(row["doc_counts"], np.int64)
                words = np.frombuffer(row["words"], "<u8").astype(np.uint64)
                values = decode(words, np.array(row["doc_words"], np.int64), counts).astype("<u4")
                ends = np.cumsum(counts)
                data = values.tobytes()
                crc = [zlib.crc32(data[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = {
                    "doc_id": pa.array(row["doc_ids"], pa.int64()),
                    "start": pa.array(starts[row["shard"]] + row["first_id"] + ends - counts, pa.int64()),
                    "n_tokens": pa.array(counts, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                }
                if with_ids:
                    borders = pa.array(np.append(0, ends), pa.int32())
                    columns["ids"] = pa.ListArray.from_arrays(borders, pa.array(values.astype(np.int64)))
                yield pa.record_batch(list(columns.values()), list(columns))

    return run


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids) of each document in the files of ``folder``.

    start counts the ids of all documents before it, ids_crc32 is the checksum of the
    ids as little-endian 32-bit numbers. The driver holds one number for each file.
    """
    blocks = spark.read.schema(BLOCK).parquet(folder)
    sizes = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).orderBy("shard")
    starts, before = {}, 0
    for row in sizes.toLocalIterator():
        starts[row.shard] = before
        before += row.n
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return blocks.mapInArrow(_read(starts, with_ids), schema)
