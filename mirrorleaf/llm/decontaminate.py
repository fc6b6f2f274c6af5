"""Benchmark passages in documents, found through suffix arrays over the documents.

Documents are cut into shards of a few megabytes inside the tasks that read them.
A shard's words are sorted into a suffix array; every suffix of the test items that
is long enough is looked up by binary search. Neighbouring hits join to the longest
verbatim matches. Nothing is shuffled; the test set is broadcast in blocks of
bounded size, each block is searched in a pass of its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorleaf.llm.arrow import FOLD, slices, small_batches, text_bytes, words
from mirrorleaf.llm.remembered import places
from mirrorleaf.llm.suffix_array import SuffixArray

BLOCK_BYTES = 8 << 20  # text of test items in one broadcast; what is made of it takes some eight times as much
SUFFIXES = 1 << 16  # looked up at once
COMPARED = 1 << 18  # bytes compared at once
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPAN = pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("n_words", pa.int64())])
SPANS = "array<struct<item_id:string,doc_word:bigint,item_word:bigint,n_words:bigint>>"


class Queries:
    """The suffixes of test items that hold a window, as rows of word hashes.

    Items of the same words are searched once; ``names`` has a list for each such group.
    """

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        groups: dict[bytes, tuple[str, list]] = {}
        for name, text in items:
            key = hashlib.blake2b(b" ".join(WORD.findall((text or "").encode().lower())), digest_size=16).digest()
            groups.setdefault(key, (text or "", []))[1].append(name)
        self.names = [names for _, names in groups.values()]
        texts = pa.array([t for t, _ in groups.values()], pa.large_string())
        hashes, starts, ends, offsets = words(texts)
        counts = np.diff(offsets)
        # the bytes of each distinct word
        self.known, example, which = np.unique(hashes, return_index=True, return_inverse=True)
        data = FOLD[text_bytes(texts)[0]]
        self.known_size = (ends - starts)[example]
        self.known_at = np.cumsum(self.known_size) - self.known_size
        self.known_bytes = data[places(starts[example], self.known_size)]
        if not self.equal(data, starts, ends, which).all():
            raise ValueError("two words of the test items have one hash")
        lengths = np.minimum(counts, window)
        n = np.where(counts > 0, counts - lengths + 1, 0)  # suffixes of each item
        self.item = np.repeat(np.arange(len(self.names), dtype=np.int32), n)
        begin = np.cumsum(n) - n
        self.word = (np.arange(n.sum()) - begin[self.item]).astype(np.int32)
        self.lengths = lengths[self.item].astype(np.int32)
        self.depth = int(self.lengths.max(initial=1))
        self.at = (offsets[:-1][self.item] + self.word).astype(np.int32)
        self.hashes = hashes

    def slices(self) -> Iterator[tuple[slice, np.ndarray]]:
        """The suffixes, some at a time, as rows of word hashes."""
        for k in range(0, len(self.at), SUFFIXES):
            part = slice(k, k + SUFFIXES)
            take = self.at[part, None] + np.arange(self.depth)
            yield part, self.hashes[np.minimum(take, len(self.hashes) - 1)]

    def equal(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether words have the very bytes of the known words that their hashes lead to."""
        size = ends - starts
        same = self.known_size[which] == size
        some = np.flatnonzero(same)
        stop = np.cumsum(size[some])
        k = 0
        while k < len(some):
            end = max(k + 1, int(np.searchsorted(stop, stop[k] - size[some[k]] + COMPARED, "right")))
            own = some[k:end]
            match = data[places(starts[own], size[own])] == self.known_bytes[places(self.known_at[which[own]], size[own])]
            same[own] = np.logical_and.reduceat(match, np.cumsum(size[own]) - size[own])
            k = end
        return same


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks whose texts have about ``block_bytes``; the driver holds one block."""
    block, size = [], 0
    items = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t"))
    for row in items.where("t IS NOT NULL").toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t)
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def _matches(batch: pa.RecordBatch, queries: Queries) -> tuple[np.ndarray, list[np.ndarray]]:
    """(words of each row, [row, word, item, item word, window] of each verified hit)."""
    texts = batch.column("text")
    hashes, starts, ends, offsets = words(texts)
    empty = [np.zeros(0, np.int64)] * 5
    if not len(hashes) or not len(queries.item):
        return offsets, empty
    shard = SuffixArray(hashes, offsets, queries.depth)
    found = [shard.find(shard.ranks(rows.ravel()).reshape(rows.shape), queries.lengths[part]) for part, rows in queries.slices()]
    low, high = (np.concatenate(side) for side in zip(*found, strict=True))
    hit = np.flatnonzero(low < high)
    n = (high - low)[hit]
    if not len(hit):
        return offsets, empty
    query = np.repeat(hit, n)
    place = np.repeat(low[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    where = shard.order[place]
    row = np.searchsorted(offsets, where, "right") - 1
    # 64-bit hashes led here; the words themselves decide, each once
    length = queries.lengths[query]
    edge = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(edge, where, 1)
    np.add.at(edge, where + length, -1)
    inside = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
    which = np.searchsorted(queries.known, hashes[inside])
    other = np.zeros(len(hashes) + 1, np.int64)
    other[inside + 1] = ~queries.equal(FOLD[text_bytes(texts)[0]], starts[inside], ends[inside], which)
    other = np.cumsum(other)
    good = other[where + length] == other[where]
    query, where, row = query[good], where[good], row[good]
    return offsets, [row, where - offsets[row], queries.item[query], queries.word[query], queries.lengths[query]]


def _spans(row, word, item, item_word, window) -> list[np.ndarray]:
    """Join hits that follow each other to longest matches: [row, item, word, item word, words]."""
    order = np.lexsort((word, word - item_word, item, row))
    row, word, item, item_word, window = (x[order] for x in (row, word, item, item_word, window))
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (np.diff(word - item_word) != 0) | (np.diff(word) != 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(row)) - 1
    return [row[first], item[first], word[first], item_word[first], word[last] - word[first] + window[last]] if len(row) else [row] * 5


def _search(shared, block: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for whole in batches:
            for batch in slices(whole, "text"):
                offsets, hits = _matches(batch, queries)
                spans: list[list] = [[] for _ in range(batch.num_rows)]
                items: list[dict] = [{} for _ in range(batch.num_rows)]
                for r, i, w, iw, n in zip(*(x.tolist() for x in _spans(*hits)), strict=True):
                    spans[r].append({"item_id": queries.names[i][0], "doc_word": w, "item_word": iw, "n_words": n})
                    items[r][i] = True
                names = [[name for i in found for name in queries.names[i]] for found in items]
                yield pa.record_batch(
                    [batch.column("id"), pa.array(np.diff(offsets), pa.int64()), pa.array(spans, pa.list_(SPAN)),
                     pa.array(names, pa.list_(pa.string())), _tag(batch, block)],
                    ["id", "n_words", "spans", "items", "tag"],
                )

    def _tag(batch, block):
        if block < 0:
            return pa.nulls(batch.num_rows, pa.binary())
        texts = batch.column("text").to_pylist()
        return pa.array([hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts], pa.binary())

    return run


def benchmark_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row (id, n_words, spans, items) for each row of ``docs``.

    ``spans`` lists the longest verbatim matches with test items, as (item_id, doc_word,
    item_word, n_words): runs of at least ``window`` words, or of the whole item where
    it has fewer. Of items with the same words one stands in the spans; ``items`` lists
    the ids of all items with a span. Null and empty texts have no words and no spans, and so do items
    without words; repeated rows get a row each; an item without an id has spans whose
    item_id is null. Without documents or items there are no rows or no spans.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    # the shard's rows need one id type and one text type only
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = f"id {dict(rows.dtypes)['id']}, n_words bigint, spans {SPANS}, items array<string>, tag binary"
    blocks = _blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    found = [rows.mapInArrow(_search(spark.sparkContext.broadcast(Queries(first, window)), -1 if second is None else 0), schema)]
    if second is None:
        return found[0].drop("tag")
    while second is not None:
        found.append(rows.mapInArrow(_search(spark.sparkContext.broadcast(Queries(second, window)), len(found)), schema))
        second = next(blocks, None)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # equal rows meet: each block gave as many of them, and equal spans
    merged = every.groupBy("id", "tag", "n_words").agg(
        F.array_distinct(F.flatten(F.collect_set("spans"))).alias("spans"),
        F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"), F.count("*").alias("copies"),
    )
    copies = F.sequence(F.lit(1), (F.col("copies") / len(found)).cast("int"))
    return merged.withColumn("copies", F.explode(copies)).drop("copies", "tag")


def hit_words(spans: str = "spans"):
    """How many words of a document lie in any of its spans."""
    ordered = F.array_sort(
        F.transform(F.col(spans), lambda s: F.struct(s.doc_word.alias("a"), (s.doc_word + s.n_words).alias("b")))
    )
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("end"))
    step = lambda acc, s: F.struct(
        (acc.n + F.greatest(F.lit(0), s.b - F.greatest(acc.end, s.a))).cast("bigint").alias("n"),
        F.greatest(acc.end, s.b).alias("end"),
    )
    return F.aggregate(ordered, zero, step, lambda acc: acc.n)


def _clean(names: list[str], text_col: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = shared.value
        for whole in batches:
            for batch in slices(whole, text_col):
                _, hits = _matches(pa.record_batch([batch.column(text_col)], ["text"]), queries)
                keep = np.ones(batch.num_rows, bool)
                keep[hits[0]] = False
                yield batch.select(names).filter(pa.array(keep))

    return run


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", window: int = 10, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text has no span (see benchmark_spans)."""
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        shared = spark.sparkContext.broadcast(Queries(block, window))
        docs = docs.mapInArrow(_clean(docs.columns, text_col, shared), docs.schema)
    return docs
