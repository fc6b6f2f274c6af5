"""Lines that repeat across documents, found with two Bloom filters.

Every task puts the keys of its lines into two filters: keys seen once, and keys
seen again. The filters of all tasks are merged segment by segment (a bit that two
tasks set in their first filter is set in the second), so the second filter holds
every key that two documents share, and few others. Only lines which that filter
suspects are shuffled, as 16-byte digests, to be counted exactly and to choose the
first occurrence. The filters have a fixed greatest size; a corpus too large for
it gets more suspects, never other results.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mirrorleaf.llm.arrow import slices, small_batches
from mirrorleaf.session import persist_table

BLANK = b" \t\n\x0b\x0c\r"
SEGMENT_BITS = 1 << 19
KEY_ROWS = 200_000  # keys to drop that one broadcast may hold


def line_key(line: bytes) -> bytes:
    """The line without white space at its ends, A-Z in lower case."""
    return line.strip(BLANK).lower()


def _digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def _lines(text: bytes | None) -> list[bytes]:
    return (text or b"").split(b"\n")


def _keys(text: bytes | None, min_chars: int) -> dict[bytes, int]:
    """Digest of each distinct key of a text, with the number of its first line."""
    found: dict[bytes, int] = {}
    for number, line in enumerate(_lines(text)):
        key = line_key(line)
        if len(key) >= min_chars and (len(key) >= 4 * min_chars or len(key.decode()) >= min_chars):
            found.setdefault(_digest(key), number)
    return found


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


class Bits:
    """A Bloom filter with two probes for each digest."""

    def __init__(self, bits: int, data: bytes | None = None):
        self.bits = bits
        self.data = np.zeros(bits // 8, np.uint8) if data is None else np.frombuffer(data, np.uint8)

    def probes(self, digests: list[bytes]) -> np.ndarray:
        pairs = np.frombuffer(b"".join(digests), "<u8").reshape(-1, 2)
        return (pairs & np.uint64(self.bits - 1)).astype(np.int64)

    def has(self, at: np.ndarray) -> np.ndarray:
        return ((self.data[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    def add(self, at: np.ndarray) -> None:
        np.bitwise_or.at(self.data, at.ravel() >> 3, np.uint8(1) << (at.ravel() & 7).astype(np.uint8))


def filter_bits(text_bytes: int, most: int) -> int:
    """A power of two with ten bits for every 64 bytes of text, within ``most`` bytes."""
    wanted = max(SEGMENT_BITS, text_bytes // 64 * 10)
    return min(1 << (wanted - 1).bit_length(), 1 << ((most * 8).bit_length() - 1))


def _task_filters(bits: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once, again = Bits(bits), Bits(bits)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            seen: dict[bytes, int] = {}
            for text in _texts(batch.column("text")):
                for key in _keys(text, min_chars):
                    seen[key] = seen.get(key, 0) + 1
            if not seen:
                continue
            at = once.probes(list(seen))
            twice = once.has(at) | (np.fromiter(seen.values(), np.int64) > 1)
            again.add(at[twice])
            once.add(at)
        step = SEGMENT_BITS // 8
        for k in range(0, bits // 8, step):
            if once.data[k : k + step].any():
                parts = [[zlib.compress(x.data[k : k + step].tobytes(), 1)] for x in (once, again)]
                yield pa.record_batch([pa.array([k // step], pa.int32()), *parts], ["segment", "once", "again"])

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the rows of each segment, which arrive one after the other."""
    segment, once, again = None, None, None
    result = lambda: pa.record_batch(
        [pa.array([segment], pa.int32()), [zlib.compress(again.tobytes(), 1)]], ["segment", "again"]
    )
    for batch in batches:
        for row in batch.to_pylist():
            x, y = (np.frombuffer(zlib.decompress(row[c]), np.uint8) for c in ("once", "again"))
            if row["segment"] != segment:
                if segment is not None:
                    yield result()
                segment, once, again = row["segment"], x.copy(), y.copy()
            else:
                again |= y | (once & x)
                once |= x
    if segment is not None:
        yield result()


def repeated_filter(docs: DataFrame, min_chars: int = 1, most_bytes: int = 64 << 20) -> tuple[int, bytes]:
    """(bits, filter) of the keys that more than one row of ``docs`` (text) has."""
    total = docs.select(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = filter_bits(total, most_bytes)
    parts = docs.select("text").mapInArrow(_task_filters(bits, min_chars), "segment int, once binary, again binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(_merged, "segment int, again binary")
    data = bytearray(bits // 8)
    step = SEGMENT_BITS // 8
    for row in merged.toLocalIterator():  # as many bytes as the filter has, at most most_bytes
        data[row.segment * step : (row.segment + 1) * step] = zlib.decompress(row.again)
    return bits, bytes(data)


def _suspects(bits: int, shared, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Bits(bits, shared.value)
        for batch in (part for whole in batches for part in slices(whole, "text")):
            keys, ids, numbers = [], [], []
            for doc, text in zip(batch.column("id").to_pylist(), _texts(batch.column("text")), strict=True):
                found = _keys(text, min_chars)
                keys += found
                numbers += found.values()
                ids += [doc] * len(found)
            if keys:
                hit = pa.array(known.has(known.probes(keys)))
                columns = [pa.array(keys, pa.binary()), pa.array(ids, pa.int64()), pa.array(numbers, pa.int32())]
                yield pa.record_batch([c.filter(hit) for c in columns], ["key", "id", "line"])

    return run


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, most_bytes: int = 64 << 20):
    """(suspects, repeated): suspects has (key, id, line) of the lines that the filter
    lets through, repeated has (key, n_docs, first) of the keys that ``min_docs`` rows
    of ``docs`` (id, text) or more have; first is the least (id, line)."""
    spark = docs.sparkSession
    bits, data = repeated_filter(docs, min_chars, most_bytes)
    shared = spark.sparkContext.broadcast(data)
    suspects = docs.mapInArrow(_suspects(bits, shared, min_chars), "key binary, id bigint, line int")
    found = suspects.groupBy("key").agg(
        F.count("*").alias("n_docs"), F.min(F.struct("id", "line")).alias("first")
    )
    return suspects, found.where(F.col("n_docs") >= min_docs)


def _kept(text: bytes | None, doc: int | None, drop: dict, first: bool) -> tuple[bytes, int, int]:
    lines = _lines(text)
    if not drop:
        return text or b"", len(lines), 0
    kept, met = [], set()
    for line in lines:
        key = _digest(line_key(line))
        if key not in drop:
            kept.append(line)
        elif first and drop[key] == doc and key not in met:
            met.add(key)
            kept.append(line)
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def _rewrite(names: list[str], id_col: str, text_col: str, first: bool, drops):
    """drops: gives for a batch, row by row, the keys to drop and the ids that keep them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, text_col)):
            ids = batch.column(id_col).to_pylist()
            texts = _texts(batch.column(text_col))
            rows = [_kept(t, i, d, first) for t, i, d in zip(texts, ids, drops(batch), strict=True)]
            text = [None if t is None else r[0].decode() for t, r in zip(texts, rows, strict=True)]
            columns = {n: batch.column(n) for n in names}
            columns[text_col] = pa.array(text, pa.large_string() if pa.types.is_large_string(columns[text_col].type) else pa.string())
            columns[N_LINES] = pa.array([r[1] for r in rows], pa.int64())
            columns[N_DROPPED] = pa.array([r[2] for r in rows], pa.int64())
            yield pa.record_batch(list(columns.values()), list(columns))

    return run


N_LINES, N_DROPPED = "dedup_n_lines", "dedup_n_dropped"


def drop_repeated_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_docs: int = 10, min_chars: int = 1,
    keep: str = "none", most_bytes: int = 64 << 20, key_rows: int = KEY_ROWS,
) -> DataFrame:
    """``docs`` without the lines whose key ``min_docs`` rows or more have.

    All columns stay, the text is rewritten, and ``dedup_n_lines`` (before) and
    ``dedup_n_dropped`` are added (columns of these names are replaced). With
    ``keep="first"`` the first occurrence, by id and line, stays.

    A null text counts as one empty line and stays null. Keys below ``min_chars`` code
    points, such as those of empty lines, never repeat. Rows are documents: repeated
    rows count each, and rows that share the least id keep the first occurrence each;
    a null id comes first. An empty table gives an empty table. Ids are integers.
    """
    if keep not in ("none", "first"):
        raise ValueError(keep)
    small_batches(docs.sparkSession)
    spark, first = docs.sparkSession, keep == "first"
    docs = docs.drop(N_LINES, N_DROPPED)
    narrow = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    suspects, found = repeated_lines(narrow, min_docs, min_chars, most_bytes)
    found = persist_table(spark, found, "repeated-lines").select("key", F.col("first.id").alias("first"))
    schema = T.StructType([*docs.schema.fields, T.StructField(N_LINES, T.LongType()), T.StructField(N_DROPPED, T.LongType())])
    if found.count() <= key_rows:
        shared = spark.sparkContext.broadcast({bytes(r.key): r.first for r in found.toLocalIterator()})
        drops = lambda batch: [shared.value] * batch.num_rows
        return docs.mapInArrow(_rewrite(docs.columns, id_col, text_col, first, drops), schema)
    # Too many keys for a broadcast: each document gets its own.
    own = suspects.join(found, "key").groupBy("id").agg(F.collect_set(F.struct("key", "first")).alias("keys"))
    mark = "dedup_keys"
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    joined = docs.select(row, F.col(id_col).cast("bigint").alias("id")).join(
        own.withColumnRenamed("id", "own"), F.col("id").eqNullSafe(F.col("own")), "left"
    )
    joined = joined.select("row.*", F.col("keys").alias(mark))
    drops = lambda batch: [
        {x["key"]: x["first"] for x in keys or ()} for keys in batch.column(mark).to_pylist()
    ]
    return joined.mapInArrow(_rewrite(docs.columns, id_col, text_col, first, drops), schema)
