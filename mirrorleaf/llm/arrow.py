"""Text columns of Arrow batches: slices of bounded size, bytes, and words as 64-bit hashes.

A worker serves many tasks of many stages, so what it holds is bounded here: batches are
small, memory that the allocators keep is given back, and what an operator remembers is
forgotten when a worker turns to something else.
"""

from __future__ import annotations

import ctypes
import weakref
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

SLICE_BYTES = 4 << 20
BATCH_BYTES = "4m"
RELEASE_BYTES = 32 << 20  # of text, after which free memory goes back to the system
CHUNK = 1 << 18
LONG = 128  # bytes of a span from which its hash is taken by another function
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_MULTIPLIER = 0x9E3779B97F4A7C15

# Words are runs of [0-9a-z] and of bytes above 0x7F, after A-Z became a-z; all else is 0.
FOLD = np.zeros(256, np.uint8)
for _b in range(256):
    if 48 <= _b <= 57 or 97 <= _b <= 122 or _b >= 128:
        FOLD[_b] = _b
    elif 65 <= _b <= 90:
        FOLD[_b] = _b + 32


def small_batches(spark: SparkSession) -> None:
    """Let Arrow batches of this session hold some megabytes of text, unless it has set a limit."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)


class Worker:
    """What a Python worker holds beyond a batch."""

    def __init__(self):
        self.text_bytes = 0  # sliced so far
        self.memories: weakref.WeakSet = weakref.WeakSet()
        try:
            self.trim = ctypes.CDLL(None).malloc_trim
        except (AttributeError, OSError):  # another C library
            self.trim = lambda _: 0

    def sliced(self, n: int) -> None:
        before = self.text_bytes
        self.text_bytes += n
        if before // RELEASE_BYTES != self.text_bytes // RELEASE_BYTES:
            self.release()

    def release(self) -> None:
        """Forget what was not used lately, and give free memory back to the system."""
        for memory in list(self.memories):
            if self.text_bytes - memory.used > RELEASE_BYTES:
                memory.forget()
        pa.default_memory_pool().release_unused()
        self.trim(0)


@lru_cache(1)
def worker() -> Worker:
    """The account of this process (functions of the package travel by value, cached ones don't)."""
    return Worker()


class Memory:
    """What an operator remembers in a worker, until others have worked there for a while."""

    def __init__(self):
        worker().memories.add(self)
        self.touch()

    def touch(self) -> None:
        self.used = worker().text_bytes

    def forget(self) -> None:
        raise NotImplementedError


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    if data is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each, one row at least."""
    if batch.num_rows == 0:
        return
    _, offsets = text_bytes(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        worker().sliced(int(offsets[end] - offsets[at]) + 64 * (end - at))
        at = end


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finalizer of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))  # a new array, changed in place from here on
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_MULTIPLIER, pow(_MULTIPLIER, -1, 1 << 64)):
        steps = np.full(CHUNK, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return out[0], out[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and do not overlap.

    Up to LONG bytes it is a polynomial in an odd number modulo 2^64, taken from running
    sums. Long texts are known that collide under every such polynomial, so longer spans
    are hashed one by one, by XXH3.
    """
    out = np.zeros(len(starts), np.uint64)
    stops = np.minimum(ends, starts + LONG)
    up, down = _powers()
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        stop = max(at + 1, int(np.searchsorted(stops, begin + CHUNK, "right")))
        part = data[begin : stops[stop - 1]]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[: len(part)], out=sums[1:])
        s, e = starts[at:stop] - begin, stops[at:stop] - begin
        out[at:stop] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        at = stop
    for k in np.flatnonzero(stops < ends).tolist():
        out[k] = xxhash.xxh3_64_intdigest(np.ascontiguousarray(data[starts[k] : ends[k]]), seed=1)
    return out


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the runs of true; a run ends where a text ends."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(inside))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash per word, first byte, byte after it, offsets of each text's words)."""
    data, offsets = text_bytes(texts)
    folded = FOLD[data]
    starts, ends = runs(folded != 0, offsets)
    return span_hashes(folded, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words; fewer words, but not none, are one run."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        total = (total ^ hashes[k : len(hashes) - n + 1 + k]) * np.uint64(_MULTIPLIER)
    return mix(total)
