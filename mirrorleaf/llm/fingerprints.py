"""Fingerprints of documents as sums of vectors hashed from their paragraphs.

A paragraph (a line) is hashed to a wide vector; a document's fingerprint is the sum
of its paragraphs' vectors, each lane modulo a power of two. So equal multisets of
paragraphs have equal fingerprints whatever their order, and a paragraph is added or
taken away by adding or subtracting its vector. The vector has two parts:

* WIDE lanes of 64 bits, uniform hashes of the paragraph, modulo 2^64;
* SIGNS lanes of 32 bits, modulo 2^32, sums of signed numbers hashed from the paragraph's
  parts. The numbers have the tails of a Cauchy distribution, so the median size of a
  lane grows with the number of parts, repeats counted, and that of the difference of
  two fingerprints with the number of parts that only one of them has.

The parts are overlapping runs of RUN pieces, some 24 bytes. Pieces end where the four
bytes before say so, GRAIN bytes apart on average and LONGEST at most; so any text has
them, whatever its script and punctuation, and an edit changes the parts around it only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorleaf.llm.arrow import mix, slices, span_hashes

WIDE, SIGNS = 8, 256
BYTES = WIDE * 8 + SIGNS * 4
GRAIN, LONGEST, RUN = 8, 32, 3
READ = 1 << 20  # a longer paragraph is cut into pieces in stretches of as many bytes
BLOCK = 1 << 8  # parts whose lanes are held at a time
SHARED = 1 << 24  # characters of texts whose parts are held to be shared; more are hashed anew, in stretches
UNIT = 8  # the least size of a part's lane
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _sums(parts: list[list[bytes]], digest: int, person: bytes) -> Iterator[tuple[slice, np.ndarray]]:
    """Digests of the parts of each text, some texts at a time."""
    at = 0
    while at < len(parts):
        end, n = at, 0
        while end < len(parts) and (end == at or n + len(parts[end]) <= 1 << 14):
            n += len(parts[end])
            end += 1
        data = b"".join(
            hashlib.blake2b(p, digest_size=digest, person=person).digest() for p in chain.from_iterable(parts[at:end])
        )
        yield slice(at, end), np.frombuffer(data, np.uint8).reshape(n, digest)
        at = end


def _pieces(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the pieces of stretches of bytes that end at ``borders``."""
    last = np.zeros(len(data), bool)
    if len(data) > 3:
        four = data[3:].astype(np.uint32)
        for k in (1, 2, 3):
            four |= data[3 - k : -k].astype(np.uint32) << np.uint32(8 * k)
        last[3:] = (four * np.uint32(0x9E3779B1)) >> np.uint32(16) & np.uint32(GRAIN - 1) == 0
    begins = np.concatenate([[0], borders[:-1]])
    for k in range(3):  # the four bytes are of one stretch
        last[np.minimum(begins + k, borders - 1)] = False
    last[borders - 1] = True
    ends = np.flatnonzero(last) + 1
    starts = np.concatenate([[0], ends[:-1]])
    n = -(-(ends - starts) // LONGEST)
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = np.repeat(starts, n) + LONGEST * nth
    return starts, np.minimum(starts + LONGEST, np.repeat(ends, n))


def _parts(lines: list[list[bytes]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(number of the text, 64-bit hash) of each part; lines of white space have none."""

    def hashed(owners: list[int], stretches: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        data = np.frombuffer(b"".join(stretches), np.uint8)
        borders = np.cumsum([len(x) for x in stretches])
        starts, ends = _pieces(data, borders)
        hashes = span_hashes(data, starts, ends)
        after = np.searchsorted(starts, borders)  # of each stretch: the first piece behind it
        own = np.repeat(np.arange(len(after)), np.diff(after, prepend=0))
        first, final = np.concatenate([[0], after[:-1]])[own], after[own] - 1
        here = np.arange(len(hashes))
        total = np.zeros(len(hashes), np.uint64)
        for k in range(RUN):
            at = np.minimum(here + k, final)
            total = np.where(here + k <= final, (total ^ hashes[at]) * _ODD, total)
        kept = (here + RUN - 1 <= final) | (here == first)
        return np.array(owners)[own[kept]], mix(total[kept])

    owners, stretches, size = [], [], 0
    for k, text in enumerate(lines):
        for line in text:
            line = line.strip()
            for at in range(0, len(line), READ):
                if size + min(READ, len(line) - at) > READ:
                    yield hashed(owners, stretches)
                    owners, stretches, size = [], [], 0
                owners.append(k)
                stretches.append(line[at : at + READ])
                size += len(stretches[-1])
    if stretches:
        yield hashed(owners, stretches)


_WORDS = np.arange(1, SIGNS // 2 + 1, dtype=np.uint64) * _ODD


def _lanes(parts: np.ndarray) -> np.ndarray:
    """UNIT / u rounded, for u evenly spread from -1 to 1: a sum of n of them is about n times as large."""
    random = mix(parts[:, None] + _WORDS).astype("<u8", copy=False).view("<i4")
    random >>= 7
    random |= 1
    size = random.astype(np.float32)
    np.divide(np.float32(UNIT << 24), size, out=size)
    return np.rint(size, out=size).astype(np.int32).view(np.uint32)


def _sums_before(parts: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """Sums of the lanes of the parts before each border, modulo 2^32. Borders ascend."""
    out = np.zeros((len(borders), SIGNS), np.uint32)
    total, k, cuts = np.zeros(SIGNS, np.uint32), 0, borders.tolist()
    for at in range(0, len(parts), BLOCK):
        lanes, begin = _lanes(parts[at : at + BLOCK]), 0
        while k < len(cuts) and cuts[k] < at + len(lanes):
            total += np.add.reduce(lanes[begin : cuts[k] - at], axis=0, dtype=np.uint32)
            out[k], begin, k = total, cuts[k] - at, k + 1
        total += np.add.reduce(lanes[begin:], axis=0, dtype=np.uint32)
    out[k:] = total
    return out


def _encoded(texts: list[str | None]) -> list[list[bytes]]:
    return [(t or "").encode("utf-8", "surrogatepass").split(b"\n") for t in texts]


def _wide(lines: list[list[bytes]]) -> np.ndarray:
    wide = np.zeros((len(lines), WIDE), np.uint64)
    for rows, digests in _sums(lines, WIDE * 8, b"paragraph"):
        starts = np.cumsum([0, *(len(x) for x in lines[rows])])[:-1]
        wide[rows] = np.add.reduceat(digests.view("<u8").astype(np.uint64), starts, axis=0)
    return wide


def vectors(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(wide lanes, sign lanes) of each text; null counts as empty."""
    lines = _encoded(texts)
    signs = np.zeros((len(texts), SIGNS), np.uint32)
    for owners, parts in _parts(lines):
        rows, starts = np.unique(owners, return_index=True)
        signs[rows] += np.diff(_sums_before(parts, np.append(starts, len(parts))), axis=0)
    return _wide(lines), signs


def _equal(a: np.ndarray, b: np.ndarray) -> int:
    """How many values at the start of both are equal."""
    n = min(len(a), len(b))
    other = a[:n] != b[:n]
    return int(other.argmax()) if other.any() else n


def _common(parts: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[int, int, int, int]:
    """(p, x, a, n): ``parts`` begins with p parts of ``first`` and has n parts of ``second``, from a on, at x."""
    p = _equal(parts, first)
    middle = (p + len(parts)) // 2
    if middle == len(parts):
        return p, p, 0, 0
    places = np.flatnonzero(second == parts[middle])
    if not len(places):
        return p, p, 0, 0
    place = int(places[np.abs(places - (middle - p)).argmin()])  # the end of one text is the start of another
    before = _equal(parts[p:middle][::-1], second[:place][::-1])
    return p, middle - before, place - before, before + _equal(parts[middle:], second[place:])


def vectors_of_edits(
    texts: list[str | None], edits: list[tuple[int, int, str]]
) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """``vectors`` of texts, and of edited texts (number of the text it begins with, of the one it ends with, text).

    Sums are additive: where an edited text has the parts of the other two, theirs are taken,
    so lanes are made for the parts around the seams only.
    """
    edited = [e[2] for e in edits]
    if sum(len(t or "") for t in chain(texts, edited)) > SHARED:
        return vectors(texts), vectors(edited)
    lines = _encoded([*texts, *edited])
    found = list(_parts(lines))
    owners = np.concatenate([np.zeros(0, np.int64), *(o for o, _ in found)])
    parts = np.concatenate([np.zeros(0, np.uint64), *(p for _, p in found)])
    limits = np.searchsorted(owners, np.arange(len(lines) + 1))
    of = lambda k: parts[limits[k] : limits[k + 1]]
    rest = len(texts) + np.arange(len(edits))
    at = int(limits[len(texts)])
    kept, spans = [parts[:at]], np.zeros((len(edits), 3, 2), np.int64)  # of each edited text: three runs of parts
    for k, (first, second, _) in enumerate(edits):
        own = of(rest[k])
        p, x, a, n = _common(own, of(first), of(second))
        new = np.concatenate([own[p:x], own[x + n :]])
        kept.append(new)
        spans[k] = (limits[first], limits[first] + p), (limits[second] + a, limits[second] + a + n), (at, at + len(new))
        at += len(new)
    borders = np.unique(np.concatenate([limits[: len(texts) + 1], spans.ravel()]))
    sums = _sums_before(np.concatenate(kept), borders)
    before = lambda place: sums[np.searchsorted(borders, place)]
    signs = np.diff(before(limits[: len(texts) + 1]), axis=0)
    runs = (before(spans[:, :, 1]) - before(spans[:, :, 0])).sum(axis=1, dtype=np.uint32)
    wide = _wide(lines)
    return (wide[: len(texts)], signs), (wide[len(texts) :], runs)


def pack(wide: np.ndarray, signs: np.ndarray) -> list[str]:
    rows = np.concatenate([wide.astype("<u8").view(np.uint8), signs.astype("<u4").view(np.uint8)], axis=1)
    return [r.tobytes().hex() for r in rows]


def unpack(fingerprints: list[str]) -> tuple[np.ndarray, np.ndarray]:
    rows = np.frombuffer(bytes.fromhex("".join(fingerprints)), np.uint8).reshape(-1, BYTES)
    cut = WIDE * 8
    return np.ascontiguousarray(rows[:, :cut]).view("<u8").astype(np.uint64), np.ascontiguousarray(rows[:, cut:]).view("<u4").astype(np.uint32)


def fingerprint(text: str | None) -> str:
    return pack(*vectors([text]))[0]


def change(fingerprint_: str, added: list[str] = (), removed: list[str] = ()) -> str:
    """The fingerprint after paragraphs are added and removed."""
    wide, signs = unpack([fingerprint_])
    for paragraphs, sign in ((added, 1), (removed, -1)):
        if paragraphs:
            w, s = vectors(list(paragraphs))
            wide = wide + w.sum(axis=0, dtype=np.uint64) if sign > 0 else wide - w.sum(axis=0, dtype=np.uint64)
            signs = signs + s.sum(axis=0, dtype=np.uint32) if sign > 0 else signs - s.sum(axis=0, dtype=np.uint32)
    return pack(wide, signs)[0]


def _size(signs: np.ndarray) -> np.ndarray:
    return np.median(np.abs(signs.view(np.int32).astype(np.float64)), axis=1)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Estimated share of common parts, from 0 to 1, row by row; 1 for equal fingerprints only.

    Repeats count: n and m times one part have min(n, m) in common, of (n + m) / 2.
    """
    equal = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    both = _size(a[1]) + _size(b[1])
    value = np.clip(1 - _size(a[1] - b[1]) / np.where(both > 0, both, 1), 0, 0.999999)
    return np.where(equal, 1.0, value)


def _with_likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one bucket follow each other, in id order, with the bucket's next row last."""
    kept = None  # (bucket, id, text) that waits for its next row
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "tail", "id", "text")), strict=True))
            rows = ([kept] if kept else []) + rows
            # a tail is there for the row before it only, and so is a further row with the tail's id
            pairs = [(r, n) for r, n in zip(rows, rows[1:]) if not r[1] and n[0] == r[0]]
            kept = rows[-1]
            if not pairs:
                continue
            texts = [r[3] or "" for r, _ in pairs]
            following = [n[3] or "" for _, n in pairs]
            edited = [t[: len(t) - len(t) // 2] + n[: len(t) // 2] for t, n in zip(texts, following, strict=True)]
            number = {t: k for k, t in enumerate(dict.fromkeys(chain(texts, following)))}
            places = [(number[t], number[n]) for t, n in zip(texts, following, strict=True)]
            (wide, signs), edit = vectors_of_edits(list(number), [(*p, e) for p, e in zip(places, edited, strict=True)])
            first, second = np.array(places).T
            own, next_ = (wide[first], signs[first]), (wide[second], signs[second])
            yield pa.record_batch(
                [
                    pa.array([r[2] for r, _ in pairs], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
                    pa.array(pack(*own)),
                    pa.array(pack(*edit)),
                    pa.array(likeness(own, edit)),
                    pa.array(likeness(own, next_)),
                ],
                ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
            )


EDITS = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def in_buckets(docs: DataFrame, buckets: int) -> DataFrame:
    """(bucket, tail, id, text): rows in buckets of consecutive ids, sorted within partitions,
    and at the end of each bucket, as ``tail``, the first row of the next (of the first, after the last).

    The driver holds one number for each bucket. Null ids come first.
    """
    spark = docs.sparkSession
    ids = docs.select("id")
    share = [k / buckets for k in range(1, buckets)]
    borders = sorted(set(ids.approxQuantile("id", share, 0.2 / buckets))) if buckets > 1 else []

    def placed(df: DataFrame) -> DataFrame:
        if not borders:
            return df.withColumn("bucket", F.lit(0))
        splits = [-float("inf"), *borders, float("inf")]
        cut = Bucketizer(splits=splits, inputCol="number", outputCol="place", handleInvalid="keep")
        df = cut.transform(df.withColumn("number", F.col("id").cast("double")))
        bucket = F.when(F.col("id").isNull(), 0).otherwise(F.col("place").cast("int") + 1)
        return df.withColumn("bucket", bucket).drop("number", "place")

    firsts = placed(ids).groupBy("bucket").agg(F.min(F.struct("id")).alias("first")).orderBy("bucket").collect()
    tails = [(f.first.id, firsts[k - 1].bucket) for k, f in enumerate(firsts)]
    tails = spark.createDataFrame(tails, "first bigint, before int")  # a row for each bucket
    rows = placed(docs).join(F.broadcast(tails), F.col("id").eqNullSafe(F.col("first")), "left")
    own = F.struct("bucket", F.lit(False).alias("tail"))
    extra = F.struct(F.col("before").alias("bucket"), F.lit(True).alias("tail"))
    places = F.when(F.col("before").isNull(), F.array(own)).otherwise(F.array(own, extra))
    rows = rows.select(F.explode(places).alias("p"), "id", "text").select("p.bucket", "p.tail", "id", "text")
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "tail", "id", "text")


def fingerprints_of_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose second half is taken from the next document.

    One row for each row of ``docs``, see EDITS. Null and empty texts are one empty
    paragraph. The next document is the next by id, then text; a null id comes first,
    and after the last document comes the first. A single document is its own next. An
    empty table gives no rows. Ids are integers; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text"))
    buckets = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_buckets(rows, buckets).mapInArrow(_with_likeness, EDITS)
