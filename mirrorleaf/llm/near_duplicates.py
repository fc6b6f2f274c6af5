"""Documents whose word shingles are alike: MinHash bands of an LSH forest, then exact verification.

1. Each text gets its shingle set, the key of that set, and a MinHash signature: one
   path of ``levels`` values for each tree of the forest. Texts with equal sets are one
   class; classes are counted before anything else, so copies cost one row.
2. Two classes are candidates if they share a prefix in some tree. The length of the
   prefixes is fixed before data is read: the longest with which pairs at the threshold
   meet in some tree with the target recall. So levels behind it are not made, and a tree
   is a band of hashes; no trie is sorted and no prefix is shortened on the data.
3. Rows with one prefix are linked to the least of them only, so no group is expanded
   into pairs. Components of these links are the sets that are verified.
4. In each component, shingle sets are compared exactly: blocks of bounded size against
   blocks, by counting common shingles with matrix products. Links are counted and
   reduced to a few edges per row inside the task. Components of the verified edges are
   the classes of near duplicates.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorleaf.llm.arrow import mix, shingles, slices, small_batches, words
from mirrorleaf.llm.components import components
from mirrorleaf.session import persist_table

SHINGLE = 5
THRESHOLD = 0.8
TREES = 20
LEVELS = 8
RECALL = 0.9995
BLOCK_SHINGLES = 250_000  # of the rows of one block, on average
BLOCK_ROWS = 500
_COLUMNS = 2_048  # shingles in one matrix


def prefix_length(threshold: float, trees: int, levels: int, recall: float) -> int:
    """The longest prefix with which pairs at ``threshold`` meet in some tree with probability ``recall``."""
    length = levels
    while length > 1 and 1 - (1 - threshold**length) ** trees < recall:
        length -= 1
    return length


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    seed = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seed[:n] | np.uint64(1), seed[n:]


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """n MinHash values of each set; sets are not empty."""
    scale, shift = _functions(n)
    out = np.empty((len(sets), n), np.uint64)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        values = np.concatenate(sets[at:end])
        starts = np.cumsum([0, *(len(s) for s in sets[at:end])])[:-1]
        for k in range(n):
            hashed = values * scale[k]
            hashed += shift[k]
            hashed >>= np.uint64(32)
            out[at:end, k] = np.minimum.reduceat(hashed, starts)
        at = end
    return out


def text_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    hashes, _, _, offsets = words(texts)
    return [np.unique(shingles(hashes[a:b], n)) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _set_keys(sets: list[np.ndarray], texts: list[str | None]) -> list[bytes]:
    """16 bytes for each set; a text without words has the key of the text itself."""
    digest = lambda data, person: hashlib.blake2b(data, digest_size=16, person=person).digest()
    return [
        digest(s.tobytes(), b"set") if len(s) else digest((t or "").encode("utf-8", "surrogatepass"), b"text")
        for s, t in zip(sets, texts, strict=True)
    ]


def _described(length: int, trees: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = text_sets(batch.column("text"))
                filled = [k for k, s in enumerate(sets) if len(s)]
                prefixes = [[] for _ in sets]
                if filled:
                    # one number stands for a tree's prefix
                    paths = signatures([sets[k] for k in filled], trees * length).reshape(-1, trees, length)
                    key = np.broadcast_to(np.arange(trees, dtype=np.uint64), paths.shape[:2])
                    for level in range(length):
                        key = mix((key ^ paths[:, :, level]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
                    for k, row in zip(filled, key.astype(np.int64), strict=True):
                        prefixes[k] = row
                texts = batch.column("text").to_pylist()
                yield pa.record_batch(
                    [
                        batch.column("id"),
                        pa.array([hashlib.md5((t or "").encode("utf-8", "surrogatepass")).digest() for t in texts], pa.binary()),
                        pa.array(_set_keys(sets, texts), pa.binary()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(prefixes, pa.list_(pa.int64())),
                    ],
                    ["id", "text_key", "set_key", "n_shingles", "prefixes"],
                )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of the rows whose text has the set of their class, once per task for each class."""
    met = set()
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = text_sets(batch.column("text"))
            keys = _set_keys(sets, batch.column("text").to_pylist())
            own = []
            for k, (node, key, wanted) in enumerate(zip(batch.column("node").to_pylist(), keys, batch.column("set_key").to_pylist(), strict=True)):
                if key == wanted and node not in met:
                    met.add(node)
                    own.append(k)
            columns = {c: batch.column(c).take(pa.array(own, pa.int64())) for c in PLACE}
            columns["shingles"] = pa.array([sets[k].astype(np.int64) for k in own], pa.list_(pa.int64()))
            yield pa.record_batch(list(columns.values()), list(columns))


PLACE = ("component", "blocks", "block", "node", "copies")


def common_shingles(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many shingles each set of ``left`` shares with each of ``right``."""
    row_of = lambda sets: np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate([*left, *right])
    row = np.concatenate([row_of(left), row_of(right) + len(left)])
    order = np.argsort(every, kind="stable")
    every, row = every[order], row[order]
    group = np.cumsum(np.diff(every, prepend=every[:1]) != 0) if len(every) else every
    inside = row < len(left)
    n = int(group[-1]) + 1 if len(group) else 0
    both = (np.bincount(group[inside], minlength=n) > 0) & (np.bincount(group[~inside], minlength=n) > 0)
    column = np.cumsum(both) - 1
    keep = both[group]
    row, column = row[keep], column[group[keep]]
    total = np.zeros((len(left), len(right)), np.float32)
    for begin in range(0, int(both.sum()), _COLUMNS):
        a, b = np.searchsorted(column, [begin, begin + _COLUMNS])
        block = np.zeros((len(left) + len(right), _COLUMNS), np.float32)
        block[row[a:b], column[a:b] - begin] = 1
        total += block[: len(left)] @ block[len(left) :].T
    return total


def _linked(nodes: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The least node that each node is linked to, directly or not; links is symmetric."""
    label = nodes
    top = np.iinfo(np.int64).max
    while True:
        near = np.where(links, label[None, :], top).min(axis=1, initial=top)
        new = np.minimum(label, near)
        if (new == label).all():
            return label
        label = new


def _verified(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        # a task that ran over part of a repeated id may have sent a class once more
        table = table.combine_chunks().take(np.unique(table.column("node").to_numpy(), return_index=True)[1])
        block = table.column("block").to_numpy()
        nodes = table.column("node").to_numpy()
        copies = table.column("copies").to_numpy()
        flat = table.column("shingles").combine_chunks()
        values = flat.values.to_numpy(zero_copy_only=False)
        at = flat.offsets.to_numpy(zero_copy_only=False)
        sets = [values[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(left) or not len(right):
            return pa.table({"node": pa.array([], pa.int64()), "links": pa.array([], pa.int64()), "least": pa.array([], pa.int64())})
        common = common_shingles([sets[k] for k in left], [sets[k] for k in right]).astype(np.float64)
        size = np.array([len(s) for s in sets], np.float64)
        union = size[left][:, None] + size[right][None, :] - common
        links = common / union >= threshold
        if i == j:
            np.fill_diagonal(links, False)
            least = _linked(nodes[left], links)
            return pa.table({"node": nodes[left], "links": links @ copies[right], "least": least})
        # one square of both blocks would hold zeros on its diagonal; two steps go to and fro instead
        top = np.iinfo(np.int64).max
        a, b = nodes[left], nodes[right]
        while True:
            to_b = np.minimum(b, np.where(links, a[:, None], top).min(axis=0, initial=top))
            to_a = np.minimum(a, np.where(links, to_b[None, :], top).min(axis=1, initial=top))
            if (to_a == a).all() and (to_b == b).all():
                break
            a, b = to_a, to_b
        return pa.table({
            "node": np.concatenate([nodes[left], nodes[right]]),
            "links": np.concatenate([links @ copies[right], copies[left] @ links]),
            "least": np.concatenate([a, b]),
        })

    return run


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD,
    trees: int = TREES, levels: int = LEVELS, recall: float = RECALL,
    block_shingles: int = BLOCK_SHINGLES, block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, text_key, class_number, class_id, n_links) for each row of ``docs``.

    Rows are linked if their sets of five-word shingles have a Jaccard similarity of
    ``threshold`` or more. Rows that are linked, directly or over others, have one
    class_number; class_id is the least id among them, and n_links the number of other
    rows that a row is linked to directly. text_key is the MD5 of the text.

    Words are runs of letters and digits, A-Z in lower case; fewer than five words, but
    not none, are one shingle. Texts without words are linked if they are equal; null
    counts as empty. Repeated rows count each. A null id counts as NULL_ID. An empty
    table gives no rows. Ids are integers; other columns are not read.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    id_ = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID))
    rows = docs.select(id_.alias("id"), F.col(text_col).cast("string").alias("text"))
    length = prefix_length(threshold, trees, levels, recall)
    schema = "id bigint, text_key binary, set_key binary, n_shingles bigint, prefixes array<bigint>"
    described = persist_table(spark, rows.mapInArrow(_described(length, trees), schema), "described")
    classes = described.groupBy("set_key").agg(
        F.min("id").alias("id"), F.count("*").alias("copies"),
        F.first("n_shingles").alias("n_shingles"), F.first("prefixes").alias("prefixes"),
    )
    # written with its numbers, so they don't change
    classes = persist_table(spark, classes.withColumn("node", F.monotonically_increasing_id()), "classes")

    paths = classes.select("node", F.explode("prefixes").alias("prefix"))
    hubs = paths.groupBy("prefix").agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last")
    candidates = components(paths.join(hubs, "prefix").select(F.col("node").alias("a"), F.col("hub").alias("b")))

    members = persist_table(spark, classes.drop("prefixes").join(candidates, "node"), "members")
    sizes = members.groupBy("component").agg(
        F.greatest(F.ceil(F.sum("n_shingles") / block_shingles), F.ceil(F.count("*") / block_rows)).cast("int").alias("blocks")
    )
    block = F.pmod(F.xxhash64("set_key"), F.col("blocks")).cast("int").alias("block")
    placed = members.join(sizes, "component").select("id", "set_key", *(c for c in PLACE if c != "block"), block)
    types = "component bigint, blocks int, block int, node bigint, copies bigint, shingles array<bigint>"
    # as a merge join at every size: how many rows are candidates is not known beforehand
    sets = rows.join(placed.hint("merge"), "id").mapInArrow(_sets, types)
    # each block of a component meets each other block, and itself, in one task
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    squares = sets.select("component", "block", "node", "copies", "shingles", other)
    squares = squares.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")})
    squares = squares.drop("other").groupBy("component", "i", "j")
    verified = persist_table(
        spark, squares.applyInArrow(_verified(threshold), "node bigint, links bigint, least bigint"), "verified"
    )

    linked = components(verified.select(F.col("node").alias("a"), F.col("least").alias("b")))
    links = verified.groupBy("node").agg(F.sum("links").alias("links"))
    grouped = classes.select("set_key", "id", "copies", "node").join(linked, "node", "left").join(links, "node", "left")
    grouped = grouped.select(
        "set_key", "id", F.coalesce("component", "node").alias("class_number"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    least = grouped.groupBy("class_number").agg(F.min("id").alias("class_id"))
    named = grouped.drop("id").join(least, "class_number")
    return described.select("id", "text_key", "set_key").join(named, "set_key").select(
        "id", "text_key", "class_number", "class_id", "n_links"
    )


NULL_ID = -1 - (1 << 62)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each class of near duplicates, with all its columns: the one with the least id.

    Of a class's rows that share that id, the one with the least MD5 of its text stays;
    of rows that are equal in both, any one. See near_duplicates for null and empty texts.
    """
    marked = near_duplicates(docs, id_col, text_col, **options)
    best = marked.groupBy("class_number").agg(F.min(F.struct("id", "text_key")).alias("kept"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    id_ = F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(NULL_ID)).alias("id")
    text_key = F.unhex(F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))).alias("text_key")
    rows = docs.select(id_, text_key, row)
    return rows.join(best.select("kept.id", "kept.text_key"), ["id", "text_key"], "left_semi").dropDuplicates(["id", "text_key"]).select("row.*")
