"""The mirror table and trees of Markdown files."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from fnmatch import fnmatchcase
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from mirrorleaf.functions.text import title_of, url_of
from mirrorleaf.session import local_folder, small_batches

SCHEMA = (
    "site string, path string, url string, kind string, post_id bigint, title string, "
    "front_matter string, markdown string, bytes bigint, version_ts timestamp_ntz, version_seq bigint, "
    "is_deleted boolean"
)
COLUMNS = [field.split()[0] for field in SCHEMA.split(", ")]
BUCKETS = 256  # folders of a mirror; part of its layout
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
LOCALITY = "spark.sql.sources.ignoreDataLocality"
WAVES = 8  # tasks for each core that list or read a tree of small files
TREE_FILES = 5_000  # that one task writes
PACKED = "gz bz2 deflate snappy lz4 zst zstd xz lzo passthrough".split()  # endings that Spark's text source unpacks
# Where a stored row lies: its file, and its place in it.
ROW = ("_file", "_row")
NARROW = ("site", "path", "post_id", "version_ts", "version_seq", "is_deleted", *ROW)  # what decides which row counts


def document() -> Column:
    """Text of a mirror row as it is stored and served."""
    return F.concat("front_matter", "markdown")


def site_bucket(site: Column | str = "site") -> Column:
    """The folder of a site: as many as any number of sites need."""
    return F.pmod(F.xxhash64(site), F.lit(BUCKETS)).cast("int")


def with_bytes(rows: DataFrame) -> DataFrame:
    """Mirror rows with the size of their documents, in the order of the stored columns."""
    return rows.withColumn("bytes", F.octet_length(document()).cast("bigint")).select(*COLUMNS)


def write_mirror(rows: DataFrame, path: str) -> None:
    """Append document versions, sorted by site and path in a fixed number of folders.

    Rebalancing by bucket packs small sites into a file and splits a site of any size
    over many tasks; that is work of adaptive execution, which must be on. It needs no
    sampling pass, which would render every document twice.
    """
    if rows.sparkSession.conf.get("spark.sql.adaptive.enabled") != "true":
        raise RuntimeError("set spark.sql.adaptive.enabled: the mirror is dealt out by it")
    (
        with_bytes(rows)
        .withColumn("bucket", site_bucket())
        .hint("rebalance", "bucket")
        .sortWithinPartitions("bucket", "site", "path")
        .write.mode("append")
        .partitionBy("bucket")
        .parquet(path)
    )


def read_versions(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """All versions, or those of one site: its folder, and the row groups that hold it."""
    rows = spark.read.schema(f"{SCHEMA}, bucket int").parquet(path)
    if site is not None:
        own = spark.range(1).select(site_bucket(F.lit(site)).alias("b")).first().b
        rows = rows.where((F.col("bucket") == own) & (F.col("site") == site))
    return rows.select(*COLUMNS)


def current(versions: DataFrame) -> DataFrame:
    """Documents that count now.

    A post counts at the path of its newest version only, so a renamed post
    leaves nothing behind. Then the newest version of each path counts, and
    deleted ones are hidden. Both steps drop older rows before they shuffle.
    """
    newest = [F.desc("version_ts"), F.desc("version_seq"), F.asc("path"), *(F.asc(c) for c in ROW if c in versions.columns)]
    item = F.coalesce(F.concat(F.lit("post "), "post_id"), F.concat(F.lit("path "), "path"))
    by_item = Window.partitionBy("site", "_item").orderBy(*newest)
    by_path = Window.partitionBy("site", "path").orderBy(*newest)
    rank = lambda window: F.row_number().over(window)
    return (
        versions.withColumn("_item", item)
        .withColumn("_newest", rank(by_item))
        .where(F.col("_newest") == 1)
        .withColumn("_newest", rank(by_path))
        .where(F.col("_newest") == 1)
        .where(~F.col("is_deleted"))
        .drop("_item", "_newest")
    )


def _stored(spark: SparkSession, path: str) -> DataFrame:
    """All versions with the place of each row."""
    rows = spark.read.schema(f"{SCHEMA}, bucket int").parquet(path)
    return rows.select(*COLUMNS, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def scan_mirror(spark: SparkSession, path: str) -> DataFrame:
    """Current documents; names that start with '_' are summaries, not documents.

    Versions are ranked on narrow columns. The rows that don't count are the side of an
    anti join, so texts are neither sorted nor ranked; as long as few rows are outdated,
    texts are not shuffled either.
    """
    rows = _stored(spark, path)
    summary = F.regexp_extract("path", r"([^/]*)\z", 1).startswith("_")
    narrow = rows.select(*NARROW)
    counting = current(narrow).where(~summary).select(*ROW)
    outdated = narrow.select(*ROW).join(counting, list(ROW), "left_anti")
    return rows.join(outdated, list(ROW), "left_anti").select(*COLUMNS)


def compact_mirror(spark: SparkSession, path: str, target: str) -> None:
    """Write the current documents to a new table; readers switch folders."""
    write_mirror(scan_mirror(spark, path), target)


def newer_than(versions: DataFrame, since) -> DataFrame:
    """Documents newer than the copy a client already holds.

    Older versions are dropped first, a filter that reaches the scan: what replaces a
    newer version is newer still.
    """
    return current(versions.where(F.col("version_ts") > F.lit(since).cast("timestamp_ntz")))


def changed_since(spark: SparkSession, path: str, since) -> DataFrame:
    """``newer_than`` over a stored mirror, ranked on narrow columns as in ``scan_mirror``."""
    rows = _stored(spark, path).where(F.col("version_ts") > F.lit(since).cast("timestamp_ntz"))
    narrow = rows.select(*NARROW)
    outdated = narrow.select(*ROW).join(newer_than(narrow, since).select(*ROW), list(ROW), "left_anti")
    return rows.join(outdated, list(ROW), "left_anti").select(*COLUMNS)


def may_be_packed(names: str) -> bool:
    """Whether a pattern of file names leaves open, or names, an ending that is unpacked."""
    ending = names.rpartition(".")[2]
    return not re.fullmatch(r"(\w|\[\w+\])+", ending) or any(fnmatchcase(p, ending) for p in PACKED)


def write_tree(documents: DataFrame, root: str, key: str) -> None:
    """One text file for each value of ``key``, in a folder ``key=value`` of its own.

    ``documents`` holds (key, value), the value a line or more of text; the lines of a key
    share its file. Hadoop's local file system starts processes for each file it makes,
    some 28 ms of a task, so in a folder of local or mounted files tasks write them
    themselves, for keys that are whole numbers. A task that is repeated replaces its files.
    """
    spark = documents.sparkSession
    # a file costs its time whatever its size, so tasks are dealt out by number
    tasks = max(spark.sparkContext.defaultParallelism, -(-documents.count() // TREE_FILES))
    dealt = documents.select(key, "value").repartition(tasks, key)
    own = local_folder(spark, root)
    if own is None or not isinstance(dealt.schema[key].dataType, IntegralType):
        dealt.write.partitionBy(key).text(root)
        return
    small_batches(spark)
    run = uuid.uuid4().hex

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((k, v) for b in batches for k, v in zip(*(c.to_pylist() for c in b.columns)))
        files, part = 0, TaskContext.get().partitionId()
        for k, lines in groupby(rows, itemgetter(0)):
            folder = f"{own}/{key}={'__HIVE_DEFAULT_PARTITION__' if k is None else k}"
            os.makedirs(folder, exist_ok=True)
            name = f"part-{part:05d}-{run}.c000.txt"
            made = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
            with open(made, "wb") as file:
                file.writelines((v or b"") + b"\n" for _, v in lines)
            os.replace(made, f"{folder}/{name}")
            files += 1
        yield pa.record_batch([pa.array([files], pa.int64())], ["files"])

    os.makedirs(own, exist_ok=True)
    texts = dealt.select(key, F.col("value").cast("binary")).sortWithinPartitions(key)
    texts.mapInArrow(write, "files bigint").agg(F.sum("files")).first()


def scan_tree(spark: SparkSession, root: str, names: str = "*.[mM][dD]") -> DataFrame:
    """Documents of an existing tree of Markdown files: path, title, url, document.

    Small files are many for their bytes. Spark would list them in up to 10,000 tasks, and
    read a handful of them in each; here a task takes as many as it comes to. They are read
    as bytes, which costs a fifth of what the text source takes to open a file; that one
    reads files whose names may have a codec's ending. Where their blocks lie is not asked.
    """
    tasks = WAVES * spark.sparkContext.defaultParallelism
    before = {key: spark.conf.get(key) for key in (LISTING, LOCALITY)}
    spark.conf.set(LISTING, str(min(tasks, int(before[LISTING]))))
    spark.conf.set(LOCALITY, "true")
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", names)
    try:
        if may_be_packed(names):
            read, document = found.text(root, wholetext=True), F.col("value")
        else:
            read, document = found.format("binaryFile").load(root), F.col("content").cast("string")
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    files = read.select(document.alias("document"), F.col("_metadata.file_path").alias("file")).coalesce(tasks)
    # '+' is a plain character in a file address
    address = F.url_decode(F.replace("file", F.lit("+"), F.lit("%2B")))
    base = root.rstrip("/").removeprefix("file://")
    path = F.ltrim(F.substring_index(address, base + "/", -1), F.lit("/"))
    documents = files.select(
        path.alias("path"), title_of("document").alias("title"), url_of("document").alias("url"), "document"
    )
    return documents.where(~F.regexp_extract("path", r"([^/]*)\z", 1).startswith("_"))
