"""The order of all documents, kept up to date range by range.

Documents stand in ranges of bounded size over (site, path), each with its counts and
bytes per site. A change rewrites the ranges that it falls into; the numbers of all later
documents follow from the totals alone. Index lines and export shards are read from it as
from a rebuilt one. Ranges written together lie in one folder, sorted, small ones several
to a file, so the number of files follows from bytes and not from how small ranges are.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mirrorleaf.operators.ordered import running_total
from mirrorleaf.session import remove_folder, store_table
from mirrorleaf.sources.store import read_versions, scan_mirror

RANGE_ROWS = 100_000
FEW = 100  # ranges that a scan is told by name
ENTRY = ("site", "path", "title", "url", "bytes")
ENTRIES = "site string, path string, title string, url string, bytes bigint, range string, version bigint"
TOTALS = "site string, n bigint, total bigint, range string, version bigint"
# Which ranges there are: where each begins, and the version of its folders that counts.
MANIFEST = "first struct<site:string,path:string>, range string, version bigint, number bigint"


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of the newest manifest, one for each range."""
    every = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    return every.where(F.col("number") == _last_number(spark, folder))


def _last_number(spark: SparkSession, folder: str) -> int:
    """The newest manifest, by the names of the folders: one without documents has no rows."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/manifest")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = [status.getPath().getName() for status in found]
    return max(int(n.split("=")[1]) for n in names if n.startswith("number="))


def _write(rows: DataFrame, kept: DataFrame | None, folder: str, version: int) -> None:
    """Store the ranges of ``rows`` (ENTRY, range) as ``version``, then a manifest of them and ``kept``.

    The manifest comes last: a write that breaks off leaves the old one in force.
    """
    spark = rows.sparkSession
    parted = rows.withColumn("version", F.lit(version).cast("bigint"))
    by, entries = ["range", "version"], f"{folder}/entries"
    # adaptive execution packs small ranges
    parted.repartition("range").sortWithinPartitions("range", "site", "path").write.mode("append").partitionBy("version").parquet(entries)
    stored = spark.read.schema(ENTRIES).parquet(entries).where(F.col("version") == version)
    totals = stored.groupBy("range", "version", "site").agg(F.count("*").alias("n"), F.sum("bytes").alias("total"))
    totals.write.mode("append").partitionBy("version").parquet(f"{folder}/totals")
    made = stored.groupBy(*by).agg(F.min(F.struct("site", "path")).alias("first")).select("first", "range", "version")
    # a table of a row for each range
    made = made if kept is None else made.unionByName(kept)
    made.coalesce(1).write.mode("overwrite").parquet(f"{folder}/manifest/number={version}")


def build_index(mirror: DataFrame, folder: str, range_rows: int = RANGE_ROWS) -> None:
    """Store the documents of ``mirror`` in ranges of ``range_rows``; the last may have fewer."""
    spark = mirror.sparkSession
    keyed = mirror.select(*ENTRY).withColumns({"_all": F.lit(0), "_order": F.struct("site", "path")})
    place = running_total(keyed, "_all", "_order", F.lit(1), "_place").drop("_all", "_order")
    named = F.floor((F.col("_place") - 1) / range_rows).cast("string")
    # stored, as an order of equal places is not the same twice
    ranged, dealt = store_table(spark, place.withColumn("range", named).drop("_place"), "ranges")
    _write(ranged, None, folder, 0)
    remove_folder(spark, dealt)


def _in_ranges(borders: list[tuple], names: list[str]):
    """Adds to each row the range whose first key is the last that is not above the row's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = zip(batch.column("site").to_pylist(), batch.column("path").to_pylist(), strict=True)
            found = [names[max(0, bisect.bisect_right(borders, key) - 1)] for key in keys]
            yield pa.record_batch([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "range"])

    return run


def update_index(spark: SparkSession, folder: str, changes: DataFrame, range_rows: int = RANGE_ROWS) -> int:
    """Apply ``changes`` (site, path, title, url, bytes, is_deleted), one row for a place; gives how many ranges were rewritten.

    A range that has grown to more than twice ``range_rows`` is split, one that has lost
    all its documents is dropped. The driver holds the first key of each range.
    """
    manifest = _manifest(spark, folder)
    ranges = sorted(((r.first.site, r.first.path), r.range) for r in manifest.select("first", "range").toLocalIterator())
    columns = changes.select(*ENTRY, "is_deleted")
    version = _last_number(spark, folder) + 1
    dealt = _in_ranges([key for key, _ in ranges], [name for _, name in ranges] or [f"0.{version}"])
    schema = "site string, path string, title string, url string, bytes bigint, is_deleted boolean, range string"
    placed, changed = store_table(spark, columns.mapInArrow(dealt, schema), "changes")
    touched = placed.select("range").distinct()
    old = _entries(spark, folder, manifest.join(touched, "range", "left_semi"), [r.range for r in touched.limit(FEW + 1).collect()])
    rest = old.join(placed.select("site", "path"), ["site", "path"], "left_anti").select(*ENTRY, "range")
    merged = rest.unionByName(placed.where(~F.col("is_deleted")).drop("is_deleted"))
    in_range = Window.partitionBy("range")
    part = F.floor((F.row_number().over(in_range.orderBy("site", "path")) - 1) / range_rows)
    grown = F.count("*").over(in_range) > 2 * range_rows
    name = F.when(grown & (part > 0), F.concat("range", F.lit(f".{version}."), part.cast("string"))).otherwise(F.col("range"))
    rewritten, work = store_table(spark, merged.withColumn("_name", name).drop("range").withColumnRenamed("_name", "range"), "rewritten")
    count = touched.count()
    if count:
        _write(rewritten, manifest.join(touched, "range", "left_anti").drop("number"), folder, version)
    remove_folder(spark, changed)
    remove_folder(spark, work)
    return count


def _entries(spark: SparkSession, folder: str, manifest: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Entries of the ranges of ``manifest``. A few ``names`` of them reach the scan, which skips what can't hold them."""
    entries = spark.read.schema(ENTRIES).parquet(f"{folder}/entries")
    if names is not None and len(names) <= FEW:
        entries = entries.where(F.col("range").isin(names))
    return entries.join(manifest.select("range", "version"), ["range", "version"])


def numbered(spark: SparkSession, folder: str) -> DataFrame:
    """(site, path, title, url, bytes, n, upto): each document's number in its site, and the bytes up to it.

    Totals of ranges are added up per site; inside a range, which is bounded, rows are counted.
    """
    manifest = _manifest(spark, folder)
    totals = spark.read.schema(TOTALS).parquet(f"{folder}/totals").join(manifest.drop("number"), ["range", "version"])
    earlier = Window.partitionBy("site").orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    sum_of = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    before = totals.select("range", "site", sum_of("n").alias("_n"), sum_of("total").alias("_upto"))
    inside = Window.partitionBy("range", "site").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    rows = _entries(spark, folder, manifest)
    counted = rows.withColumns({"_k": F.count("*").over(inside), "_b": F.sum("bytes").over(inside)})
    return counted.join(before, ["range", "site"]).select(*ENTRY, (F.col("_n") + F.col("_k")).alias("n"), (F.col("_upto") + F.col("_b")).alias("upto"))


def places_changed_since(spark: SparkSession, mirror_path: str, since) -> DataFrame:
    """What ``update_index`` needs after a refresh: the places that versions newer than ``since`` have touched, as they are now.

    A post that moved touches its old places too.
    """
    versions = read_versions(spark, mirror_path).select("site", "path", "post_id", "version_ts")
    newer = versions.where(F.col("version_ts") > F.lit(since).cast("timestamp_ntz"))
    moved = versions.join(newer.select("site", "post_id").distinct(), ["site", "post_id"], "left_semi")
    touched = newer.select("site", "path").unionByName(moved.select("site", "path")).distinct()
    now = scan_mirror(spark, mirror_path).select(*ENTRY)
    return touched.join(now, ["site", "path"], "left").select(*ENTRY, F.col("url").isNull().alias("is_deleted"))

