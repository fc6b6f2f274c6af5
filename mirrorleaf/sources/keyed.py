"""The mirror as a table bucketed by its key, for lookups that leave it where it is.

Versions of documents are dealt to buckets by (site, path) when they are written, and
sorted in them. Whatever groups or joins by that key then reads bucket by bucket: only
the other side of a join moves. A post that moved has a deletion at its old place (see
``streaming.placements``), so the newest version of a place is all that counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorleaf.sources.store import COLUMNS, ROW, SCHEMA, with_bytes

KEY = ("site", "path")
BUCKETS = 64  # of a table, for good; some hundreds of megabytes in each are a good size


def append_versions(rows: DataFrame, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Add document versions to the table ``name``, whose files are in ``path``; makes it if need be.

    Rows are dealt out as the buckets are, so each task writes one file.
    """
    (
        with_bytes(rows)
        .repartition(buckets, *KEY)
        .write.mode("append")
        .bucketBy(buckets, *KEY)
        .sortBy(*KEY)
        .option("path", path)
        .format("parquet")
        .saveAsTable(name)
    )


def open_table(spark: SparkSession, name: str, path: str, buckets: int = BUCKETS) -> None:
    """Make a stored table known to a session that didn't write it."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet OPTIONS (path '{path}') "
        f"CLUSTERED BY ({', '.join(KEY)}) SORTED BY ({', '.join(KEY)}) INTO {buckets} BUCKETS"
    )


def _versions(spark: SparkSession, name: str, since=None) -> DataFrame:
    rows = spark.table(name)
    if since is not None:
        rows = rows.where(F.col("version_ts") > F.lit(since).cast("timestamp_ntz"))
    return rows.select(*COLUMNS, F.col("_metadata.file_path").alias(ROW[0]), F.col("_metadata.row_index").alias(ROW[1]))


def documents(spark: SparkSession, name: str, since=None) -> DataFrame:
    """Current documents, or those newer than ``since``, without moving a row.

    The newest version of each place is found on narrow columns; texts meet it in their
    bucket. The filter on the version reaches both scans: what replaces a newer version is
    newer still. Of equal versions one counts.
    """
    rows = _versions(spark, name, since)
    place = F.struct("version_ts", "version_seq", *ROW)
    newest = rows.groupBy(*KEY).agg(F.max(place).alias("_newest"), F.max_by("is_deleted", place).alias("_deleted"))
    newest = newest.where(~F.col("_deleted")).drop("_deleted")
    # nothing is above the newest, so this is equality, but no key that rows would have to be dealt out by
    return rows.join(newest.hint("shuffle_hash"), list(KEY)).where(place >= F.col("_newest")).select(*COLUMNS)


def present(spark: SparkSession, name: str) -> DataFrame:
    """(site, path) of all current documents, in their buckets."""
    place = F.struct("version_ts", "version_seq", *ROW)
    newest = _versions(spark, name).groupBy(*KEY).agg(F.max_by("is_deleted", place).alias("_deleted"))
    return newest.where(~F.col("_deleted")).select(*KEY)


def missing(wanted: DataFrame, name: str) -> DataFrame:
    """Rows of ``wanted`` (site, path, ...) that have no document. They alone are shuffled."""
    known = present(wanted.sparkSession, name)
    return wanted.join(known.hint("merge"), list(KEY), "left_anti")
