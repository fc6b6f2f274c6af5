"""Mirror refresh that follows saves and deletions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mirrorleaf.config import MirrorConfig
from mirrorleaf.operators.filters import real_edits
from mirrorleaf.plans.generate import post_outcomes
from mirrorleaf.session import folder_exists, remove_folder, store_table
from mirrorleaf.sources.store import COLUMNS, scan_mirror, with_bytes, write_mirror

# A table, or a function that reads it anew: a stream that runs for long needs the latter.
Source = DataFrame | Callable[[], DataFrame]


def _read(source: Source) -> DataFrame:
    return source() if callable(source) else source


def newest_changes(changes: DataFrame) -> DataFrame:
    """Last change of each post; partial aggregation absorbs a post edited all day."""
    if "is_revision" in changes.columns:
        changes = real_edits(changes)
    last = F.max_by("op", F.struct("ts", "change_id")).alias("op")
    when = F.max(F.struct("ts", "change_id")).alias("_when")
    return changes.groupBy("post_id").agg(last, when).select(
        "post_id",
        "op",
        F.col("_when.ts").cast("timestamp_ntz").alias("version_ts"),
        F.col("_when.change_id").alias("version_seq"),
    )


def version_rows(newest: DataFrame, posts: DataFrame, pages: DataFrame, cfg: MirrorConfig) -> DataFrame:
    """Mirror versions that the changes ask for, in one pass over the changed posts.

    A save of a published post gives a document, any other save and a delete
    give a deletion. A save the rules reject gives nothing, so the old document
    stays. Removed posts are not rendered.
    """
    removed = (F.col("op") == "delete") | (F.col("post_status") != "publish")
    touched = posts.join(newest, "post_id").withColumn("is_deleted", removed)
    if not (cfg.enabled and cfg.regenerate_on_save):
        touched = touched.where("is_deleted")
    skipped = touched.withColumn(
        "post_status", F.when(F.col("is_deleted"), F.lit("removed")).otherwise(F.col("post_status"))
    )
    done = post_outcomes(skipped, pages, cfg, ("version_ts", "version_seq", "is_deleted"))
    empty = {
        c: F.when(F.col("is_deleted"), F.lit("")).otherwise(F.col(c)) for c in ("title", "front_matter", "markdown")
    }
    wanted = done.where(F.col("is_deleted") | F.col("reason").isNull())
    return with_bytes(wanted.withColumns(empty))


def tombstones(newest: DataFrame, posts: DataFrame, documents: DataFrame) -> DataFrame:
    """Deletions of posts that are no longer in ``posts``, at the places of their ``documents``."""
    gone = newest.where(F.col("op") == "delete").join(posts.select("post_id"), "post_id", "left_anti")
    placed = documents.select("site", "path", "url", "kind", "post_id").join(gone.drop("op"), "post_id")
    empty = {c: F.lit("") for c in ("title", "front_matter", "markdown")}
    return with_bytes(placed.withColumns(empty).withColumn("is_deleted", F.lit(True)))


def refresh_batch(posts: Source, pages: Source, mirror_path: str, cfg: MirrorConfig) -> Callable:
    """Handler of one micro-batch. Replays append equal versions, which readers absorb."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest, folder = store_table(spark, newest_changes(batch), "changes")
        known = _read(posts)
        changed = known.join(newest.select("post_id"), "post_id", "left_semi")
        rows = version_rows(newest, changed, _read(pages), cfg)
        if folder_exists(spark, mirror_path):
            rows = rows.unionByName(tombstones(newest, known, scan_mirror(spark, mirror_path)))
        write_mirror(rows.select(*COLUMNS), mirror_path)
        remove_folder(spark, folder)

    return handle


def refresh_stream(
    changes: DataFrame,
    posts: Source,
    pages: Source,
    mirror_path: str,
    checkpoint: str,
    cfg: MirrorConfig,
    **trigger,
) -> StreamingQuery:
    """Start the refresh; ``trigger`` is passed on, ``availableNow=True`` drains.

    Pass functions for ``posts`` and ``pages`` if these tables change while the stream
    runs; each micro-batch calls them.
    """
    return (
        changes.writeStream.foreachBatch(refresh_batch(posts, pages, mirror_path, cfg))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
