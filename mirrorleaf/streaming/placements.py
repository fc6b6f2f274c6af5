"""Refresh whose removals come from state: no step reads the mirror.

Two streams work one after the other. The first renders what the changes ask for, as
``refresh`` does, and notes where each post has gone (a narrow row for a change). The
second keeps, for each post, its newest change and its last place in a state store;
a post that moved or vanished gets a deletion at the place the state remembers. A key
of the store holds NEAR neighbouring ids, as each call of the store takes its time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from mirrorleaf.config import MirrorConfig
from mirrorleaf.session import folder_exists, persist_table, remove_folder, store_table, work_folder
from mirrorleaf.sources.store import scan_mirror, with_bytes, write_mirror
from mirrorleaf.streaming.refresh import Source, _read, newest_changes, version_rows

PLACED, REMOVED, KEPT = "placed", "removed", "kept"
PLACE = ("site", "path", "url", "kind")
NOTES = "post_id bigint, fate string, site string, path string, url string, kind string, version_ts timestamp_ntz, version_seq bigint"
TOMBSTONES = T.StructType([
    T.StructField("post_id", T.LongType()), *(T.StructField(c, T.StringType()) for c in PLACE),
    T.StructField("version_ts", T.TimestampNTZType()), T.StructField("version_seq", T.LongType()),
])
NEAR = 5  # bits of a post's id that its key of the state store leaves out
STATE = T.StructType([T.StructField("posts", T.ArrayType(TOMBSTONES))])
STORE = "spark.sql.streaming.stateStore.providerClass"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LastPlace(StatefulProcessor):
    """Newest change and last place of neighbouring posts. Older and repeated changes leave both as they are."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.places = handle.getValueState("places", STATE)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        before = self.places.get()
        known = {last[0]: tuple(last[1:]) for last in before[0]} if before else {}
        changed = False
        for row in sorted(rows, key=lambda r: (r.post_id, r.version_ts, r.version_seq)):
            last = known.get(row.post_id, (None,) * 6)
            place, newest = last[:4], last[4:]
            version = (row.version_ts, row.version_seq)
            if newest[0] is not None and version <= newest:
                continue
            if row.fate != KEPT:
                own = tuple(row[c] for c in PLACE)
                if place[1] is not None and own[:2] != place[:2]:
                    # a post that moved is ranked by its new document, so its old place alone is deleted
                    gone = None if row.fate == PLACED else row.post_id
                    yield Row(**dict(zip(TOMBSTONES.fieldNames(), (gone, *place, *version), strict=True)))
                place = own if row.fate == PLACED else (None,) * 4
            if version != newest:
                known[row.post_id], changed = (*place, *version), True
        if changed:
            self.places.update(([(post, *last) for post, last in known.items()],))

    def close(self) -> None:
        pass


def _notes(newest: DataFrame, versions: DataFrame) -> DataFrame:
    """What became of each changed post: a document, a deletion, or nothing."""
    fate = F.when(F.col("is_deleted"), REMOVED).otherwise(PLACED).alias("fate")
    made = versions.select("post_id", fate, *PLACE)
    other = F.when(F.col("op") == "delete", REMOVED).otherwise(KEPT)
    joined = newest.join(made, "post_id", "left").withColumn("fate", F.coalesce("fate", other))
    return joined.select(*(field.split()[0] for field in NOTES.split(", ")))


def _render_step(posts: Source, pages: Source, mirror_path: str, notes_path: str, cfg: MirrorConfig) -> Callable:
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        newest, changes = store_table(spark, newest_changes(batch), "changes")
        changed = _read(posts).join(newest.select("post_id"), "post_id", "left_semi")
        rows, rendered = store_table(spark, version_rows(newest, changed, _read(pages), cfg), "versions")
        write_mirror(rows, mirror_path)
        # a step that is repeated replaces its notes; if they were read before, the state knows them
        _notes(newest, rows).coalesce(8).write.mode("overwrite").parquet(f"{notes_path}/step={batch_id}")
        remove_folder(spark, changes)
        remove_folder(spark, rendered)

    return handle


def _removal_step(spark: SparkSession, mirror_path: str) -> Callable:
    """``spark`` is the session of the caller; a stateful stream's own session runs without adaptive execution."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        empty = {c: F.lit("") for c in ("title", "front_matter", "markdown")}
        rows = with_bytes(batch.withColumns(empty).withColumn("is_deleted", F.lit(True)))
        folder = work_folder(spark, "tombstones")
        rows.write.parquet(folder)
        stored = spark.read.schema(rows.schema).parquet(folder)
        if not stored.isEmpty():
            write_mirror(stored, mirror_path)
        remove_folder(spark, folder)

    return handle


def _first_notes(spark: SparkSession, mirror_path: str, notes_path: str) -> None:
    """The places of a mirror that is older than the stream. The only time that it is read."""
    if folder_exists(spark, notes_path):
        return
    notes = spark.createDataFrame([], NOTES)
    if folder_exists(spark, mirror_path):
        known = scan_mirror(spark, mirror_path).where("post_id IS NOT NULL")
        notes = known.select("post_id", F.lit(PLACED).alias("fate"), *PLACE, "version_ts", "version_seq")
    persist_table(spark, notes, "places").write.parquet(f"{notes_path}/step=-1")


def last_places(notes: DataFrame) -> DataFrame:
    """(post_id, site, path, url, kind, version_ts, version_seq) of deletions, from a stream of notes.

    Null ids, which no post has, are left out. A post's notes of one step are few: the
    newest change of each step.
    """
    near = F.shiftright("post_id", NEAR).alias("near")
    keyed = notes.where("post_id IS NOT NULL").select("*", near).groupBy("near")
    return keyed.transformWithState(LastPlace(), TOMBSTONES, "Append", "None")


class Refresh(NamedTuple):
    documents: StreamingQuery
    removals: StreamingQuery


def refresh_state(
    changes: DataFrame, posts: Source, pages: Source, mirror_path: str, checkpoint: str, cfg: MirrorConfig, **trigger
) -> Refresh:
    """Start both streams; ``trigger`` is passed on, ``availableNow=True`` (the default) drains.

    A draining call returns when the first stream is done and the second has started. The
    checkpoint folder holds the progress of both, the notes, and the state; a call over
    the same folder goes on where the last one ended. Changes may come late, in any order
    and repeatedly: per post the newest (ts, change_id) counts. A save of a post that has no
    row leaves everything as it is. The session must use the RocksDB state store, see
    ``use_state_store``.
    """
    spark = changes.sparkSession
    trigger = trigger or {"availableNow": True}
    notes_path = f"{checkpoint}/notes"
    _first_notes(spark, mirror_path, notes_path)
    documents = (
        changes.writeStream.foreachBatch(_render_step(posts, pages, mirror_path, notes_path, cfg))
        .option("checkpointLocation", f"{checkpoint}/documents").trigger(**trigger).start()
    )
    if trigger.get("availableNow"):
        documents.awaitTermination()
    notes = spark.readStream.schema(f"{NOTES}, step int").parquet(notes_path).drop("step")
    removals = (
        last_places(notes).writeStream.foreachBatch(_removal_step(spark, mirror_path))
        .option("checkpointLocation", f"{checkpoint}/removals").trigger(**trigger).start()
    )
    return Refresh(documents, removals)


def use_state_store(spark: SparkSession) -> None:
    """Keep state in RocksDB, on the executors' disks and in the checkpoint; needed by ``refresh_state``."""
    spark.conf.set(STORE, PROVIDER)
