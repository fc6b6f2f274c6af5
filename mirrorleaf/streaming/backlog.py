"""Work through a queue in bounded steps.

Either the queue is a folder of files with a bounded number of items each, of which a
file stream takes some per step. Or its items are numbered, and a stream of positions
hands out exactly so many of them per step. A checkpoint remembers what is done.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from mirrorleaf.config import MirrorConfig
from mirrorleaf.operators.ordered import running_total
from mirrorleaf.operators.ranking import drop_overwritten
from mirrorleaf.plans.generate import POSITION
from mirrorleaf.plans.site_docs import write_site_documents
from mirrorleaf.session import folder_exists
from mirrorleaf.sources.steps import step_positions
from mirrorleaf.sources.store import scan_mirror, write_mirror

FILE_ROWS = 100_000
STEP = "step"
FIRST_STEP = "first_step"  # of a micro-batch: its folder


def write_backlog(queue: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Store queued items, ``file_rows`` per file: the smallest step there can be.

    Items are packed first, as each file left by a split of a table would be a step of
    its own, however few items it has.
    """
    files = -(-queue.count() // file_rows)
    if files < queue.rdd.getNumPartitions():
        queue = queue.repartition(max(1, files))
    queue.write.mode("append").option("maxRecordsPerFile", file_rows).parquet(path)


def write_queue(queue: DataFrame, path: str, order: Sequence[str]) -> None:
    """Append items to a queue with their ``position``, counted from 0 in ``order``, which is unique.

    Rows are numbered by sums over ranges, and stored in order, so that a step reads the
    row groups of its positions only. Positions go on behind the items already there.
    """
    spark = queue.sparkSession
    before = queue_length(spark, path)
    keyed = queue.withColumns({"_all": F.lit(0), "_order": F.struct(*order)})
    counted = running_total(keyed, "_all", "_order", F.lit(1), "position").drop("_all", "_order")
    numbered = counted.withColumn("position", F.col("position") - 1 + before)
    numbered.repartitionByRange("position").sortWithinPartitions("position").write.mode("append").parquet(path)


def queue_length(spark: SparkSession, path: str) -> int:
    if not folder_exists(spark, path):
        return 0
    last = spark.read.schema("position bigint").parquet(path).agg(F.max("position")).first()[0]
    return 0 if last is None else last + 1


def write_ordered(table: DataFrame, path: str, order: str, rows: int) -> DataFrame:
    """Store a table in ``order``, some ``FILE_ROWS / 4`` of its ``rows`` in a file, and read it back.

    What a micro-batch then reads of it, between two values of ``order``, is a few files
    whatever the size of the table.
    """
    spark = table.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, -(-4 * rows // FILE_ROWS))
    table.repartitionByRange(parts, order).sortWithinPartitions(order).write.parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def ordered_pages(pages: DataFrame, posts: DataFrame, path: str, rows: int) -> DataFrame:
    """Pages at the address of a post, stored in the order of the posts: with ``first`` and ``last`` id of a post there.

    Those of a range of posts overlap it (``pages_between``). No page is there twice, and
    none that a post looks for is missing.
    """
    addresses = posts.groupBy(F.col("permalink").alias("url")).agg(F.min("post_id").alias("first"), F.max("post_id").alias("last"))
    found = pages.join(addresses, "url").select(*pages.columns, "first", "last")
    return write_ordered(found, path, "first", rows)


def pages_between(pages: DataFrame, low, high) -> DataFrame:
    return pages.where((F.col("first") <= F.lit(high)) & (F.col("last") >= F.lit(low))).drop("first", "last")


def _step(process: Callable[[DataFrame], DataFrame], outcome_path: str, mirror_path: str | None, run_ts: str | None) -> Callable:
    def step(batch: DataFrame, batch_id: int, several: bool = False) -> None:
        spark = batch.sparkSession
        done = process(batch).withColumn("row_id", F.monotonically_increasing_id())
        if not several:
            done = done.withColumn(STEP, F.lit(batch_id).cast("bigint"))
        # the steps of a micro-batch share files; a repetition has the same steps and replaces them
        folder = f"{outcome_path}/{FIRST_STEP}={batch_id}"
        done.write.mode("overwrite").parquet(folder)
        if mirror_path is not None:
            stored = spark.read.schema(done.schema).parquet(folder)
            documents = drop_overwritten(stored.where(F.col("reason").isNull()), [STEP, *POSITION])
            versions = {
                "version_ts": F.lit(run_ts).cast("timestamp_ntz"),
                "version_seq": F.col(STEP).cast("bigint"),
                "is_deleted": F.lit(False),
            }
            write_mirror(documents.withColumns(versions), mirror_path)

    return step


def step_stream(
    spark: SparkSession,
    path: str,
    process: Callable[[DataFrame], DataFrame],
    outcome_path: str,
    checkpoint: str,
    cfg: MirrorConfig,
    drain: bool = False,
    items_per_step: int | None = None,
    steps_at_once: int = 1,
    mirror_path: str | None = None,
    run_ts: str | None = None,
) -> StreamingQuery:
    """``backlog_stream`` over a numbered queue: each step has exactly ``cfg.batch_size`` items, the last what is left.

    ``items_per_step`` replaces that setting, whose limit of 100 suits a web server. With
    ``drain`` the call returns when the queue is empty. A start over the same checkpoint
    goes on with the next step, or repeats the one that failed; items appended meanwhile
    are taken by the next start.

    ``steps_at_once`` puts so many steps into a micro-batch, as each costs seconds
    however few its items are, and so does each file. Steps keep their size and number;
    ``process`` then gets the items with their ``step`` and has to keep it. What is stored
    in a folder, and repeated after a failure, is the micro-batch.
    """
    work = _step(process, outcome_path, mirror_path, run_ts)

    def step(batch: DataFrame, batch_id: int) -> None:
        # the stream carries positions alone and is read once: its steps have one size, but for the last
        steps = batch.groupBy(STEP).agg(F.min("position"), F.max("position")).collect()
        if steps:
            (low, first, end), last = min(steps), max(s[2] for s in steps)
            # the bounds reach the scan
            items = batch.sparkSession.read.parquet(path).where(F.col("position").between(first, last))
            number = F.lit(low) + F.floor((F.col("position") - first) / (end - first + 1)).cast("bigint")
            several = steps_at_once > 1 or len(steps) > 1
            work(items.withColumn(STEP, number) if several else items, low, several)

    positions = step_positions(spark, queue_length(spark, path), items_per_step or cfg.batch_size, steps_at_once)
    pause = "0 seconds" if drain else f"{cfg.batch_delay} minutes"
    started = (
        positions.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(processingTime=pause)
        .start()
    )
    if drain:
        try:
            started.processAllAvailable()
        finally:
            started.stop()
    return started


def backlog_stream(
    spark: SparkSession,
    path: str,
    schema,
    process: Callable[[DataFrame], DataFrame],
    outcome_path: str,
    checkpoint: str,
    cfg: MirrorConfig,
    drain: bool = False,
    files_per_step: int = 1,
    mirror_path: str | None = None,
    run_ts: str | None = None,
) -> StreamingQuery:
    """Process the backlog step by step; store outcomes and, with ``mirror_path``, documents.

    With ``drain`` all steps run without a pause, else a step starts every
    ``cfg.batch_delay`` minutes. Each step writes its own folder and its number, so a step that
    is replayed after a failure replaces what it wrote before; documents of a replay
    equal those there are. A later step's document of a path replaces an earlier one's.
    """
    items = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_step).parquet(path)

    trigger = {"availableNow": True} if drain else {"processingTime": f"{cfg.batch_delay} minutes"}
    return (
        items.writeStream.foreachBatch(_step(process, outcome_path, mirror_path, run_ts))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def finish(
    spark: SparkSession, mirror_path: str, sites: DataFrame, posts: DataFrame, cfg: MirrorConfig, run_ts: str, folder: str
) -> None:
    """What follows an empty backlog: index, export and summary of every site."""
    write_site_documents(scan_mirror(spark, mirror_path), sites, posts, cfg, run_ts, folder)
