"""Status of runs while they go on, from the log lines that their steps append.

A step that is repeated after a failure logs its items once more. Each item of a run
counts once: its first line is kept in state until the watermark has passed it, and
counts per run are kept up to date by an aggregate in update mode.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ITEM = ("run_id", "kind", "item_id", "label")
LOG = "run_id string, ts timestamp_ntz, kind string, item_id bigint, label string, ok boolean"
REPLAY_WITHIN = "1 day"


def first_lines(lines: DataFrame, replay_within: str = REPLAY_WITHIN) -> DataFrame:
    """One line per item of a run; repeats that come within ``replay_within`` of it are dropped.

    Every line of a log has its time.
    """
    keyed = lines.select(*ITEM, "ok", F.col("ts").cast("timestamp").alias("ts"))
    return keyed.withWatermark("ts", replay_within).dropDuplicatesWithinWatermark(list(ITEM))


def counts(lines: DataFrame) -> DataFrame:
    """(run_id, processed, errors, started, last) of each run with a line."""
    return lines.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.min("ts").alias("started"),
        F.max("ts").alias("last"),
    )


def progress_stream(
    spark: SparkSession, log_path: str, counts_path: str, checkpoint: str,
    replay_within: str = REPLAY_WITHIN, files_per_step: int = 100, drain: bool = False,
) -> StreamingQuery:
    """Follow the log below ``log_path``; each step writes the counts of the runs it changed.

    A step that is repeated replaces what it wrote. With ``drain`` the stream ends with
    the log there is; a start over the same checkpoint goes on behind it.
    """
    lines = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_step).parquet(log_path)

    def step(batch: DataFrame, batch_id: int) -> None:
        # a row for a run; one file is enough
        batch.coalesce(1).write.mode("overwrite").parquet(f"{counts_path}/step={batch_id}")

    trigger = {"availableNow": True} if drain else {"processingTime": "10 seconds"}
    return (
        counts(first_lines(lines, replay_within))
        .writeStream.outputMode("update")
        .foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def run_progress(spark: SparkSession, queue: DataFrame, counts_path: str) -> DataFrame:
    """``stats.run_status`` of the runs in ``queue`` (run_id), from the newest counts of each.

    A run without a line has nothing processed; it is finished once every queued item is.
    """
    schema = "run_id string, processed bigint, errors bigint, started timestamp, last timestamp, step bigint"
    steps = spark.read.schema(schema).parquet(counts_path)
    now = F.struct("step", "processed", "errors", "started", "last").alias("now")
    # one aggregate over both: where all items have one literal run a join would lose its key
    planned = queue.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    unknown = F.lit(None).cast("struct<step:bigint,processed:bigint,errors:bigint,started:timestamp,last:timestamp>")
    rows = planned.withColumn("now", unknown).unionByName(steps.where("run_id IS NOT NULL").select("run_id", F.lit(None).cast("bigint").alias("total"), now))
    newest = F.max_by("now", "now.step").alias("now")
    runs = rows.groupBy("run_id").agg(F.max("total").alias("total"), newest).where("total IS NOT NULL")
    processed = F.coalesce("now.processed", F.lit(0))
    return runs.select(
        "run_id",
        "total",
        processed.alias("processed"),
        F.coalesce("now.errors", F.lit(0)).alias("errors"),
        F.col("now.started").cast("timestamp_ntz").alias("started"),
        F.when(processed >= F.col("total"), F.col("now.last").cast("timestamp_ntz")).alias("finished"),
    )
