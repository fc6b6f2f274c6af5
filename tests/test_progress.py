"""Status of running jobs from a log with repeated steps."""

from datetime import datetime

from pyspark.sql import functions as F

from mirrorleaf.operators.stats import run_status
from mirrorleaf.session import work_folder
from mirrorleaf.streaming import progress

AT = datetime(2025, 1, 1, 12)


def lines(spark, *rows):
    """(run, item, ok, minute) as log lines."""
    made = [(run, None if minute is None else AT.replace(minute=minute), "post", item, f"/{item}", ok) for run, item, ok, minute in rows]
    return spark.createDataFrame(made, progress.LOG).coalesce(1)


def followed(spark, folder, step=None, **options):
    if step is not None:
        step.write.mode("append").parquet(f"{folder}/log")
    progress.progress_stream(spark, f"{folder}/log", f"{folder}/counts", f"{folder}/checkpoint", drain=True, **options).awaitTermination()
    queue = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("idle",)], "run_id string")
    return queue, {r.run_id: tuple(r)[1:] for r in progress.run_progress(spark, queue, f"{folder}/counts").collect()}


def test_repeated_steps_count_once_and_restarts_go_on(spark):
    folder = work_folder(spark, "progress")
    first = lines(spark, ("a", 1, True, 0), ("a", 2, False, 1), ("b", 1, True, 2))
    _, status = followed(spark, folder, first)
    assert status == {
        "a": (3, 2, 1, AT, None), "b": (2, 1, 0, AT.replace(minute=2), None), "idle": (1, 0, 0, None, None)
    }
    _, again = followed(spark, folder, first)
    assert again == status
    last = lines(spark, ("a", 3, True, 9), ("a", 2, True, 9), ("b", 2, False, 9), ("b", 2, False, 9))
    queue, status = followed(spark, folder, last)
    assert status == {
        "a": (3, 3, 1, AT, AT.replace(minute=9)), "b": (2, 2, 1, AT.replace(minute=2), AT.replace(minute=9)), "idle": (1, 0, 0, None, None)
    }
    # the batch job over the distinct lines says the same
    every = spark.read.parquet(f"{folder}/log").groupBy(*progress.ITEM).agg(F.min(F.struct("ts", "ok")).alias("l")).select("run_id", "l.*")
    batch = {r.run_id: tuple(r)[1:] for r in run_status(queue, every).where("run_id <> 'idle'").collect()}
    assert batch == {k: v for k, v in status.items() if k != "idle"}


def test_order_of_files_does_not_matter(spark):
    steps = [lines(spark, ("a", k % 3, True, k)) for k in (5, 1, 3, 0, 2, 4)]
    folder = work_folder(spark, "progress")
    for step in steps:
        step.write.mode("append").parquet(f"{folder}/log")
    _, status = followed(spark, folder, files_per_step=2)
    assert status["a"][:3] == (3, 3, 0)


def test_an_empty_log(spark):
    folder = work_folder(spark, "progress")
    _, status = followed(spark, folder, lines(spark))
    assert status["a"] == (3, 0, 0, None, None)
