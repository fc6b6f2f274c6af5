"""Counts over runs, posts and the mirror."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorleaf.config import BUILT_IN_TYPES


def run_status(queue: DataFrame, run_log: DataFrame) -> DataFrame:
    """Totals of each run; ``finished`` is set once every queued item is logged."""
    ts = run_log.schema["ts"].dataType
    planned = queue.select("run_id", F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast(ts).alias("ts"))
    rows = planned.unionByName(run_log.select("run_id", "ok", "ts"))
    processed, total = F.count("ok"), F.count_if(F.col("ok").isNull())
    return rows.groupBy("run_id").agg(
        total.alias("total"),
        processed.alias("processed"),
        F.count_if(~F.col("ok")).alias("errors"),
        F.min("ts").alias("started"),
        F.when(processed >= total, F.max("ts")).alias("finished"),
    )


def type_counts(posts: DataFrame, per: tuple[str, ...] = ()) -> DataFrame:
    """Published posts per custom type; types without any do not appear."""
    custom = posts.where((F.col("post_status") == "publish") & ~F.col("post_type").isin(*BUILT_IN_TYPES))
    return custom.groupBy(*per, "post_type").agg(F.count(F.lit(1)).alias("published"))


def mirror_stats(mirror: DataFrame) -> DataFrame:
    """Number and size of documents per site; reads no text."""
    return mirror.groupBy("site").agg(F.count(F.lit(1)).alias("documents"), F.sum("bytes").alias("bytes"))
