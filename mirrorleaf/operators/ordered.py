"""Running totals over a group of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorleaf.session import persist_table


def running_total(
    df: DataFrame, group: str, order: str, value: Column, name: str, parts: int | None = None
) -> DataFrame:
    """Adds ``name``: the sum of ``value`` up to and including this row.

    ``order`` must be unique inside a group. A plain window would sort a whole group in
    one task. Here the rows are sorted into ranges over (group, order), as many as
    ``parts`` or as the session has shuffle partitions, and stored with the number of
    their range. Ranges are summed in parallel, the few totals of a group are added up,
    and each row adds the total before its range to the running sum inside it.

    Keep ``df`` narrow: it is stored once and shuffled twice.
    """
    spark = df.sparkSession
    valued = df.withColumn("_value", value)
    ranged = valued.repartitionByRange(parts, group, order) if parts else valued.repartitionByRange(group, order)
    ranged = persist_table(spark, ranged.withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy(group, "_part").agg(F.sum("_value").alias("_total"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(group, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(group, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    summed = ranged.withColumn("_inside", F.sum("_value").over(inside))
    return (
        summed.join(before, [group, "_part"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_part", "_value", "_inside", "_before")
    )
