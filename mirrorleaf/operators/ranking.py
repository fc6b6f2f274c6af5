"""Top-k lists, fixed orders and the one-document-per-path rule."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mirrorleaf.functions.text import as_col

SALTS = 64


def newest_first() -> list[Column]:
    """The order of every post list: date, then id, both descending."""
    return [F.desc("published_on"), F.desc("post_id")]


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, salt_on: str = "post_id"
) -> DataFrame:
    """First ``k`` rows of each group, with their position in ``rank``.

    Two steps: the best ``k`` of each salted part of a group, then the best of
    those. A group that holds a third of all rows is thus cut down in parallel,
    and the last step sees at most ``k * SALTS`` rows of it.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(SALTS)))
    part = Window.partitionBy(*keys, "_salt").orderBy(*order)
    whole = Window.partitionBy(*keys).orderBy(*order)
    shortlist = salted.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return (
        shortlist.drop("_salt").withColumn("rank", F.row_number().over(whole)).where(F.col("rank") <= k)
    )


def main_sections(posts: DataFrame) -> DataFrame:
    """Published top-level pages; listed by menu order, then title."""
    return posts.where(
        (F.col("post_status") == "publish") & (F.col("post_type") == "page") & (F.col("parent_id") == 0)
    )


def latest_per_path(df: DataFrame, position: Sequence[str | Column]) -> DataFrame:
    """The last processed document of each ``(site, path)``.

    The limit on ``row_number`` is applied before the shuffle too, so a path
    shared by very many URLs sends one row per task.
    """
    last_first = [as_col(p).desc() for p in position]
    window = Window.partitionBy("site", "path").orderBy(*last_first)
    return df.withColumn("_last", F.row_number().over(window)).where(F.col("_last") == 1).drop("_last")


def drop_overwritten(
    stored: DataFrame, position: Sequence[str], row: str = "row_id", narrow: DataFrame | None = None
) -> DataFrame:
    """``latest_per_path`` for a stored table, without sorting its documents.

    ``row`` tells rows of equal position apart; the greater one counts. Rows that lose
    are found on narrow columns, or in ``narrow`` if it is given; they are few, so what
    is left of the table need not be ranked.
    """
    place = F.struct(*position, row)
    narrow = (stored if narrow is None else narrow).select("site", "path", *position, row)
    last = narrow.groupBy("site", "path").agg(F.max(place).alias("_last"), F.count(F.lit(1)).alias("_rows"))
    shared = last.where(F.col("_rows") > 1).drop("_rows")
    losers = narrow.join(shared, ["site", "path"]).where(place < F.col("_last")).select(row)
    return stored.join(losers, row, "left_anti")
