"""The mirror bucketed by its key: results, and plans in which it doesn't move."""

import re

import pytest
from pyspark.sql import functions as F

from mirrorleaf.session import work_folder
from mirrorleaf.sources import keyed, store

FIELDS = "site string, path string, post_id bigint, markdown string, version_ts string, version_seq bigint, is_deleted boolean"


def versions(spark, rows):
    df = spark.createDataFrame(rows, FIELDS).withColumn("version_ts", F.col("version_ts").cast("timestamp_ntz"))
    return df.withColumns({"url": F.lit("u"), "kind": F.lit("post"), "title": F.lit("t"), "front_matter": F.lit("")})


ROWS = [
    [("a", "p1", 1, "old", "2024-01-01", 0, False), ("a", "p2", 2, "two", "2024-01-01", 0, False), ("b", "p1", 3, "b", "2024-01-01", 0, False)],
    [("a", "p1", 1, "new", "2024-01-02", 1, False), ("a", "p2", None, "", "2024-01-03", 0, True), ("a", "moved", 2, "two", "2024-01-03", 0, False)],
    # a late version, an equal one, and a place that is filled again
    [("a", "p1", 1, "late", "2024-01-01", 5, False), ("a", "p1", 1, "new", "2024-01-02", 1, False), ("a", "p2", 9, "nine", "2024-01-04", 0, False),
     ("b", "p1", 3, "", "2024-01-05", 0, True)],
]


@pytest.fixture
def table(spark):
    folder = work_folder(spark, "keyed")
    name = "keyed_" + folder.rsplit("-", 1)[1]
    for rows in ROWS:
        keyed.append_versions(versions(spark, rows), name, folder, buckets=4)
    yield name
    spark.sql(f"DROP TABLE {name}")


def exchanges(df):
    """(plan, its shuffles) before it runs."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan, re.findall(r"Exchange \w+\([^)]*\)", plan)


def test_newest_versions_count(spark, table):
    rows = {(r.site, r.path): (r.post_id, r.markdown) for r in keyed.documents(spark, table).collect()}
    assert rows == {("a", "p1"): (1, "new"), ("a", "p2"): (9, "nine"), ("a", "moved"): (2, "two")}
    assert keyed.documents(spark, table).columns == store.COLUMNS and keyed.documents(spark, table).count() == 3
    assert {tuple(r) for r in keyed.present(spark, table).collect()} == set(rows)
    since = keyed.documents(spark, table, "2024-01-02 12:00:00")
    assert {r.path for r in since.collect()} == {"p2", "moved"}
    every = store.current(spark.table(table))
    assert {(r.site, r.path): (r.post_id, r.markdown) for r in every.collect()} == rows


def test_missing(spark, table):
    wanted = spark.createDataFrame([("a", "p1", 1), ("b", "p1", 2), ("a", "none", 3), (None, "p1", 4), ("a", "moved", 5), ("b", "p1", 6)], "site string, path string, n int")
    assert sorted(r.n for r in keyed.missing(wanted, table).collect()) == [2, 3, 4, 6]
    assert keyed.missing(wanted.limit(0), table).count() == 0


def test_the_mirror_does_not_move(spark, table):
    wanted = spark.range(1000).select(F.concat(F.lit("s"), F.col("id") % 3).alias("site"), F.concat(F.lit("p"), "id").alias("path"))
    plan, moved = exchanges(keyed.missing(wanted, table))
    assert len(moved) == 1 and "Bucketed: true" in plan and "BroadcastExchange" not in plan
    side = plan[plan.index(moved[0]) :]
    assert "Range (0, 1000" in side and "FileScan" not in side.split("Range (0, 1000")[0]  # the other side is what moves
    plan, moved = exchanges(keyed.documents(spark, table, "2024-01-02"))
    assert not moved and "BroadcastExchange" not in plan and plan.count("Bucketed: true") == 2
    assert plan.count("PushedFilters: [IsNotNull(version_ts), GreaterThan(version_ts,") == 2
    narrow = [scan for scan in plan.split("FileScan parquet")[1:] if "title#" not in scan.split("]")[0]]
    assert len(narrow) == 1  # versions are ranked without the texts
    # also without a hint: a grouping by the key
    assert not exchanges(keyed.present(spark, table))[1]


def test_a_table_opened_by_its_folder(spark, table):
    folder = [r.data_type for r in spark.sql(f"DESCRIBE EXTENDED {table}").collect() if r.col_name == "Location"][0]
    keyed.open_table(spark, f"{table}_again", folder, buckets=4)
    plan, moved = exchanges(keyed.documents(spark, f"{table}_again"))
    assert not moved and keyed.documents(spark, f"{table}_again").count() == 3
    spark.sql(f"DROP TABLE {table}_again")


def test_changed_since_ranks_narrow_rows(spark):
    folder = work_folder(spark, "mirror")
    for rows in ROWS:
        store.write_mirror(versions(spark, rows), folder)
    df = store.changed_since(spark, folder, "2024-01-02 12:00:00")
    assert {(r.path, r.markdown) for r in df.collect()} == {("p2", "nine"), ("moved", "two")}
    plan = df._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    assert windows and not any("markdown" in w for w in windows)
    ranked = [plan[m.start() : m.start() + 4000] for m in re.finditer(r"Window \[", plan)]
    assert all("markdown" not in part.split("FileScan")[0] for part in ranked)
