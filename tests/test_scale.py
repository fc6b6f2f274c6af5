"""Skewed groups and the shape of plans."""

import re
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from mirrorleaf.config import MirrorConfig
from mirrorleaf.operators import ranking
from mirrorleaf.operators.ordered import running_total
from mirrorleaf.operators.render import spread
from mirrorleaf.plans import generate, site_docs
from mirrorleaf.session import work_folder
from mirrorleaf.sources import store
from workload import queries as workload
from workload.views import view

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def skewed(spark, n=3000):
    """A third of all rows share one site."""
    return spark.range(n).select(
        F.col("id").alias("post_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 50)).alias("site"),
        F.concat(F.lit("p"), F.lpad(F.conv(F.xxhash64("id").cast("string"), 10, 36), 14, "0"), "id").alias("path"),
        (F.col("id") * 7919 % 101).alias("published_on"),
        (F.col("id") % 9 + 1).alias("bytes"),
    )


@pytest.mark.parametrize("parts", [1, 5, 40, None])
def test_running_total(spark, parts):
    df = skewed(spark)
    window = Window.partitionBy("site").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    expected = df.select("post_id", F.sum("bytes").over(window).alias("t"))
    got = running_total(df, "site", "path", F.col("bytes"), "t", parts)
    assert got.count() == df.count()
    assert sorted(got.select("post_id", "t").collect()) == sorted(expected.collect())


def test_running_total_splits_a_hot_group(spark):
    got = running_total(skewed(spark), "site", "path", F.col("bytes"), "t", 20)
    plan = plan_of(got)
    # the only windows over documents are bounded by a range, and no row carries a list of marks
    for line in re.findall(r"Window \[.*", plan):
        assert "_part" in line
    assert "collect_set" not in plan and "filter(" not in plan


def test_running_total_of_one_large_site_is_linear(spark):
    df = spark.range(1_000_000).select(
        F.lit("s").alias("site"), F.xxhash64("id").cast("string").alias("path"), F.lit(1).alias("one")
    ).distinct()

    def seconds(frame):
        start = time.perf_counter()
        frame.write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    window = Window.partitionBy("site").orderBy("path").rowsBetween(Window.unboundedPreceding, 0)
    plain = min(seconds(df.withColumn("n", F.sum("one").over(window))) for _ in range(2))
    start = time.perf_counter()
    running_total(df, "site", "path", F.col("one"), "n").write.format("noop").mode("overwrite").save()
    assert time.perf_counter() - start < 2 * plain + 5  # some seconds for the table it writes


def test_top_per_group(spark):
    df = skewed(spark)
    window = Window.partitionBy("site").orderBy(*ranking.newest_first())
    expected = df.withColumn("rank", F.row_number().over(window)).where("rank <= 7").select("site", "rank", "post_id")
    got = ranking.top_per_group(df, ["site"], ranking.newest_first(), 7).select("site", "rank", "post_id")
    assert sorted(got.collect()) == sorted(expected.collect())
    assert "WindowGroupLimit" in plan_of(got)


def test_latest_per_path_both_ways(spark):
    stored = spark.range(900).select(
        F.lit("s").alias("site"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("p"), F.col("id") % 400)).alias("path"),
        F.lit(1).alias("kind_rank"),
        F.col("id").alias("item_id"),
        F.col("id").alias("row_id"),
    )
    order = ["kind_rank", "item_id"]
    expected = sorted(ranking.latest_per_path(stored, order).select("path", "item_id").collect())
    got = ranking.drop_overwritten(stored, order)
    assert sorted(got.select("path", "item_id").collect()) == expected
    assert dict(expected)["hot"] == 897


@pytest.mark.parametrize("n", [2, 5000])
def test_rows_of_equal_position_leave_one(spark, n):
    """A page that was ingested twice, at any size."""
    stored = spark.range(n * 2).select(
        F.lit("s").alias("site"), F.concat(F.lit("p"), F.col("id") % n).alias("path"), F.lit(1).alias("kind_rank"),
        (F.col("id") % n).alias("item_id"), F.col("id").alias("row_id"),
    )
    got = ranking.drop_overwritten(stored, ["kind_rank", "item_id"])
    assert got.count() == n and got.agg(F.min("row_id")).first()[0] == n


def test_no_query_joins_without_keys(spark):
    heavy = {
        "expand_sitemaps", "build_queue", "refresh_stream", "removals", "backlog_stream", "backlog_index", "fill_missing",
        "regenerate_mirror", "regenerate_log", "regenerate_status",
    }
    for name, run in workload.QUERIES.items():
        if name not in heavy:
            plan = plan_of(run(spark, SF))
            assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_index_reads_no_document_text(spark):
    mirror = workload.page_mirror(spark, SF)
    plan = plan_of(site_docs.site_index(mirror, view(spark, SF, "sites"), workload.RUN_TS))
    schemas = re.findall(r"ReadSchema: (\S+)", plan)
    assert any("path" in s for s in schemas)
    assert not any("markdown" in s or "front_matter" in s for s in schemas)


def test_filters_reach_the_scan(spark):
    plan = plan_of(spark.read.parquet(f"{SF}/pages.parquet").where("page_id > 10").select("url"))
    assert "PushedFilters: [IsNotNull(page_id), GreaterThan(page_id,10)]" in plan
    plan = plan_of(workload.QUERIES["path_keys"](spark, SF))
    assert "ReadSchema: struct<page_id:bigint,url:string>" in plan


def test_spread_only_small_inputs(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    assert spread(pages).rdd.getNumPartitions() == 8
    many = pages.repartition(16)
    folder = work_folder(spark, "many")
    many.write.parquet(folder)
    assert "Exchange" not in plan_of(spread(spark.read.parquet(folder)))


def test_run_renders_once_and_logs_everything(spark):
    folder = work_folder(spark, "run")
    done = generate.page_outcomes(view(spark, SF, "fetched"), MirrorConfig())
    log = generate.run(spark, done, "r", workload.RUN_TS, folder)
    assert log.count() == 50 and log.where("ok").count() == 40
    assert "ArrowEvalPython" not in plan_of(log)
    assert spark.read.parquet(folder).select("site", "path").distinct().count() == spark.read.parquet(folder).count()


def test_mirror_is_ranked_without_its_texts(spark):
    folder = work_folder(spark, "mirror")
    store.write_mirror(workload.page_mirror(spark, SF), folder)
    plan = plan_of(store.scan_mirror(spark, folder))
    for line in re.findall(r"Exchange .*|Window.*", plan):
        assert "markdown" not in line
    # what a client asks for is dropped where it is read
    plan = plan_of(store.changed_since(spark, folder, "2024-01-02 00:00:00"))
    assert re.search(r"PushedFilters: \[[^]]*GreaterThan\(version_ts", plan)
    plan = plan_of(store.read_versions(spark, folder, "h.e").select("path"))
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(site,h.e)" in plan
