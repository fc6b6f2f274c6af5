"""Streams against their batch answer."""

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from mirrorleaf.config import MirrorConfig
from mirrorleaf.session import work_folder
from mirrorleaf.sources import store
from mirrorleaf.streaming import backlog, placements, refresh, requests
from tests.conftest import column
from mirrorleaf.plans.regenerate import Tables
from tests.test_plans import SITE_SCHEMA, pages_of, post, posts_of
from workload import queries as workload
from workload.views import SCHEMAS

CHANGES = "change_id bigint, ts timestamp_ntz, post_id bigint, op string"


def changes_of(spark, rows):
    df = spark.createDataFrame(rows, "change_id bigint, ts string, post_id bigint, op string")
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def drain(spark, files, posts, cfg=MirrorConfig(), mirror=None):
    """Feed files of changes one by one, twice over the same mirror if it is given."""
    folder = work_folder(spark, "changes")
    for rows in files:
        changes_of(spark, rows).coalesce(1).write.mode("append").parquet(folder)
    mirror = mirror or work_folder(spark, "mirror")
    stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(folder)
    refresh.refresh_stream(stream, posts, pages_of(spark), mirror, work_folder(spark, "checkpoint"), cfg).awaitTermination()
    return mirror


def shown(spark, mirror):
    return {r.path: r.markdown for r in store.scan_mirror(spark, mirror).collect()}


FILES = [
    [(1, "2024-01-01 00:00:01", 1, "save"), (2, "2024-01-01 00:00:02", 2, "save"), (3, "2024-01-01 00:00:03", 3, "save")],
    [(9, "2024-01-01 00:00:09", 2, "delete"), (8, "2024-01-01 00:00:08", 2, "save"), (4, "2024-01-01 00:00:04", 4, "save")],
    # late and repeated changes, a draft, a rejected post, an unknown post
    [(5, "2024-01-01 00:00:00", 1, "delete"), (1, "2024-01-01 00:00:01", 1, "save"), (6, "2024-01-01 00:00:09", 5, "save"),
     (7, "2024-01-01 00:00:09", 99, "save"), (11, "2024-01-01 00:00:10", 3, "delete"), (12, "2024-01-01 00:00:10", 3, "save")],
]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_refresh_equals_batch(spark, order):
    posts = posts_of(spark, post(1), post(2), post(3), post(4, post_status="draft"), post(5, post_type="product"))
    mirror = drain(spark, [FILES[i] for i in order], posts)
    flat = [row for rows in FILES for row in rows]
    batch = refresh.version_rows(
        refresh.newest_changes(changes_of(spark, flat)), posts, pages_of(spark), MirrorConfig()
    )
    expected = {r.path: r.markdown for r in store.current(batch).collect()}
    assert shown(spark, mirror) == expected == {"p1/index.md": "Body 1", "p3/index.md": "Body 3"}
    drain(spark, [FILES[i] for i in order], posts, mirror=mirror)  # a replay changes nothing
    assert shown(spark, mirror) == expected


def test_rename_and_rejected_save(spark):
    save = lambda second: [[(second, f"2024-01-01 00:00:{second:02d}", 1, "save")]]
    mirror = drain(spark, save(1), posts_of(spark, post(1)))
    drain(spark, save(2), posts_of(spark, post(1, permalink="https://h.e/new/", body="moved")), mirror=mirror)
    assert shown(spark, mirror) == {"new/index.md": "moved"}
    drain(spark, save(3), posts_of(spark, post(1, permalink="https://h.e/new/", body="")), mirror=mirror)
    assert shown(spark, mirror) == {"new/index.md": "moved"}
    drain(spark, save(4), posts_of(spark, post(1, permalink="https://h.e/new/", post_status="private")), mirror=mirror)
    assert shown(spark, mirror) == {}


def test_a_running_stream_sees_new_and_rewritten_tables(spark, tmp_path):
    table, mirror, changes = (str(tmp_path / n) for n in ("posts", "mirror", "changes"))
    put = lambda mode, *rows: posts_of(spark, *rows).write.mode(mode).parquet(table)
    schema = posts_of(spark, post(1)).schema
    put("overwrite", post(1))
    changes_of(spark, [(0, "2024-01-01 00:00:00", 99, "save")]).write.parquet(changes)
    stream = spark.readStream.schema(CHANGES).parquet(changes)
    query = refresh.refresh_stream(
        stream, lambda: spark.read.schema(schema).parquet(table), lambda: pages_of(spark), mirror,
        work_folder(spark, "checkpoint"), MirrorConfig(), processingTime="0 seconds",
    )

    def tell(k, *rows):
        changes_of(spark, [(k, f"2024-01-01 00:00:{k:02d}", i, op) for i, op in rows]).coalesce(1).write.mode("append").parquet(changes)
        query.processAllAvailable()

    try:
        tell(1, (1, "save"))
        put("append", post(2))
        tell(2, (2, "save"))
        assert shown(spark, mirror) == {"p1/index.md": "Body 1", "p2/index.md": "Body 2"}
        put("overwrite", post(2, body="edited"))  # post 1 is gone for good
        tell(3, (2, "save"), (1, "delete"))
        assert shown(spark, mirror) == {"p2/index.md": "edited"}
    finally:
        query.stop()


def test_refresh_switched_off(spark):
    posts = posts_of(spark, post(1), post(2))
    mirror = drain(spark, [FILES[0]], posts)
    drain(spark, FILES[1:2], posts, MirrorConfig(regenerate_on_save=False), mirror)
    assert shown(spark, mirror) == {"p1/index.md": "Body 1"}


def test_backlog_steps(spark):
    folder = work_folder(spark, "backlog")
    cfg = MirrorConfig()
    queue = spark.range(10).withColumnRenamed("id", "item_id").coalesce(1)
    backlog.write_backlog(queue, f"{folder}/queue", file_rows=4)
    process = lambda batch: batch.withColumn("reason", F.when(F.col("item_id") == 3, "no"))
    backlog.backlog_stream(
        spark, f"{folder}/queue", queue.schema, process, f"{folder}/done", f"{folder}/checkpoint", cfg, drain=True
    ).awaitTermination()
    done = spark.read.parquet(f"{folder}/done")
    assert sorted(column(done, "item_id")) == list(range(10))
    assert done.select("step").distinct().count() == 3  # 4 + 4 + 2
    # a second drain over the same checkpoint finds nothing to do
    backlog.backlog_stream(
        spark, f"{folder}/queue", queue.schema, process, f"{folder}/done", f"{folder}/checkpoint", cfg, drain=True
    ).awaitTermination()
    assert spark.read.parquet(f"{folder}/done").count() == 10


REQUESTS = [
    (1, "https://h.e/a?x=1&format=markdown&y=2", ""), (2, "https://h.e/b/", "TEXT/X-Markdown"), (3, "https://h.e/b", "text/markdown"),
    (4, "https://h.e/c", "text/html"), (5, "https://h.e/d?format=markdown&format=html", None), (6, "https://h.e/_sitemap", "text/markdown"),
    (7, "https://h.e/x/_all.html", "text/markdown"), (8, "https://h.e/e?format=markdown#f", ""), (9, "https://h.e/g", "text/markdown"),
    (10, "https://h.e/?format=markdown", ""), (11, "https://h.e/p1", "text/markdown"), (12, "https://h.e/xformat=markdown", ""),
]


def test_requests(spark):
    asked = spark.createDataFrame(REQUESTS, "request_id int, uri string, accept string")
    classified = {r.request_id: r for r in requests.classify_requests(asked).collect()}
    assert [i for i, r in classified.items() if r.wants_markdown] == [1, 2, 3, 6, 7, 8, 9, 10, 11]
    assert (classified[1].url, classified[8].url, classified[10].url) == ("https://h.e/a?x=1&y=2", "https://h.e/e#f", "https://h.e/")
    mirror = spark.createDataFrame([("h.e", "a/index.md"), ("h.e", "g.md")], "site string, path string")
    missing = requests.lookup(asked, mirror)
    assert sorted(map(tuple, missing.select("path", "url").collect())) == [
        ("b/index.md", "https://h.e/b"), ("e/index.md", "https://h.e/e#f"), ("index.md", "https://h.e/"), ("p1/index.md", "https://h.e/p1"),
    ]
    sites = spark.createDataFrame([("h.e", "https://h.e", "Name", "About", "cs")], SITE_SCHEMA)
    terms = spark.createDataFrame(
        [(7, "category", "Cat", "", "https://H.e/b/?q")], "term_id int, taxonomy string, name string, description string, url string"
    )
    authors = spark.createDataFrame([], "author_id int, display_name string, bio string, url string")
    bridge = spark.createDataFrame([(1, 7)], "post_id bigint, term_id int")
    pages = pages_of(spark, (1, "https://h.e/e#f", "<p>made"))
    tables = Tables(posts_of(spark, post(1)), pages, bridge, terms, authors, sites)
    targets = requests.fill_targets(asked, mirror, tables, MirrorConfig()).collect()
    assert {r.url: (r.kind, r.target_id) for r in targets} == {
        "https://h.e/b": ("term", 7), "https://h.e/e#f": ("generic", None), "https://h.e/": ("homepage", None), "https://h.e/p1": ("post", 1),
    }
    asked = asked.unionByName(spark.createDataFrame([(13, "https://h.e/lost", "text/markdown")], asked.schema))
    folder = work_folder(spark, "fill")
    log = requests.fill_missing(spark, asked, folder, tables, MirrorConfig(), "r", "2024-01-01 00:00:00")
    documents = {r.path: (r.kind, r.markdown) for r in store.scan_mirror(spark, folder).collect()}
    assert {p: k for p, (k, _) in documents.items()} == {
        "b/index.md": "taxonomy_archive", "e/index.md": "archive", "index.md": "homepage", "p1/index.md": "post",
    }
    assert documents["e/index.md"][1] == "made" and documents["p1/index.md"][1] == "Body 1"
    misses = {r.label: r.reason for r in log.where("not ok").collect()}
    assert set(misses) == {"https://h.e/lost", "https://h.e/a?x=1&y=2", "https://h.e/g", "https://h.e/c", "https://h.e/d"} & set(misses)
    assert misses["https://h.e/lost"] == "HTTP Fetch returned empty body."
    # what is there now is not made again
    assert requests.lookup(asked, store.scan_mirror(spark, folder)).where("path = 'p1/index.md'").count() == 0


@pytest.fixture
def state_store(spark):
    placements.use_state_store(spark)
    yield
    spark.conf.unset(placements.STORE)


class Feed:
    """Changes in files of their own, refreshed by state over one mirror and one checkpoint."""

    def __init__(self, spark):
        self.spark, self.folder = spark, work_folder(spark, "changes")
        self.mirror, self.checkpoint = work_folder(spark, "mirror"), work_folder(spark, "checkpoint")

    def run(self, posts, *files, cfg=MirrorConfig()):
        for rows in files:
            changes_of(self.spark, rows).coalesce(1).write.mode("append").parquet(self.folder)
        stream = self.spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(self.folder)
        started = placements.refresh_state(stream, posts, pages_of(self.spark), self.mirror, self.checkpoint, cfg)
        started.removals.awaitTermination()
        return shown(self.spark, self.mirror)

    def tombstones(self):
        rows = store.read_versions(self.spark, self.mirror).where("is_deleted").collect()
        return sorted((r.path, r.post_id, str(r.version_ts)) for r in rows)


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 1, 0)])
def test_refresh_by_state_equals_batch(spark, state_store, order):
    posts = posts_of(spark, post(1), post(2), post(3), post(4, post_status="draft"), post(5, post_type="product"))
    feed, expected = Feed(spark), {"p1/index.md": "Body 1", "p3/index.md": "Body 3"}
    feed.run(posts, FILES[order[0]])
    assert feed.run(posts, *(FILES[i] for i in order[1:])) == expected  # after a restart
    assert feed.run(posts, *FILES) == expected  # all of it once more


def test_state_knows_the_places_of_posts_that_are_gone_or_moved(spark, state_store):
    save = lambda k, post_id, op="save": (k, f"2024-01-01 00:00:{k:02d}", post_id, op)
    feed = Feed(spark)
    assert feed.run(posts_of(spark, post(1), post(2)), [save(1, 1), save(2, 2)]) == {"p1/index.md": "Body 1", "p2/index.md": "Body 2"}
    moved = posts_of(spark, post(1, permalink="https://h.e/new/"))
    # post 2 is no row any more; its deletion comes with an older save, and a save of a post without a row
    assert feed.run(moved, [save(5, 2, "delete"), save(3, 2), save(4, 1)]) == {"new/index.md": "Body 1"}
    assert feed.tombstones() == [("p1/index.md", None, "2024-01-01 00:00:04"), ("p2/index.md", 2, "2024-01-01 00:00:05")]
    assert feed.run(moved, [save(3, 1, "delete"), save(4, 1), save(2, 2, "delete")]) == {"new/index.md": "Body 1"}  # late
    assert len(feed.tombstones()) == 2
    rejected = posts_of(spark, post(1, permalink="https://h.e/third/", body=""))
    assert feed.run(rejected, [save(6, 1)]) == {"new/index.md": "Body 1"}
    back = posts_of(spark, post(1))
    assert feed.run(back, [save(7, 1)]) == {"p1/index.md": "Body 1"}
    assert feed.run(posts_of(spark, post(2)), [save(8, 1, "delete")]) == {}


def test_state_begins_with_an_older_mirror_and_then_leaves_it_unread(spark, state_store, monkeypatch):
    posts = posts_of(spark, post(1), post(2))
    mirror = drain(spark, FILES[:1], posts)
    feed = Feed(spark)
    feed.mirror = mirror
    assert feed.run(posts_of(spark, post(1)), [(30, "2024-02-01 00:00:00", 2, "delete")]) == {"p1/index.md": "Body 1"}

    def fail(*_):
        raise AssertionError("the mirror was read")

    monkeypatch.setattr(placements, "scan_mirror", fail)
    assert feed.run(posts_of(spark, post(2)), [(31, "2024-02-01 00:00:01", 1, "delete"), (32, "2024-02-01 00:00:01", None, "save")]) == {}


def test_neighbouring_posts_share_a_key_of_the_state(spark, state_store):
    folder = work_folder(spark, "notes")

    def run(*notes):
        spark.createDataFrame(notes, "post_id bigint, fate string, path string, second bigint").selectExpr(
            "post_id", "fate", "'h.e' AS site", "path", "path AS url", "'post' AS kind",
            "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, second) AS version_ts", "second AS version_seq",
        ).coalesce(1).write.mode("append").parquet(f"{folder}/notes")
        found = []
        query = (
            placements.last_places(spark.readStream.schema(placements.NOTES).parquet(f"{folder}/notes"))
            .writeStream.foreachBatch(lambda batch, _: found.extend(batch.collect()))
            .option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
        )
        query.awaitTermination()
        keys = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress]
        return keys[-1], sorted((r.path, r.post_id, r.version_seq) for r in found)

    placed = [(k, "placed", f"p{k}", 1) for k in range(-32, 96)]
    assert run(*placed) == (4, [])  # before, 128
    gone = [(5, "removed", None, 3), (6, "placed", "new", 3), (7, "kept", None, 3), (-1, "removed", None, 2), (8, "removed", None, 0)]
    assert run(*gone, (6, "placed", "newer", 4)) == (4, [("new", None, 4), ("p-1", -1, 2), ("p5", 5, 3), ("p6", None, 3)])
    # others of the key, and what was kept, are still known; what is gone has no place any more
    last = [(9, "removed", None, 5), (7, "removed", None, 5), (6, "removed", None, 5), (5, "removed", None, 5)]
    assert run(*last) == (4, [("newer", 6, 5), ("p7", 7, 5), ("p9", 9, 5)])


def test_steps_have_the_exact_size(spark):
    folder = work_folder(spark, "steps")
    queue = lambda a, b: spark.range(a, b).select((F.lit(1000) - F.col("id")).alias("item_id"), F.lit("x").alias("note")).repartition(3)
    backlog.write_queue(queue(0, 17), f"{folder}/queue", ["item_id"])
    fail = [2]

    def process(batch):
        ids = sorted(column(batch, "item_id"))
        if fail and ids[0] == 989 and fail.pop():
            raise InterruptedError
        return batch.withColumn("reason", F.lit(None).cast("string"))

    def run(cfg=MirrorConfig(batch_size=5), **more):
        backlog.step_stream(spark, f"{folder}/queue", process, f"{folder}/done", f"{folder}/checkpoint", cfg, drain=True, **more)
        rows = spark.read.parquet(f"{folder}/done").collect()
        return {k: sorted(r.item_id for r in rows if r.step == k) for k in {r.step for r in rows}}

    with pytest.raises(StreamingQueryException):
        run()
    found = run()  # the failed step is repeated, no other
    ids = sorted(1000 - k for k in range(17))
    assert found == {0: ids[:5], 1: ids[5:10], 2: ids[10:15], 3: ids[15:]}
    assert run() == found  # nothing is left
    backlog.write_queue(queue(20, 29), f"{folder}/queue", ["item_id"])
    later = sorted(1000 - k for k in range(20, 29))
    assert run(items_per_step=8) == {**found, 4: later[:8], 5: later[8:]}


def test_many_steps_in_a_micro_batch_keep_their_size_and_number(spark):
    folder = work_folder(spark, "steps")
    queue = lambda a, b: spark.range(a, b).select(F.col("id").alias("item_id")).repartition(3)
    backlog.write_queue(queue(0, 57), f"{folder}/queue", ["item_id"])
    begun = []

    def process(batch):
        begun.append(batch.agg(F.min("item_id")).first()[0])
        if begun == [0, 20]:
            raise InterruptedError
        return batch.withColumn("reason", F.lit(None).cast("string"))

    def run(at_once, **more):
        backlog.step_stream(
            spark, f"{folder}/queue", process, f"{folder}/done", f"{folder}/checkpoint", MirrorConfig(batch_size=5), drain=True,
            steps_at_once=at_once, **more,
        )
        rows = spark.read.parquet(f"{folder}/done").collect()
        return {k: sorted(r.item_id for r in rows if r.step == k) for k in {r.step for r in rows}}

    with pytest.raises(StreamingQueryException):
        run(4)
    found = {k: list(range(5 * k, min(5 * k + 5, 57))) for k in range(12)}
    assert run(4) == found
    assert begun == [0, 20, 20, 40]  # twelve steps, three micro-batches, one of them repeated
    backlog.write_queue(queue(57, 80), f"{folder}/queue", ["item_id"])
    found |= {12: list(range(57, 65)), 13: list(range(65, 73)), 14: list(range(73, 80))}
    assert run(2, items_per_step=8) == found


@pytest.fixture
def few_documents(spark, tmp_path):
    """Tables of 500 documents with ids of their own: five steps, broken off in the third."""
    rows = [(7 * k, f"Text {k}\nMore.", "en", f"src{k % 3}", 10) for k in range(500)]
    spark.createDataFrame(rows, SCHEMAS["documents"]).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7 * k, k % 2, 0) for k in range(0, 500, 3)], SCHEMAS["labels"]).write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("failing", [None, 1, 2])
def test_a_failure_in_a_step_is_no_result(spark, few_documents, monkeypatch, failing):
    """The backlog is broken off on purpose once; whatever else fails is an error."""
    calls, made = [], workload.generate.post_outcomes

    def outcomes(*args):
        calls.append(args)
        if len(calls) == failing:
            raise RuntimeError("lost")
        return made(*args)

    monkeypatch.setattr(workload.generate, "post_outcomes", outcomes)
    if failing:
        with pytest.raises(StreamingQueryException, match="lost"):
            workload.QUERIES["backlog_steps"](spark, few_documents)
    else:
        rows = workload.QUERIES["backlog_steps"](spark, few_documents).collect()
        assert sorted((r.item_id, r.step) for r in rows) == [(7 * k, k // 100) for k in range(500)]


def test_steps_of_a_micro_batch_share_a_folder(spark):
    folder = work_folder(spark, "steps")
    backlog.write_queue(spark.range(45).withColumnRenamed("id", "item_id"), f"{folder}/queue", ["item_id"])
    process = lambda batch: batch.select("item_id", "step", F.lit(None).cast("string").alias("reason"))
    backlog.step_stream(
        spark, f"{folder}/queue", process, f"{folder}/done", f"{folder}/checkpoint", MirrorConfig(batch_size=5), drain=True, steps_at_once=4
    )
    done = spark.read.parquet(f"{folder}/done")
    assert sorted((r.item_id, r.step) for r in done.collect()) == [(k, k // 5) for k in range(45)]
    assert sorted(column(done.select("first_step").distinct(), "first_step")) == [0, 4, 8]


def test_a_micro_batch_reads_the_files_of_its_posts(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(backlog, "FILE_ROWS", 40)
    rows = spark.range(0, 400, 1, 3).select((F.lit(399) - F.col("id")).alias("post_id"), F.concat(F.lit("https://h.e/"), "id").alias("permalink"))
    stored = backlog.write_ordered(rows, f"{tmp_path}/posts", "post_id", 400)
    assert sorted(stored.collect()) == sorted(rows.collect())
    files = stored.groupBy("_metadata.file_path").agg(F.min("post_id").alias("a"), F.max("post_id").alias("b")).collect()
    assert len(files) > 30 and sum(r.a <= 240 and r.b >= 200 for r in files) < 9
    # ids of pages have nothing to do with those of posts; one address has two posts, one page is there twice
    posts = rows.union(spark.createDataFrame([(5, "https://h.e/0")], rows.schema))
    ids = [(1000 - k, f"https://h.e/{k}", f"{k}") for k in range(-5, 400)] + [(7, "https://h.e/3", "again")] * 2
    pages = spark.createDataFrame(ids, "page_id bigint, url string, html string")
    ordered = backlog.ordered_pages(pages, posts, f"{tmp_path}/pages", 400)
    between = lambda low, high: sorted(map(tuple, backlog.pages_between(ordered, low, high).collect()))
    assert between(396, 397) == sorted([(1000 - 2, "https://h.e/2", "2"), *ids[-2:], (1000 - 3, "https://h.e/3", "3")] + [(1000, "https://h.e/0", "0")])
    assert (1000, "https://h.e/0", "0") in between(5, 5) and len(between(0, 399)) == 402
    assert between(None, None) == []


def test_a_backlog_of_a_table_with_many_splits_has_few_files(spark):
    folder = work_folder(spark, "backlog")
    backlog.write_backlog(spark.range(0, 100, 1, 50), folder, 30)
    sizes = [r[0] for r in spark.read.parquet(folder).groupBy("_metadata.file_path").agg(F.count("*")).select("count(1)").collect()]
    assert sum(sizes) == 100 and max(sizes) <= 30 and len(sizes) <= 8


def test_an_empty_queue_has_no_steps(spark):
    folder = work_folder(spark, "steps")
    assert backlog.queue_length(spark, f"{folder}/queue") == 0
    backlog.write_queue(spark.range(0), f"{folder}/queue", ["id"])
    never = lambda batch: 1 / 0
    backlog.step_stream(spark, f"{folder}/queue", never, f"{folder}/done", f"{folder}/checkpoint", MirrorConfig(), drain=True)
    for size in (0, 101):
        with pytest.raises(ValueError):
            MirrorConfig(batch_size=size)
