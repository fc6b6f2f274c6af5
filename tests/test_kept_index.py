"""An index kept up to date against one that is built anew."""

import random

import pytest
from pyspark.sql import functions as F

from mirrorleaf.plans import kept_index, site_docs
from mirrorleaf.session import work_folder

DOCS = "site string, path string, title string, url string, bytes bigint"


def frame(spark, docs):
    return spark.createDataFrame([(*key, *value) for key, value in docs.items()], DOCS)


def changes_of(spark, changes):
    rows = [(*key, *(value or (None, None, None)), value is None) for key, value in changes.items()]
    return spark.createDataFrame(rows, f"{DOCS}, is_deleted boolean")


def expected(docs):
    out, n, upto, last = [], 0, 0, None
    for (site, path), (title, url, size) in sorted(docs.items()):
        n, upto = (n + 1, upto + size) if site == last else (1, size)
        last = site
        out.append((site, path, title, url, size, n, upto))
    return out


def found(spark, folder):
    return sorted(tuple(r) for r in kept_index.numbered(spark, folder).collect())


@pytest.fixture
def hundred(spark):
    docs = {(f"s{k % 3}" if k % 5 else "s1", f"p{k:03d}é"): (f"t{k}", f"u{k}", k) for k in range(100)}
    folder = work_folder(spark, "kept")
    kept_index.build_index(frame(spark, docs), folder, range_rows=10)
    assert found(spark, folder) == expected(docs)
    return docs, folder


def test_a_change_rewrites_its_range_only(spark, hundred):
    docs, folder = hundred
    files = lambda: {r[0] for r in spark.read.parquet(f"{folder}/entries").select("_metadata.file_path").distinct().collect()}
    ranges, before = kept_index._manifest(spark, folder).count(), files()
    assert ranges >= 8
    key = ("s1", "p050é")
    change = {key: ("new", "u", 7)}
    assert kept_index.update_index(spark, folder, changes_of(spark, change), 10) == 1
    assert len(files() - before) == 1
    assert found(spark, folder) == expected(docs | change)
    # the same once more, and a deletion of something that isn't there
    assert kept_index.update_index(spark, folder, changes_of(spark, change | {("s1", "p051x"): None}), 10) == 1
    assert found(spark, folder) == expected(docs | change)
    assert kept_index._manifest(spark, folder).count() == ranges
    assert kept_index.update_index(spark, folder, changes_of(spark, {}), 10) == 0


def test_random_changes(spark, hundred):
    docs, folder = hundred
    rnd = random.Random(3)
    for _ in range(3):
        changes = {}
        for _ in range(30):
            key = rnd.choice([*docs, (f"s{rnd.randrange(5)}", f"p{rnd.randrange(200):03d}"), ("a", "first"), ("z", "last")])
            changes[key] = None if rnd.random() < 0.4 else ("t", "u", rnd.randrange(9))
        kept_index.update_index(spark, folder, changes_of(spark, changes), 10)
        docs = {k: v for k, v in (docs | changes).items() if v is not None}
        assert found(spark, folder) == expected(docs)


def test_ranges_split_and_vanish(spark, hundred):
    docs, folder = hundred
    more = {("s1", f"p050-{k:03d}"): ("t", "u", 1) for k in range(60)}
    ranges = kept_index._manifest(spark, folder).count()
    assert kept_index.update_index(spark, folder, changes_of(spark, more), 10) == 1
    assert found(spark, folder) == expected(docs | more)
    sizes = spark.read.parquet(f"{folder}/totals").join(kept_index._manifest(spark, folder), ["range", "version"]).groupBy("range").agg(F.sum("n").alias("n"))
    assert max(r.n for r in sizes.collect()) <= 20 and kept_index._manifest(spark, folder).count() >= ranges + 5
    kept_index.update_index(spark, folder, changes_of(spark, dict.fromkeys({**docs, **more})), 10)
    assert found(spark, folder) == [] and kept_index._manifest(spark, folder).count() == 0
    again = {("s9", "x"): ("t", "u", 4)}
    kept_index.update_index(spark, folder, changes_of(spark, again), 10)
    assert found(spark, folder) == expected(again)


def test_lines_and_shards_equal_a_rebuilt_index(spark, hundred):
    docs, folder = hundred
    change = {("s0", "p003é"): None, ("s0", "a"): ("A", "ua", 500), ("s2", "zz"): ("Z", "uz", 90)}
    kept_index.update_index(spark, folder, changes_of(spark, change), 10)
    now = frame(spark, {k: v for k, v in (docs | change).items() if v is not None})
    sites = spark.createDataFrame([(f"s{k}", f"Site {k}") for k in range(3)], "site string, name string")
    rebuilt = site_docs.site_index(now, sites, "2024-01-01 00:00:00")
    lines = site_docs.index_lines(kept_index.numbered(spark, folder), sites, "2024-01-01 00:00:00")
    assert sorted(map(tuple, lines.collect())) == sorted(map(tuple, rebuilt.collect()))
    shards = {(r.site, r.path): r.shard for r in site_docs.shards(kept_index.numbered(spark, folder), 300).collect()}
    assert shards == {row[:2]: row[6] // 300 for row in expected({k: v for k, v in (docs | change).items() if v is not None})}


def test_small_ranges_share_files(spark):
    """Two hundred ranges are no two hundred folders, neither at first nor after a change of all."""
    docs = {("s", f"p{k:04d}"): (f"t{k}", f"u{k}", k) for k in range(1000)}
    folder = work_folder(spark, "kept")
    files = lambda: spark.read.parquet(f"{folder}/entries").select("_metadata.file_path").distinct().count()
    kept_index.build_index(frame(spark, docs), folder, range_rows=5)
    assert kept_index._manifest(spark, folder).count() == 200 and files() <= 8
    docs = {key: ("new", "u", 1) for key in docs}
    assert kept_index.update_index(spark, folder, changes_of(spark, docs), 5) == 200
    assert found(spark, folder) == expected(docs) and files() <= 16


def test_an_empty_mirror(spark):
    folder = work_folder(spark, "kept")
    kept_index.build_index(frame(spark, {("a", "b"): ("t", "u", 1)}).limit(0), folder)
    assert found(spark, folder) == []
