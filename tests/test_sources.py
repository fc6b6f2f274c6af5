"""Sitemaps, queue, mirror table, trees of files."""

import glob
import gzip

import pytest
from pyspark.sql import functions as F

from mirrorleaf.config import ALWAYS_EXCLUDED, MirrorConfig
from mirrorleaf.plans.queue import build_queue
from mirrorleaf.session import work_folder
from mirrorleaf.sources import store
from mirrorleaf.sources.sitemaps import NAMESPACE, expand_sitemaps, root_sitemaps, sitemap_urls
from tests.conftest import column

HEAD = '<?xml version="1.0" encoding="UTF-8"?>'


def urlset(*urls):
    inner = "".join(f"<url><loc>{u}</loc><lastmod>2024</lastmod></url>" for u in urls)
    return f'{HEAD}<urlset xmlns="{NAMESPACE}">{inner}</urlset>'


def index(*urls):
    inner = "".join(f"<sitemap><loc>{u}</loc></sitemap>" for u in urls)
    return f'{HEAD}<sitemapindex xmlns="{NAMESPACE}">{inner}</sitemapindex>'


SITEMAPS = [
    ("https://h.e/wp-sitemap.xml", index("https://h.e/a.xml", "https://H.e/b.xml", "https://g.e/c.xml", "https://h.e/bad.xml")),
    ("https://h.e/a.xml", urlset("https://h.e/1", "https://h.e/2?a=1&amp;b=2", "https://g.e/3", "/4")),
    ("https://H.e/b.xml", index("https://h.e/wp-sitemap.xml", "https://h.e/d.xml", "https://h.e/a.xml")),
    ("https://h.e/d.xml", urlset("https://h.e/5")),
    ("https://g.e/c.xml", urlset("https://h.e/6")),
    ("https://h.e/bad.xml", f'<urlset xmlns="{NAMESPACE}"><url><loc>https://h.e/7</loc>'),
    ("https://i.e/sitemap_index.xml", urlset("https://i.e/8")),
    ("https://i.e/plain.xml", "<urlset><url><loc>https://i.e/9</loc></url></urlset>"),
]
SITES = [("h.e", "https://h.e/"), ("i.e", "https://i.e/"), ("j.e", "https://j.e/")]


def tables(spark):
    sitemaps = spark.createDataFrame(SITEMAPS, "sitemap_url string, xml string")
    return spark.createDataFrame(SITES, "site string, home_url string"), sitemaps


def test_sitemap_urls(spark):
    _, sitemaps = tables(spark)
    got = sorted(column(sitemap_urls(sitemaps), "url"))
    assert got == ["/4", "https://g.e/3", "https://h.e/1", "https://h.e/2?a=1&b=2", "https://h.e/5", "https://h.e/6", "https://i.e/8"]


def test_expand_follows_own_site_and_ends_cycles(spark):
    sites, sitemaps = tables(spark)
    roots = root_sitemaps(sites, sitemaps)
    assert sorted(map(tuple, roots.select("site", "sitemap_url").collect())) == [
        ("h.e", "https://h.e/wp-sitemap.xml"), ("i.e", "https://i.e/sitemap_index.xml"),
    ]
    got = expand_sitemaps(sitemaps, roots).select("site", "url")
    assert sorted(map(tuple, got.collect())) == [
        ("h.e", "https://h.e/1"), ("h.e", "https://h.e/2?a=1&b=2"), ("h.e", "https://h.e/5"), ("i.e", "https://i.e/8"),
    ]
    # a.xml is listed again behind d.xml: the later position counts
    ordered = expand_sitemaps(sitemaps, roots).where("site = 'h.e'").orderBy("ord").collect()
    assert [r.url for r in ordered] == ["https://h.e/5", "https://h.e/1", "https://h.e/2?a=1&b=2"]


def test_expand_goes_to_any_depth(spark):
    """A chain of twelve indexes that lists itself, a shared child and a prefixed document."""
    name = lambda k: f"https://h.e/i{k}.xml"
    rows = [("https://h.e/wp-sitemap.xml", index(name(0), "https://h.e/shared.xml"))]
    rows += [(name(k), index(name(k + 1), name(max(0, k - 3)), f"https://h.e/u{k}.xml", "https://h.e/shared.xml")) for k in range(12)]
    rows += [(f"https://h.e/u{k}.xml", urlset(f"https://h.e/{k}")) for k in range(12)]
    rows += [("https://h.e/shared.xml", urlset("https://h.e/s"))]
    prefixed = f"<x.y:urlset xmlns:x.y='{NAMESPACE}'><x.y:url><x.y:loc>https://h.e/p</x.y:loc></x.y:url></x.y:urlset>"
    rows += [(name(12), prefixed)]
    sitemaps = spark.createDataFrame(rows, "sitemap_url string, xml string")
    sites = spark.createDataFrame(SITES[:1], "site string, home_url string")
    got = expand_sitemaps(sitemaps, root_sitemaps(sites, sitemaps)).orderBy("ord").collect()
    assert [r.url for r in got] == ["https://h.e/p", *(f"https://h.e/{k}" for k in reversed(range(12))), "https://h.e/s"]


def test_queue_falls_back_per_site(spark):
    sites, sitemaps = tables(spark)
    items = spark.createDataFrame(
        [(s, "homepage", 0, None, None, 0, [0]) for s, _ in SITES],
        "site string, kind string, id bigint, taxonomy string, url string, kind_rank int, ord array<bigint>",
    )
    got = build_queue(items, sites, sitemaps, MirrorConfig())
    kinds = {(r.site, r.kind) for r in got.collect()}
    assert kinds == {("h.e", "sitemap_url"), ("i.e", "sitemap_url"), ("j.e", "homepage")}
    assert build_queue(items, sites, sitemaps, MirrorConfig(source="all")).count() == 3


def versions(spark, rows):
    full = [
        (site, path, "u", "post", post, "t", "f", text, 1, ts, seq, gone) for site, path, post, text, ts, seq, gone in rows
    ]
    return spark.createDataFrame(full, store.SCHEMA.replace("version_ts timestamp_ntz", "version_ts string")).withColumn(
        "version_ts", F.col("version_ts").cast("timestamp_ntz")
    )


def test_current_versions(spark):
    day = lambda d: f"2024-01-{d:02d} 00:00:00"
    rows = versions(
        spark,
        [
            ("s", "a", 1, "old", day(1), 1, False), ("s", "a", 1, "new", day(2), 1, False),
            ("s", "a", 1, "new", day(2), 1, False),  # a replay
            ("s", "b", 2, "kept", day(1), 1, False), ("s", "c", 3, "gone", day(1), 1, False),
            ("s", "c", 3, "", day(1), 2, True),  # same time, later change
            ("s", "d", 4, "moved away", day(1), 1, False), ("s", "e", 4, "moved", day(2), 1, False),
            ("s", "e", 5, "took over", day(3), 1, False),  # another post at that path
            ("s", "g", None, "page", day(1), 1, False), ("s", "h", None, "page 2", day(1), 1, False),
            ("t", "a", 1, "other site", day(1), 1, False),
        ],
    )
    got = {(r.site, r.path): r.markdown for r in store.current(rows).collect()}
    assert got == {
        ("s", "a"): "new", ("s", "b"): "kept", ("s", "e"): "took over", ("s", "g"): "page", ("s", "h"): "page 2",
        ("t", "a"): "other site",
    }


def test_mirror_write_read_compact(spark):
    rows = versions(
        spark,
        [("s", f"p{i}/index.md", i, "x", f"2024-01-0{1 + i % 3} 00:00:00", 1, i == 3) for i in range(20)]
        + [("t", "_sitemap.md", None, "x", "2024-01-01", 1, False)],
    )
    folder = work_folder(spark, "mirror")
    store.write_mirror(rows, folder)
    documents = store.scan_mirror(spark, folder)
    assert documents.count() == 19
    assert store.changed_since(spark, folder, "2024-01-02 00:00:00").count() == 6
    assert {r.bytes for r in documents.collect()} == {2}
    store.write_mirror(versions(spark, [("s", "p1/index.md", 1, "x", "2024-01-02 00:00:00", 1, False)]), folder)  # a replay
    assert store.scan_mirror(spark, folder).count() == 19
    store.compact_mirror(spark, folder, folder + "-compact")
    assert store.read_versions(spark, folder + "-compact").count() == 19
    assert store.read_versions(spark, folder, "t").count() == 1


def test_scan_tree(spark, tmp_path):
    files = {
        "index.md": '---\ntitle: "Home"\nurl: "https://h/"\n---\n\n# x', "a b/c+d/index.md": "# Head\n", "a/x.MD": "none",
        "_sitemap.md": "# s", "a/_all.md": "# s", "a/notes.txt": "no",
    }
    for name, text in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    got = {r.path: (r.title, r.url) for r in store.scan_tree(spark, str(tmp_path)).collect()}
    assert got == {"index.md": ("Home", "https://h/"), "a b/c+d/index.md": ("Head", "#"), "a/x.MD": ("Untitled", "#")}


def test_a_tree_of_many_small_files_takes_few_tasks(spark, tmp_path):
    for k in range(300):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "index.md").write_text(f"# {k}")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4m")  # no more than one file's opening cost
    before = spark.conf.get(store.LISTING)
    try:
        tree = store.scan_tree(spark, str(tmp_path))
        assert tree.rdd.getNumPartitions() <= 64
        assert sorted(int(r.title) for r in tree.collect()) == list(range(300))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert spark.conf.get(store.LISTING) == before


def test_files_of_a_tree_are_written_by_many_tasks(spark):
    """Few bytes are no reason to write all files in one task."""
    from workload import queries as workload

    folders = lambda: set(glob.glob(f"{spark.sparkContext.getConf().get('spark.checkpoint.dir')}/tree-*"))
    before = folders()
    assert workload.QUERIES["scan_tree"](spark, "/root/testdata/sf0.001").count() > 8
    [made] = folders() - before
    tasks = {name.split("part-")[1][:5] for name in glob.glob(f"{made}/*/part-*.txt")}
    assert len(tasks) > 1


def read_as_text(root):
    return {f.split("/")[-2]: open(f, "rb").read() for f in glob.glob(f"{root}/*/part-*.txt")}


def test_a_written_tree_is_that_of_sparks_writer(spark, tmp_path, monkeypatch):
    """Files made by the tasks themselves hold what Spark's writer would put there."""
    rows = [(k, f"# {k}\r\nÄ \u2028 {k}") for k in range(40)] + [(7, "# 7\r\nÄ \u2028 7"), (41, None), (42, ""), (None, "none"), (-3, "below")]
    documents = spark.createDataFrame(rows, "id bigint, value string")
    odd = spark.sql("SELECT 50L AS id, cast(X'23FF0A' AS string) AS value")  # no UTF-8
    documents = documents.union(odd).repartition(3)
    store.write_tree(documents, f"{tmp_path}/own", "id")
    monkeypatch.setattr(store, "local_folder", lambda *_: None)
    store.write_tree(documents, f"{tmp_path}/spark", "id")
    own = read_as_text(f"{tmp_path}/own")
    assert own == read_as_text(f"{tmp_path}/spark") and len(own) == 45
    read = lambda name: sorted((r.path.split("/")[0], r.title, r.document) for r in store.scan_tree(spark, f"{tmp_path}/{name}", "*.txt").collect())
    assert read("own") == read("spark") and len(read("own")) == 45
    assert not glob.glob(f"{tmp_path}/own/**/.*", recursive=True)


def test_a_tree_is_read_as_bytes_unless_names_may_be_packed(spark, tmp_path):
    (tmp_path / "a.md").write_bytes(b"# a \xff\n")
    (tmp_path / "empty.md").write_bytes(b"")
    (tmp_path / "b.md.gz").write_bytes(gzip.compress(b"# b\n"))
    titles = lambda names: sorted((r.path, r.title) for r in store.scan_tree(spark, str(tmp_path), names).collect())
    assert [store.may_be_packed(n) for n in ("*.[mM][dD]", "*.txt", "*", "*.*", "*.gz", "*.m?", "*.{md,gz}", "*.[gm][dz]")] == [False] * 2 + [True] * 6
    plan = lambda names: store.scan_tree(spark, str(tmp_path), names)._jdf.queryExecution().toString()
    assert "binaryFile" in plan("*.md") and "binaryFile" not in plan("*")
    assert titles("*.md") == [(p, t) for p, t in titles("*") if p.endswith(".md")]
    assert ("b.md.gz", "b") in titles("*.gz") and ("b.md.gz", "b") in titles("*")
    assert titles("*.none.md") == []


def test_config_bounds():
    for delay in (0, 31):
        with pytest.raises(ValueError):
            MirrorConfig(batch_delay=delay)
    cfg = MirrorConfig(exclude_urls=" a \n\n b")
    assert cfg.exclusions == ("a", "b", *ALWAYS_EXCLUDED)
    assert not MirrorConfig(append_json_schema=True).appends_structured_data


def test_post_sitemaps_are_bounded_and_list_all(spark):
    """A hot site is a tree of small documents."""
    from workload.queries import post_sitemaps

    rows = [("hot.e" if k % 10 else "b.e", k, f"https://{'hot.e' if k % 10 else 'b.e'}/{k}/") for k in [*range(-30, 300), 5_000]]
    posts = spark.createDataFrame(rows, "site string, post_id bigint, permalink string")
    maps = post_sitemaps(posts, fan_out=5)
    assert max(r.xml.count("<s:loc>") for r in maps.collect()) <= 5
    roots = spark.createDataFrame([(s, f"https://{s}/", f"https://{s}/wp-sitemap.xml") for s in ("hot.e", "b.e")], "site string, home_url string, sitemap_url string")
    found = sorted((r.site, r.url) for r in expand_sitemaps(maps, roots).collect())
    assert found == sorted((s, f"{p}?from=map") for s, _, p in rows)
    assert post_sitemaps(posts.limit(0)).count() == 0
