"""Site documents as text, archives, outcomes."""

import glob

from pyspark.sql import functions as F

from mirrorleaf.config import MirrorConfig
from mirrorleaf.operators.stats import run_status
from mirrorleaf.plans import archives, generate, site_docs
from mirrorleaf.session import work_folder
from mirrorleaf.sources.store import document
from tests.conftest import column
from workload import queries as workload
from workload.views import view

SF = "/root/testdata/sf0.001"
POST = (
    "post_id bigint, permalink string, title string, post_type string, post_status string, author_id int, menu_order int, "
    "parent_id bigint, published_on string, body string, author string, categories array<string>, tags array<string>, "
    "featured_image string"
)


def post(i, **changes):
    base = dict(
        post_id=i, permalink=f"https://h.e/p{i}/", title=f"T{i}", post_type="post", post_status="publish", author_id=1,
        menu_order=0, parent_id=0, published_on="2024-01-02", body=f"<p>Body {i}</p>", author="A", categories=[], tags=["x"],
        featured_image=None,
    )
    return tuple({**base, **changes}.values())


def posts_of(spark, *rows):
    return spark.createDataFrame(list(rows), POST)


def pages_of(spark, *rows):
    return spark.createDataFrame(list(rows), "page_id bigint, url string, html string")


SITE = ("h.e", "https://h.e/", "Name", "Desc", "cs")
SITE_SCHEMA = "site string, home_url string, name string, description string, language string"


def test_post_outcomes(spark):
    posts = posts_of(
        spark, post(1), post(2, post_status="draft"), post(3, post_type="product"), post(4, permalink="https://h.e/cart/4"),
        post(5, body="<p> </p>"), post(6, body="<br>"), post(7, title='q"', body="a\n\n\n\nb", tags=None),
    )
    pages = pages_of(spark, (1, "https://h.e/p6/", "<body><h1>Page</h1>"))
    done = {r.item_id: r for r in generate.post_outcomes(posts, pages, MirrorConfig()).collect()}
    assert {i: r.reason for i, r in done.items()} == {
        1: None, 2: "Post not found or not published.", 3: "Post type 'product' is not allowed in settings.",
        4: "URL is excluded by rules.", 5: "Rendered content is empty (tried method: both).", 6: None, 7: None,
    }
    assert done[1].front_matter + done[1].markdown == (
        '---\ntitle: "T1"\nurl: "https://h.e/p1/"\ntype: "post"\ndate: "2024-01-02"\nauthor: "A"\nexcerpt: "Body 1"\n'
        'tags: ["x"]\n---\n\nBody 1'
    )
    assert (done[6].markdown, done[7].markdown, done[7].path) == ("# Page", "a\n\nb", "p7/index.md")
    assert done[7].title == "q\\"  # read back as the index does
    bare = generate.post_outcomes(posts, pages, MirrorConfig(frontmatter=False, post_types=())).collect()
    assert {r.item_id: r.front_matter for r in bare}[1] == "" and {r.item_id: r.reason for r in bare}[3] is None


def test_generic_pages_and_the_exclusion_switch(spark):
    pages = pages_of(
        spark, (1, "https://h.e/cart/x", "<p>a"), (2, "https://h.e/b-c.html", "<body><img src=/i>"), (3, "https://h.e/d", "<nav>n</nav>")
    )
    reasons = column(generate.page_outcomes(pages, MirrorConfig()).orderBy("item_id"), "reason")
    assert reasons == [
        "URL is excluded by rules.", "HTTP Fetch succeeded, but content extraction (<body>) resulted in empty text.",
        "Markdown conversion resulted in empty content for URL: https://h.e/d",
    ]
    loose = generate.page_outcomes(pages, MirrorConfig(exclude_generic=False), variant="A").orderBy("item_id").first()
    assert loose.reason is None and loose.front_matter == '---\ntitle: "X"\nurl: "https://h.e/cart/x"\ntype: "sitemap_page"\n---\n\n'


def test_structured_data_of_posts(spark):
    page = '<head><script type="application/ld+json">{"a":1}</script></head><body>p'
    cfg = MirrorConfig(content_method="http", append_json_schema=True)
    done = generate.post_outcomes(posts_of(spark, post(1)), pages_of(spark, (1, "https://h.e/p1/", page)), cfg).first()
    assert done.markdown == 'p\n\n## JSON Schema\n\n```json\n{\n    "a": 1\n}\n```\n\n'


def test_run_status_of_unfinished_run(spark):
    queue = spark.createDataFrame([("r",)] * 3 + [("q",)], "run_id string")
    log = spark.createDataFrame([("r", True, "a"), ("r", False, "b")], "run_id string, ok boolean, ts string")
    got = {r.run_id: tuple(r)[1:] for r in run_status(queue, log).collect()}
    assert got == {"r": (3, 2, 1, "a", None), "q": (1, 0, 0, None, None)}


def test_archives_without_posts(spark):
    cfg = MirrorConfig()
    terms = spark.createDataFrame(
        [(1, "category", "N", "", "https://h.e/cart"), (2, "category", "M", "<p>d</p>", "https://h.e/c/m/")],
        "term_id int, taxonomy string, name string, description string, url string",
    )
    bridge = spark.createDataFrame([(1, 2), (2, 2)], "post_id bigint, term_id int")
    posts = posts_of(spark, post(1), post(2, post_status="draft"))
    docs = generate.archive_outcomes(archives.term_archives(terms, posts, bridge, cfg), "term", cfg)
    done = {r.item_id: r for r in docs.collect()}
    assert done[1].markdown == "# N\n\n" and done[1].reason == "Term URL is excluded by rules."
    assert done[2].markdown == "# M\n\nd\n\n## Příspěvky\n\n- [T1](https://h.e/p1/)\n"
    assert "post_count: 1\n" in done[2].front_matter and done[2].path == "c/m/index.md"


def written(folder, pattern):
    files = sorted(glob.glob(f"{folder}/bucket=*/{pattern}/part-*"))
    return "".join(open(f, encoding="utf-8", newline="").read() for f in files)


def test_index_and_export_files(spark):
    sites = view(spark, SF, "sites")
    mirror = workload.page_mirror(spark, SF)
    site = mirror.groupBy("site").count().orderBy(F.desc("count")).first().site
    documents = sorted(
        (r.path, r.title, r.url, r.doc)
        for r in mirror.where(F.col("site") == site).select("path", "title", "url", document().alias("doc")).collect()
    )
    folder = work_folder(spark, "index")
    site_docs.write_lines(site_docs.site_index(mirror, sites, workload.RUN_TS, parts=7), folder, ["seq"])
    expected = f"# Sitemap — Site {site}\n\nGenerated: {workload.RUN_TS}\n\n"
    expected += "".join(f"- [{t}]({u}) — `{p}`\n" for p, t, u, _ in documents)
    assert written(folder, f"site={site}") == expected

    folder = work_folder(spark, "export")
    export = site_docs.full_export(mirror, sites, workload.RUN_TS, shard_bytes=3000, parts=7)
    site_docs.write_export(export, folder)
    expected = f"# Complete Content — Site {site}\n\nGenerated: {workload.RUN_TS}\nTotal pages: {len(documents)}\n\n---\n\n"
    expected += "".join(f"<!-- Source: {p} -->\n\n{d}\n\n---\n\n" for p, _, _, d in documents)
    shards = sorted(int(f.rsplit("=", 1)[1]) for f in glob.glob(f"{folder}/bucket=*/site={site}/shard=*"))
    assert len(shards) > 2
    assert "".join(written(folder, f"site={site}/shard={n}") for n in shards) == expected


def test_documents_after_a_run(spark):
    posts = posts_of(spark, post(1, menu_order=2, body="a\n"), post(2, menu_order=1), post(3, post_status="draft"))
    sites = spark.createDataFrame([SITE], SITE_SCHEMA)
    mirror = generate.mirror_rows(generate.post_outcomes(posts, pages_of(spark), MirrorConfig()), workload.RUN_TS)
    folder = work_folder(spark, "site")
    site_docs.write_site_documents(mirror, sites, posts, MirrorConfig(), workload.RUN_TS, folder)
    assert written(f"{folder}/index", "site=h.e").endswith(
        "- [T1](https://h.e/p1/) — `p1/index.md`\n- [T2](https://h.e/p2/) — `p2/index.md`\n"
    )
    assert "Total pages: 2" in written(f"{folder}/full", "site=h.e/shard=0")
    assert written(f"{folder}/summary", "site=h.e").startswith("# Name\n\n> Desc\n")

    folder = work_folder(spark, "site")
    cfg = MirrorConfig(generate_export=False)
    site_docs.write_site_documents(mirror, sites, posts, cfg, workload.RUN_TS, folder)
    assert written(f"{folder}/full", "site=h.e") == (
        f"# Name — Full Content\n\nGenerated: {workload.RUN_TS}\n\n---\n\n"
        "## T2\n\nURL: https://h.e/p2/\nType: post\n\nBody 2\n\n---\n\n"
        "## T1\n\nURL: https://h.e/p1/\nType: post\n\na\n\n---\n\n"
    )


def test_summary_text(spark):
    posts = posts_of(
        spark,
        post(1, post_type="page", menu_order=2, permalink="https://h.e/b/?x=1", body="[gallery ids=1]One " + "w " * 30),
        post(2, post_type="page", menu_order=1), post(3, post_type="page", parent_id=1), post(4), post(5, published_on="2024-03-01"),
        post(6, post_status="draft"),
    )
    sites = spark.createDataFrame([SITE], SITE_SCHEMA)
    lines = site_docs.site_summary(posts, sites, MirrorConfig(), parts=3)
    text = "\n".join(r.line for r in lines.orderBy("site", "section_rank", "seq").collect())
    assert text == f"""# Name

> Desc

## About

Website: https://h.e/
Language: cs

## Main Sections

- [T2](https://h.e/p2/?format=markdown): Body 2
- [T1](https://h.e/b/?x=1&format=markdown): One {"w " * 19}...

## Recent Posts

- [T5](https://h.e/p5/?format=markdown) (2024-03-01)
- [T4](https://h.e/p4/?format=markdown) (2024-01-02)

## Content Types


## Resources

- [Full Markdown Content](https://h.e/llms-full.txt): Complete site content in markdown
- [Sitemap](https://h.e/?format=markdown): Homepage / sitemap in markdown format
- [XML Sitemap](https://h.e/wp-sitemap.xml): Standard XML sitemap

## Access

Any page on this site can be retrieved as Markdown by:
1. Adding `?format=markdown` to any URL
2. Sending `Accept: text/markdown` in the HTTP request headers""".replace("w ...", "w...")
