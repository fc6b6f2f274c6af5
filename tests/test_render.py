"""One small page per rendering rule."""

import time
from collections.abc import Iterator

import pandas as pd
import pytest
from pyspark.sql import functions as F

from mirrorleaf.config import MirrorConfig
from mirrorleaf.operators.html_fold import fold
from mirrorleaf.operators.render import choose_html, clean_html, render_markdown, to_markdown
from mirrorleaf.sources.pages import EMPTY_BODY, EMPTY_TEXT, has_text, normalize_pages
from tests.conftest import column

GOLDEN = {
    # text
    "a \t b\n  c": "a b\n c",
    "0": "0",
    "1 &lt; 2 &amp;&#33;&copy;": "1 < 2 &!©",
    "x?a=1&copy=2": "x?a=1&copy=2",
    # headings, paragraphs, containers
    "a<h2> T </h2>b": "a\n\n## T\n\nb",
    "<h1></h1><h6>x</h6>": "###### x",
    "<p> a </p><p></p><p>b</p>": "a\n\nb",
    "<div>a<section>b</section></div>c": "a\n\nb\n\nc",
    "<details><summary>s</summary>d</details>": "s\n\nd",
    # breaks and rules
    "a  <br>b": "a  \nb",
    "a<hr/>b": "a\n\n---\n\nb",
    # emphasis keeps its inner spaces
    "<b> x </b>": "** x **",
    "a<strong></strong>b": "a****b",
    "<em>x</em><i>y</i>": "*x**y*",
    # links
    '<a href="/u"> t </a>': "[t](/u)",
    "<a>t</a>": "t",
    '<a href="/u"> </a>x': "x",
    '<a title="a>b" href=/u?a=1&amp;b=2>t</a>': "[t](/u?a=1&b=2)",
    # images
    'a<img src="/x.png" alt="q">b': "a\n\n![q](https://s.example/x.png)\n\nb",
    '<img src="//c/x.png">': "![](//c/x.png)",
    '<img src="http://c/x.png">': "![](http://c/x.png)",
    '<img src="data:image/png;base64,AA">': "![](https://s.example/data:image/png;base64,AA)",
    "<img alt=x>y": "y",
    # lists
    "<ul><li>a</li><li>b</li></ul>": "- a\n- b",
    '<ol start="5"><li>a<li>b</ol>': "1. a\n2. b",
    "<ul><li>a<ul><li>b<ol><li>c</ol></ul><li>d</ul>": "- a\n  - b\n    1. c\n- d",
    "<ul>text<p>no</p><li>a\n\n  b</li><br></ul>": "- a b",
    "<ul><li>a<div><ul><li>b</li></ul></div></li></ul>": "- a\n\n- b",
    # only the inside of an item's direct children counts
    '<ul><li><b>x</b> <a href="/u">t</a><img src="i"></li></ul>': "- x t",
    "<ul><li><p><b>x</b></p></li></ul>": "- **x**",
    "<ul></ul>a": "a",
    "<li>alone</li>": "alone",
    # quotes and code
    "<blockquote>a<br>b</blockquote>": "> a  \n> b",
    "<blockquote><p>a</p><p>b</p></blockquote>c": "> a\n> \n> b\n\nc",
    '<pre><code class="x language-py">a &lt; b\n  c</code></pre>': "```py\na < b\n  c\n```",
    "<pre>a  b</pre>": "```\na  b\n```",
    "use <code>a  b</code>": "use `a  b`",
    # tables
    "<table><thead><tr><th>a<th>b</thead><tr><td>1</table>": "| a | b |\n| --- | --- |\n| 1 |  |",
    "<table><tr><td>1<td>2<tr><td>3</table>": "| 1 | 2 |\n| --- | --- |\n| 3 |  |",
    "<table><tbody><tr><td>1</td></tr><tr><th>h</th></tr></tbody></table>": "| 1 |\n| h |\n| --- |",
    "<table><tr><th>a</th></tr><tr><th>b</th></tr></table>": "| a |\n| --- |\n| b |",
    "<table><tr><td>a|b</td></tr></table>": "| a|b |\n| --- |",
    "<table><tr></tr></table>x": "x",
    "<table><tr><td><b>x</b> y</td></tr></table>": "| **x** y |\n| --- |",
    "<table><tbody><tr><td><table><tbody><tr><td>i</td></tr></tbody></table></td></tr></tbody></table>":
        "| | i |\n| --- |\n| --- | |\n| i |",
    # pass-through and dropped elements
    "<span>a</span><mark>b</mark><x-tag>c</x-tag>": "abc",
    "a<nav>b</nav><form>c<p>d</p></form><svg><text>e</text></svg>f": "af",
    "a<header>b</header><aside>c</aside><footer>d": "a",
    "a<script>if (a<b) x()</script><style>p{}</style><noscript>n</noscript><!-- c -->b": "ab",
    "<SCRIPT type='x'>1</Script>a<!-- <p>b</p> -->": "a",
    # body selection
    "<html><head><title>t</title></head><body><p>a</p></body></html>": "a",
    "<title>t</title><p>a": "t\n\na",
    # recovery of unclosed and stray tags
    "<p>a<p>b": "a\n\nb",
    "<p><b>a<p>b": "**a**\n\nb",
    "<p><b>a<h2>t</h2>": "**a**\n\n## t",
    "a</b></p></div>b": "ab",
    "<div><b>a</div>b": "**a**\n\nb",
    "<p>a</b>b</p>c": "ab\n\nc",
    "1 < 2 and <3": "1 < 2 and <3",
    # line ends and blank lines
    "a\r\nb\rc": "a\nb\nc",
    "a\n\n\n\nb": "a\n\nb",
    "\x0b a  ": "a  ",
    '<nav>n</nav><!-- ad --><div class="ad">A.</div><article><h1>T.</h1><p><b>T.<br></article><footer>f</footer>':
        "A.\n\n# T.\n\n**T.  \n**",
}


def test_golden(spark):
    pages = spark.createDataFrame(
        [(i, html, "https://s.example/") for i, html in enumerate(GOLDEN)], "i int, html string, home_url string"
    )
    rendered = dict(render_markdown(pages).select("i", "markdown").collect())
    wrong = {html: rendered[i] for i, html in enumerate(GOLDEN) if rendered[i] != GOLDEN[html]}
    assert wrong == {}


def test_deep_nesting_and_long_pages():
    assert fold("<div>" * 20_000 + "x" + "</div>" * 20_000).strip() == "x"
    assert fold("<b>" * 5_000 + "x").count("**") == 10_000
    assert fold("<p>word</p>" * 50_000).count("word") == 50_000


def test_null_and_empty(spark):
    df = spark.createDataFrame([(None,), ("",), (" \n ",)], "html string")
    assert column(df.select(to_markdown("html", F.lit(None).cast("string")).alias("m")), "m") == ["", "", ""]


def test_invariants_on_test_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").withColumn("home_url", F.lit(""))
    h1 = F.regexp_extract("html", r"(?s)<h1>\s*([^<]*?)\s*</h1>", 1)
    rendered = render_markdown(pages).select("markdown", "html", h1.alias("h1"))
    for row in rendered.collect():
        headings = [line for line in row.markdown.split("\n") if line.startswith("# ")]
        assert headings[0][2:] == fold(row.h1).strip()
        assert "\n\n\n" not in row.markdown
        assert "track(" not in row.markdown and "©" not in row.markdown


def test_fold_runs_once_per_page(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").withColumn("home_url", F.lit(""))
    kept = render_markdown(pages).where(F.col("markdown") != "").select("page_id", F.length("markdown"))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [_fold") == 1
    # a result without Markdown does not render at all
    plan = render_markdown(pages).select("page_id")._jdf.queryExecution().executedPlan().toString()
    assert "_fold" not in plan and "html" not in plan


@pytest.mark.parametrize(
    "html, expected",
    [
        ("x", True), ("", False), ("<p> </p>", False), ("<img src=x>", False), ("<body></body>", False),
        ("<title>t</title><body><p>\n</p>", False), ("<title>t</title><body> x", True), ("< 3", True),
        ("<script>x</script>", False), ("<body><noscript>x</noscript>", True), ("<!-- x -->", False),
    ],
)
def test_has_text(spark, html, expected):
    df = spark.createDataFrame([(html,)], "html string")
    assert df.select(has_text("html").alias("t")).first().t is expected


def test_page_reasons(spark):
    df = spark.createDataFrame(
        [(1, "u", None), (2, "u", ""), (3, "u", "<body><p></p>"), (4, "u", "<body>x")], "page_id int, url string, html string"
    )
    assert column(normalize_pages(df).orderBy("page_id"), "reason") == [EMPTY_BODY, EMPTY_BODY, EMPTY_TEXT, None]


def test_choose_html(spark):
    posts = spark.createDataFrame(
        [(1, "u1", "own"), (2, "u2", "<p></p>"), (3, "u3", None)], "post_id int, permalink string, body string"
    )
    pages = spark.createDataFrame(
        [(7, "u1", "<p>page 1"), (8, "u2", "old"), (9, "u2", "new"), (10, "u3", "<br>")], "page_id int, url string, html string"
    )
    pick = lambda method: [
        r.html for r in choose_html(posts, pages, MirrorConfig(content_method=method)).orderBy("post_id").collect()
    ]
    assert pick("filter") == ["own", "<p></p>", None]
    assert pick("both") == ["own", "new", ""]
    assert pick("http") == ["<p>page 1", "new", ""]


def test_clean_html_keeps_other_text(spark):
    df = spark.createDataFrame([("a<style>x</style><b>c</b>\r<scriptlike>z",)], "h string")
    assert df.select(clean_html("h").alias("c")).first().c == "a<b>c</b>\n<scriptlike>z"


@pytest.mark.parametrize("page", [
    "<font>" * 60_000 + "<p>x" * 160_000,
    "<ul><li>x" * 110_000,
    "<table><tr><td>" * 65_000,
    "<p><li>" + "<b>" * 500 + "<div>x</div>" * 80_000,
    "<div>" * 100_000 + "text " * 100_000,
    "<i><div>" + "<b>" * 400 + "</i>" * 250_000,
])
def test_a_page_of_a_megabyte_takes_seconds(page):
    start = time.process_time()
    fold(page)
    assert time.process_time() - start < 5


def test_text_below_the_greatest_depth_stays():
    deep = "<div>" * 2000 + "a<p>b</p>c" + "</div>" * 2000 + "<p>after"
    assert [x for x in fold(deep).split() if x] == ["a", "b", "c", "after"]


def test_workers_get_batches_of_bounded_size(spark):
    """Of long texts far fewer rows come at once than the limit of rows allows."""
    from mirrorleaf.plans import generate
    from mirrorleaf.session import BATCH

    @F.pandas_udf("bigint")
    def characters(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([int(texts.str.len().sum())] * len(texts))

    before = spark.conf.get(BATCH, None)
    spark.conf.unset(BATCH)
    try:
        texts = F.repeat(F.lit("x"), 100_000)
        pages = spark.range(0, 300, 1, 1).select(F.col("id").alias("page_id"), F.lit("https://h.e/a").alias("url"), texts.alias("html"))
        generate.page_outcomes(pages, MirrorConfig())
        assert pages.select(characters("html").alias("n")).agg(F.max("n")).first()[0] <= 8 << 20
    finally:
        spark.conf.unset(BATCH) if before is None else spark.conf.set(BATCH, before)
