"""URLs, titles, front matter, encoding repair, structured data, payloads."""

import base64
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mirrorleaf.config import MirrorConfig
from mirrorleaf.functions import text as T
from mirrorleaf.functions import urls as U
from mirrorleaf.functions.encoding import repair_text
from mirrorleaf.functions.front_matter import front_matter, yaml_escape
from mirrorleaf.operators.payload import decode_payload, render_page
from mirrorleaf.operators.render import to_markdown
from mirrorleaf.operators.structured import append_structured, normalize_block
from tests.conftest import column


def values(spark, items, expression):
    df = spark.createDataFrame([(i, item) for i, item in enumerate(items)], "i int, x string")
    return column(df.withColumn("y", expression("x")).orderBy("i"), "y")


PATHS = {
    "https://example.com/about/team/": "about/team/index.md",
    "https://example.com": "index.md",
    "https://example.com/?p=1": "index.md",
    "https://e.com/a.html?x#y": "a/index.md",
    "https://e.com/a.PHP": "a/index.md",
    "https://e.com/a.html/": "a/index.md",
    "https://e.com/.html": "index.md",
    "https://e.com/a/../b/./%2e%2E/c": "a/b/c/index.md",
    "https://e.com/a%2Fb/%5c/c": "c/index.md",
    "https://e.com/a%252Fb": "a%252Fb/index.md",
    "https://e.com/%zz/a b/+": "%zz/a b/+/index.md",
    "https://e.com/a\\b": "a/b/index.md",
    "https://e.com/\x01/a\x02b": "ab/index.md",
    "https://e.com/0/": "0/index.md",
    "/rel/x.htm?q=/y": "rel/x/index.md",
    "//e.com/x": "x/index.md",
}


def test_path_key(spark):
    assert values(spark, PATHS, U.path_key) == list(PATHS.values())


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="/.%2eEfF5cC\\ab?#\x01\t:+", max_size=25), min_size=20, max_size=60))
def test_path_key_is_always_safe(spark, tails):
    for key in values(spark, ["https://h.example/" + t for t in tails], U.path_key):
        segments = key.split("/")
        assert key.endswith("index.md") and not key.startswith("/")
        assert "" not in segments and ".." not in segments
        assert not any(ord(c) < 32 for c in key) and "\\" not in key


def test_control_characters_hide_no_unsafe_segment(spark):
    urls = ["https://h.e/..\t", "https://h.e/a/.\x01./b", "https://h.e/a/%2\te/b", "https://h.e/a\tb/c"]
    assert values(spark, urls, U.path_key) == ["index.md", "a/b/index.md", "a/b/index.md", "ab/c/index.md"]


def test_hosts_and_exclusion(spark):
    hosts = {"HTTP://A.Example:80/x": "a.example", "https://u@h.e/": "h.e", "/x": "", "mailto:x": "", "//H/x": "h"}
    assert values(spark, hosts, U.url_host) == list(hosts.values())
    cfg = MirrorConfig(exclude_urls=" /es/ \n\n.+\n")
    urls = ["https://h/es/1", "https://h/cart", "https://h/Cart", "https://h/?u=/feed", "https://h/abc", "https://h/a.+b"]
    assert values(spark, urls, lambda c: U.is_excluded(c, cfg)) == [True, True, False, True, False, True]
    same = values(spark, ["http://H.e:9/x", "https://g.e", "/x"], lambda c: U.on_same_site(c, F.lit("https://h.E/")))
    assert same == [True, False, False]


def test_slug_titles(spark):
    urls = ["https://h/a/my-long_pAge/?x=1", "https://h/", "https://h/éa-b", "https://h/a<b>c"]
    assert values(spark, urls, lambda c: U.slug_title(c, "A")) == ["?x=1", "H", "éa B", "A<b>c"]
    assert values(spark, urls, lambda c: U.slug_title(c, "B", F.lit("site"))) == ["My Long PAge", "Site", "éa B", "Ac"]


def test_site_key(spark):
    df = spark.createDataFrame(
        [("Example.com", "/Blog/", 3), ("e.com", "/", 1), (None, None, 4)], "d string, p string, b int"
    )
    keys = column(df.orderBy("b").select(U.site_key("d", "p", "b").alias("k")), "k")
    assert keys == ["sites/1-e-com/", "sites/3-example-com-blog/", "sites/4-site-4/"]
    assert df.select(U.site_key("d", "p", None).alias("k")).first().k == ""


def test_read_back(spark):
    docs = {
        '---\ntitle: "A"\nurl: "u"\n---\n\n# B': ("A", "u"),
        '---\ntitle: "A \\" b"\n---\n': ("A \\", "#"),
        "x\n#  H1 \n# H2": ("H1", "#"),
        "## H2\nx": ("Untitled", "#"),
        " ---\ntitle: \"A\"": ("Untitled", "#"),
    }
    assert values(spark, docs, T.title_of) == [v[0] for v in docs.values()]
    assert values(spark, docs, T.url_of) == [v[1] for v in docs.values()]


def test_yaml_and_front_matter(spark):
    assert values(spark, ['a "b"\r\n<i>c</i> ', "<script>x</script>y"], yaml_escape) == ['a \\"b\\" c', "y"]
    df = spark.createDataFrame(
        [('T "x"', "u", ["b", 'c"'], None)], "title string, url string, categories array<string>, tags array<string>"
    )
    made = front_matter(
        "post", title="title", url="url", type=F.lit("post"), author=F.lit(""), categories="categories", tags="tags"
    )
    assert df.select(made.alias("f")).first().f == (
        '---\ntitle: "T \\"x\\""\nurl: "u"\ntype: "post"\ncategories: ["b", "c\\""]\n---\n\n'
    )
    with pytest.raises(ValueError):
        front_matter("term", bio=F.lit("x"))


def test_excerpt(spark):
    texts = ["<b>a</b> b\n c  d", "a b c", ""]
    assert values(spark, texts, lambda c: T.excerpt(None, c, 3, "...")) == ["a b c...", "a b c", ""]


def broken(text):
    return text.encode().decode("cp1250")


CLEAN = [
    "Příliš žluťoučký kůň úpěl ďábelské ódy", "für Ähre und Öl, Straße", "été, garçon, naïve", "mañana, niño, ¿qué?",
    "plain", "", "Ä", "Â Ă Ĺ", "漢字 Ä",
]


def test_repair_leaves_clean_text_alone(spark):
    assert values(spark, CLEAN, repair_text) == CLEAN


def test_repair_undoes_a_wrong_reading(spark):
    texts = ["český příspěvek", "Žluť", "für Öl", "été"]
    repaired = values(spark, [broken(t) for t in texts], repair_text)
    assert repaired == texts
    assert values(spark, repaired, repair_text) == texts  # a second pass changes nothing


def test_repair_refuses_lossy_text(spark):
    texts = [broken("été") + " 漢", broken("é") + " ü", "Ă\u0088"]
    assert values(spark, texts, repair_text) == texts


def test_invalid_bytes_are_read_as_windows_1250(spark):
    df = spark.createDataFrame([(bytearray("čaj".encode("cp1250")),)], "b binary")
    assert df.select(repair_text(F.col("b").cast("string")).alias("t")).first().t == "čaj"


IGNORED = frozenset(("BreadcrumbList",))
BLOCKS = [
    ('{"@type":"Article","a":{}}', ('{\n    "@type": "Article",\n    "a": {}\n}', "Article")),
    ('{"@type":"BreadcrumbList"}', None),
    ('{"@type":["WebPage","BreadcrumbList"]}', None),
    ('{"@graph":[{"@type":"BreadcrumbList"}]}', None),
    ('[{"@type":"BreadcrumbList"},{"@type":"A"}]', ('[\n    {\n        "@type": "A"\n    }\n]', "A")),
    ("[]", None), ("{}", None), ("  ", None),
    ('{"a": oops}', ('{"a": oops}', "")), ('{"a": NaN}', ('{"a": NaN}', "")),
    ('{&quot;b&quot;:"ž/"}', ('{\n    "b": "ž/"\n}', "")),
]


@pytest.mark.parametrize("raw, expected", BLOCKS)
def test_structured_block(raw, expected):
    assert normalize_block(raw, IGNORED) == expected


def test_structured_section(spark):
    page = (
        "<script type=\"application/ld+json\">{\"a\":1}</script><SCRIPT id=x type='application/ld+json'>\n{\"a\":1} </SCRIPT>"
        "<script type=application/ld+json>{\"b\":2}</script><script type='text/javascript'>{}</script>"
    )
    df = spark.createDataFrame([(page, "text \n"), ("<p>", "none ")], "html string, md string")
    on = MirrorConfig(append_json_schema=True, content_method="http")
    section = '\n\n## JSON Schema\n\n```json\n{\n    "a": 1\n}\n```\n\n```json\n{\n    "b": 2\n}\n```\n\n'
    assert column(df.select(append_structured("md", "html", on).alias("m")), "m") == ["text" + section, "none "]
    for off in (MirrorConfig(append_json_schema=True), MirrorConfig(content_method="http")):
        assert column(df.select(append_structured("md", "html", off).alias("m")), "m") == ["text \n", "none "]


def serialized(value):
    if isinstance(value, dict):
        inner = "".join(serialized(k) + serialized(v) for k, v in value.items())
        return f"a:{len(value)}:{{{inner}}}"
    if isinstance(value, bool):
        return f"b:{int(value)};"
    if isinstance(value, int):
        return f"i:{value};"
    if isinstance(value, float):
        return f"d:{value};"
    if value is None:
        return "N;"
    return f's:{len(value.encode())}:"{value}";'


def encoded(value):
    return base64.b64encode(serialized(value).encode()).decode()


COPY = {
    "id": 7, "size": 1.5, "on": True, "none": None, "color": "#fff000", "heading": "Náš <b>nadpis</b>",
    "items": {0: {"text": 'with "; quotes', "title": "#abc"}, 1: {"content": "https://x.example/"}, 2: {"name": "12.5%"}},
    "caption": "<svg x>", "link_text": "  Náš <b>nadpis</b> ", "popup_text": "ab", "description": "last",
}


def test_payload_copy():
    assert decode_payload(encoded(COPY)) == 'Náš <b>nadpis</b>\n\nwith "; quotes\n\nlast'
    assert decode_payload("'" + encoded(COPY).replace("+", "-").replace("/", "_") + "' ") != ""


@pytest.mark.parametrize(
    "payload",
    [
        "short", base64.b64encode(b"plain text that is long enough to look like one").decode(),
        base64.b64encode(b'O:8:"stdClass":1:{s:4:"text";s:20:"never build objects!";}').decode(),
        base64.b64encode(b'a:1:{s:4:"text";s:99:"length does not match the data";}').decode(),
        base64.b64encode(b's:40:"a string on its own is no array, so no";').decode(), encoded(COPY)[:-3] + "*",
    ],
)
def test_payload_refused(payload):
    assert decode_payload(payload) == ""


def test_payload_in_page(spark):
    nested = {"content": "<p>inner " + encoded(COPY) + "</p>", "x": "y" * 80}
    pages = [f"<h1>T</h1><div>{encoded(COPY)}</div>", f"<div>{encoded(nested)}</div>", "<p>" + "a" * 130 + "</p>", "x"]
    body = 'Náš **nadpis**\n\nwith "; quotes\n\nlast'
    got = values(spark, pages, lambda c: to_markdown(c, F.lit("")))
    assert got == [f"# T\n\n{body}", f"inner {body}", "a" * 130, "x"]
    assert render_page("<p>nothing</p>", "").strip() == "nothing"


def test_json_in_scripts_does_not_reach_markdown(spark):
    html = f"<script type='application/ld+json'>{json.dumps({'a': 1})}</script><p>x</p>"
    assert values(spark, [html], lambda c: to_markdown(c, F.lit(""))) == ["x"]
