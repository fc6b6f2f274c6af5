"""Types of structured data as VARIANT values, against the printer's own rules."""

import html
import json

import pytest
from pyspark.sql import functions as F

from mirrorleaf.config import MirrorConfig
from mirrorleaf.operators.structured import structured_data
from mirrorleaf.operators.typed_data import structured_schemas, structured_types, typed_items, unescaped
from workload.views import view

CFG = MirrorConfig(content_method="http", append_json_schema=True)
BLOCKS = [
    {"@type": "Article"}, {"@type": ["A", "B", "A", "", 3, None]}, {"@type": "BreadcrumbList"}, {"@type": ["A", "BreadcrumbList"]},
    [{"@type": "A"}, {"@type": "BreadcrumbList"}, "text", 4, None, []], [{"@type": "BreadcrumbList"}], {}, [], 5, "A", None, True,
    {"@graph": [{"@type": "BreadcrumbList"}], "@type": "Lost"}, {"@graph": [{"@type": "C"}, {"@type": "BreadcrumbList"}], "@type": "Top"},
    {"@graph": {"x": {"@type": "D"}, "y": {"@type": "BreadcrumbList"}}}, {"@graph": [], "@type": "None left"}, {"@graph": "text", "@type": "E"},
    {"@type": {"@type": "inner"}}, {"@type": "a&b <c> é \U0001f600"},
]


def page(number, *raw):
    scripts = "".join(f'<script type="application/ld+json">{r}</script>' for r in raw)
    return number, f"<html><head>{scripts}</head><body><p>x</p></body></html>"


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, html string")


@pytest.mark.parametrize("escape", [str, html.escape], ids=["plain", "escaped"])
def test_types_equal_those_of_the_printed_blocks(spark, escape):
    rows = [page(k, escape(json.dumps(b, ensure_ascii=k % 2 == 0))) for k, b in enumerate(BLOCKS)]
    rows += [page(100, *(escape(json.dumps(b)) for b in BLOCKS)), page(101, "{oops}"), page(102), (103, None), (104, "")]
    pages = pages_of(spark, rows)
    printed = structured_data(pages, CFG).select("page_id", F.explode(F.split("types", ",")).alias("type")).where("type <> ''")
    expected = {(r.page_id, r.type) for r in printed.collect()}
    found = [(r.page_id, r.type) for r in structured_types(pages, CFG).collect()]
    assert len(found) == len(set(found)) and set(found) == expected and len(expected) > 15


def test_settings_name_the_ignored_types(spark):
    pages = pages_of(spark, [page(1, '{"@type":"A"}', '{"@type":"BreadcrumbList"}')])
    types = lambda ignored: {r.type for r in structured_types(pages, MirrorConfig(ignored_types=ignored)).collect()}
    assert types(()) == {"A", "BreadcrumbList"} and types(("A",)) == {"BreadcrumbList"}


def test_schemas_merge_over_pages(spark):
    pages = pages_of(spark, [page(1, '{"@type":"A","n":1}'), page(2, '{"@type":"A","n":"x","u":[1]}'), page(3, '{"@type":"B"}')])
    found = {r.type: (r["items"], r.schema) for r in structured_schemas(pages, CFG).collect()}
    assert found["A"] == (2, "OBJECT<`@type`: STRING, n: VARIANT, u: ARRAY<BIGINT>>") and found["B"][0] == 1


def test_references(spark):
    texts = ["a&amp;b", "&lt;&#33;&#x1F600;&gt;", "&", "&&amp;", "&#0;&#55296;&#9999999;&nbsp;&amp", "none", "", None, "&amp;lt;", "&QUOT;&#X41;"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(unescaped("t")).collect()
    assert [r[0] for r in rows] == [
        "a&b", "<!\U0001f600>", "&", "&&", "&#0;&#55296;&#9999999;&nbsp;&amp", "none", "", None, "&lt;", "&QUOT;A",
    ]


def test_empty_table_and_plan(spark):
    pages = view(spark, "/root/testdata/sf0.001", "linked_pages")
    assert structured_types(pages.limit(0), CFG).count() == 0 and structured_schemas(pages.limit(0), CFG).count() == 0
    plan = typed_items(pages, CFG)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
