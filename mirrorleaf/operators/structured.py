"""Structured data (JSON-LD) published inside pages.

Script blocks are cut out by a Spark expression; only pages that hold one send
their blocks, not their HTML, to Python for JSON filtering and printing. The
blocks of a page stay an array in its row, so nothing is shuffled.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from mirrorleaf.config import MirrorConfig
from mirrorleaf.functions.text import as_col, bind, rtrim_ws
from mirrorleaf.operators.html_fold import WS, decode

# ---- fixed values: what marks structured data, and the heading it gets -------
LD_JSON = "application/ld+json"
SECTION_TITLE = "JSON Schema"
# ------------------------------------------------------------------------------
ELEMENT = r"(?is)<script\b([^>]*)>(.*?)</script\s*>"
TYPE = r"""(?is)(?:^|\s)type\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
SECTION = f"\n\n## {SECTION_TITLE}\n\n"
BLOCKS = ArrayType(
    StructType([StructField("json", StringType()), StructField("types", StringType())])
)


def _types(item) -> list[str]:
    found = item.get("@type") if isinstance(item, dict) else None
    found = found if isinstance(found, list) else [found]
    return [t for t in found if isinstance(t, str) and t]


def _without_ignored(data, ignored: frozenset[str]):
    """The block without items of an ignored type; None if nothing is left."""
    keep = lambda item: not ignored.intersection(_types(item))
    graph = data.get("@graph") if isinstance(data, dict) else None
    if isinstance(graph, (list, dict)):
        members = graph.values() if isinstance(graph, dict) else graph
        kept = [item for item in members if keep(item)]
        return {**data, "@graph": kept} if kept else None
    if isinstance(data, list):
        data = [item for item in data if keep(item)]
    return data if data and keep(data) else None


def _no_constant(name: str):
    raise ValueError(name)


def normalize_block(raw: str, ignored: frozenset[str]) -> tuple[str, str] | None:
    """(pretty JSON, its types) of one script block; invalid JSON stays as it is."""
    text = decode(raw).strip(WS)
    if not text:
        return None
    try:
        data = json.loads(text, parse_constant=_no_constant)
    except (ValueError, RecursionError):
        return text, ""
    data = _without_ignored(data, ignored)
    if data is None:
        return None
    members = data if isinstance(data, list) else [data]
    if isinstance(data, dict) and "@graph" in data:
        members = [data, *data["@graph"]]
    types = dict.fromkeys(t for item in members for t in _types(item))
    return json.dumps(data, indent=4, ensure_ascii=False), ",".join(types)


def _normalizer(ignored: frozenset[str]):
    @F.pandas_udf(BLOCKS)
    def normalize(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for rows in batches:
            out = []
            for blocks in rows:
                found = (normalize_block(b, ignored) for b in (() if blocks is None else blocks))
                out.append([{"json": f[0], "types": f[1]} for f in found if f])
            yield pd.Series(out, dtype=object)

    return normalize


def _media_type(attributes: Column) -> Column:
    """Media type that an element's ``type`` attribute names, without parameters."""
    value = F.concat(*[F.regexp_extract(attributes, TYPE, group) for group in (1, 2, 3)])
    return F.lower(F.btrim(F.substring_index(value, ";", 1), F.lit(" \t\n\r")))


def raw_blocks(html: Column | str) -> Column:
    """What stands in a page's structured-data elements, in page order; null if there is none."""
    html = as_col(html)
    scripts = F.arrays_zip(
        F.regexp_extract_all(html, F.lit(ELEMENT), 1).alias("attributes"),
        F.regexp_extract_all(html, F.lit(ELEMENT), 2).alias("inside"),
    )
    own = F.transform(F.filter(scripts, lambda s: _media_type(s["attributes"]) == LD_JSON), lambda s: s["inside"])
    return F.when(F.contains(F.lower(html), F.lit(LD_JSON)), own)


def structured_blocks(html: Column | str, cfg: MirrorConfig) -> Column:
    """Distinct blocks of a page, first occurrence first."""
    return F.array_distinct(_normalizer(frozenset(cfg.ignored_types))(raw_blocks(html)))


def structured_data(pages: DataFrame, cfg: MirrorConfig) -> DataFrame:
    """One row per block: (page_id, seq, json, types)."""
    holding = pages.where(F.contains(F.lower("html"), F.lit(LD_JSON)))
    blocks = holding.select("page_id", F.posexplode(structured_blocks("html", cfg)).alias("seq", "block"))
    return blocks.select("page_id", "seq", "block.json", "block.types")


def append_structured(markdown: Column | str, html: Column | str, cfg: MirrorConfig) -> Column:
    """Markdown with the page's blocks behind it, where the settings ask for them."""
    markdown = as_col(markdown)
    if not cfg.appends_structured_data:
        return markdown
    fence = lambda b: F.concat(F.lit("```json\n"), b["json"], F.lit("\n```\n\n"))

    def appended(blocks: Column) -> Column:
        section = F.concat(rtrim_ws(markdown), F.lit(SECTION), F.array_join(F.transform(blocks, fence), ""))
        return F.when(F.size(blocks) > 0, section).otherwise(markdown)

    return bind(structured_blocks(html, cfg), appended)
