"""Types and shapes of structured data (JSON-LD), read as VARIANT values.

Blocks are cut out, unescaped, parsed, filtered and taken apart by Spark expressions
alone; ``structured`` is needed only where blocks are printed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorleaf.config import MirrorConfig
from mirrorleaf.functions.text import as_col, bind
from mirrorleaf.operators.structured import LD_JSON, raw_blocks

GRAPH, TYPE = "$['@graph']", "$['@type']"
NAMED = {"amp": 38, "lt": 60, "gt": 62, "quot": 34, "apos": 39}
REFERENCE = rf"^(#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{'|'.join(NAMED)});"


def _code(name: Column) -> Column:
    """Code point of a reference's name, null if it has none."""
    number = F.when(
        F.lower(F.substring(name, 1, 2)) == "#x", F.conv(F.substr(name, F.lit(3)), 16, 10)
    ).when(name.startswith("#"), F.substr(name, F.lit(2)))
    code = number.try_cast("int")
    for known, value in NAMED.items():
        code = F.when(name == known, F.lit(value)).otherwise(code)
    return F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), code)


def unescaped(text: Column | str) -> Column:
    """Text with its numeric references and those of XML replaced; others stay."""

    def piece(part: Column) -> Column:
        def replaced(name: Column) -> Column:
            utf32 = F.unhex(F.lpad(F.hex(_code(name)), 8, "0"))
            rest = F.substr(part, F.length(name) + 2)
            return F.coalesce(F.concat(F.decode(utf32, "UTF-32"), rest), F.concat(F.lit("&"), part))

        return bind(F.regexp_extract(part, REFERENCE, 1), replaced)

    text = as_col(text)
    pieces = F.split(text, "&")
    whole = F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), piece), ""))
    return F.when(F.contains(text, F.lit("&")), whole).otherwise(text)


def type_names(item: Column) -> Column:
    """Names in an item's type, which is one string or a list; anything else has none."""
    found = F.try_variant_get(item, TYPE, "variant")
    listed = F.coalesce(F.try_variant_get(found, "$", "array<variant>"), F.array(found))
    strings = F.filter(listed, lambda t: F.schema_of_variant(t) == "STRING")
    return F.filter(F.transform(strings, lambda t: F.try_variant_get(t, "$", "string")), lambda t: t != "")


def kept_items(block: Column, cfg: MirrorConfig) -> Column:
    """Items of a parsed block whose types aren't ignored, the one that holds a graph first.

    A block whose graph has nothing left has no items, nor has one that is no JSON.
    """
    ignored = F.array(*[F.lit(t) for t in cfg.ignored_types]) if cfg.ignored_types else F.array().cast("array<string>")
    keep = lambda items: F.filter(items, lambda item: ~F.arrays_overlap(type_names(item), ignored))
    graph = F.coalesce(
        F.try_variant_get(block, GRAPH, "array<variant>"), F.map_values(F.try_variant_get(block, GRAPH, "map<string,variant>"))
    )
    left = keep(graph)
    held = F.when(F.size(left) > 0, F.concat(F.array(block), left)).otherwise(F.array().cast("array<variant>"))
    alone = F.coalesce(F.try_variant_get(block, "$", "array<variant>"), F.array(block))
    return F.when(block.isNotNull(), F.when(graph.isNotNull(), held).otherwise(keep(alone)))


def typed_items(pages: DataFrame, cfg: MirrorConfig) -> DataFrame:
    """One row per item and type: (page_id, type, item), the item as a VARIANT.

    Rows without a block, or without JSON in it, give none. A JSON text that names a key
    of an object twice is no JSON here.
    """
    holding = pages.where(F.contains(F.lower("html"), F.lit(LD_JSON)))
    blocks = holding.select("page_id", F.explode(raw_blocks("html")).alias("raw"))
    parsed = blocks.select("page_id", F.try_parse_json(F.btrim(unescaped("raw"), F.lit(" \t\n\r\x0b\0"))).alias("block"))
    items = parsed.where(F.col("block").isNotNull()).select("page_id", F.explode(kept_items(F.col("block"), cfg)).alias("item"))
    return items.select("page_id", F.explode(F.array_distinct(type_names(F.col("item")))).alias("type"), "item")


def structured_types(pages: DataFrame, cfg: MirrorConfig) -> DataFrame:
    """The types that each page declares: (page_id, type), each once."""
    return typed_items(pages, cfg).select("page_id", "type").distinct()


def structured_schemas(pages: DataFrame, cfg: MirrorConfig) -> DataFrame:
    """What items of each type look like over all pages: (type, items, schema).

    Where two items disagree on the type of a field, it is VARIANT. Schemas are merged
    before the shuffle, so a type that most pages have moves one row per task.
    """
    return typed_items(pages, cfg).groupBy("type").agg(
        F.count(F.lit(1)).alias("items"), F.schema_of_variant_agg("item").alias("schema")
    )
