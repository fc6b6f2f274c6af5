"""Requests for Markdown: who asks for it, and what must be made for them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorleaf.config import MARKDOWN_TYPES, MirrorConfig
from mirrorleaf.functions.text import as_col
from mirrorleaf.functions.urls import path_key, url_host, url_path
from mirrorleaf.operators.entities import resolve_targets
from mirrorleaf.plans.regenerate import Tables, log_of, store_outcomes, target, target_outcomes
from mirrorleaf.session import folder_exists, persist_table
from mirrorleaf.sources.store import SCHEMA, scan_mirror


def wants_markdown(uri: Column | str, accept: Column | str) -> Column:
    """Asked for by the Accept header or by ``format=markdown`` (the last one counts)."""
    header = F.lower(F.coalesce(as_col(accept), F.lit("")))
    by_header = reduce(lambda a, b: a | b, [F.contains(header, F.lit(t)) for t in MARKDOWN_TYPES])
    asked = F.regexp_extract(as_col(uri), r"^[^#]*[?&]format=([^&#]*)", 1)
    return by_header | (asked == "markdown")


def without_format(url: Column | str) -> Column:
    """URL without its ``format`` parameter."""
    cut = F.regexp_replace(as_col(url), r"(?<=[?&])format=[^&#]*&?", "")
    return F.regexp_replace(cut, r"[?&](?=#|\z)", "")


def classify_requests(requests: DataFrame) -> DataFrame:
    """Adds wants_markdown, the document key (site, path) and the page URL."""
    return (
        requests.withColumn("wants_markdown", wants_markdown("uri", "accept"))
        .withColumn("site", url_host("uri"))
        .withColumn("path", path_key("uri"))
        .withColumn("url", without_format("uri"))
    )


def served_by_site(uri: Column | str) -> Column:
    """Requests for the index or the full export of a site, not for a page."""
    return F.regexp_extract(url_path(uri), r"(?:\A/*|/)(_sitemap|_all)", 1) != ""


def lookup(requests: DataFrame, mirror: DataFrame) -> DataFrame:
    """Distinct wanted keys without a document, one URL each.

    A document may lie at ``<path>/index.md`` or at ``<path>.md``. Keys are made
    distinct first: a page asked for millions of times is looked up once.
    """
    wanted = classify_requests(requests).where("wants_markdown").where(~served_by_site("uri"))
    keys = wanted.groupBy("site", "path").agg(F.min("url").alias("url"))
    beside = F.concat(F.regexp_replace("path", r"/?index\.md\z", ""), F.lit(".md"))
    forms = keys.select("site", F.col("path").alias("_key"), F.explode(F.array("path", beside)).alias("path"))
    held = forms.join(mirror.select("site", "path"), ["site", "path"], "left_semi").select("site", F.col("_key").alias("path"))
    return keys.join(held, ["site", "path"], "left_anti")


def fill_targets(requests: DataFrame, mirror: DataFrame, tables: Tables, cfg: MirrorConfig) -> DataFrame:
    """What each missing key resolves to: a post, a homepage, a term or a page.

    Ready for ``target_outcomes``; the order of the keys decides between documents that
    fall on one path.
    """
    wanted = lookup(requests, mirror).select("url")
    found = resolve_targets(wanted, tables.listed, tables.terms if cfg.include_taxonomies else None, tables.sites)
    return found.drop("path").select(
        F.lit("request").alias("item_kind"),
        F.lit(0).cast("bigint").alias("item_id"),
        F.col("url").alias("label"),
        F.lit(0).alias("kind_rank"),
        F.array("url").alias("ord"),
        "kind",
        "target_id",
        "site",
        "url",
        target(F.col("kind"), F.col("target_id"), F.col("site"), F.col("url")).alias("target"),
    )


def fill_missing(
    spark: SparkSession,
    requests: DataFrame,
    mirror_path: str,
    tables: Tables,
    cfg: MirrorConfig,
    run_id: str,
    run_ts,
) -> DataFrame:
    """Make what is asked for and missing, add it to the mirror, and log every key.

    Keys without a document are misses: their log line carries the reason.
    """
    held = scan_mirror(spark, mirror_path) if folder_exists(spark, mirror_path) else spark.createDataFrame([], SCHEMA)
    targets = persist_table(spark, fill_targets(requests, held, tables, cfg), "targets")
    outcomes = target_outcomes(targets, tables, cfg, page_kind="archive", variant="B")
    stored = store_outcomes(spark, targets, outcomes, run_ts, mirror_path)
    return log_of(targets, stored, run_id, run_ts)
