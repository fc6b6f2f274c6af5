"""What a run works through."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorleaf.config import MirrorConfig
from mirrorleaf.functions.urls import url_host
from mirrorleaf.operators.entities import active_authors, nonempty_terms, union_all
from mirrorleaf.operators.filters import allowed_types, published
from mirrorleaf.sources.sitemaps import expand_sitemaps, root_sitemaps

# Order of the kinds in a run.
RANKS = {"homepage": 0, "post": 1, "term": 2, "author": 3, "sitemap_url": 4}


def _items(df: DataFrame, kind: str, item_id: str, taxonomy: str | None, url: str) -> DataFrame:
    return df.select(
        url_host(url).alias("site"),
        F.lit(kind).alias("kind"),
        F.col(item_id).cast("bigint").alias("id") if item_id else F.lit(0).cast("bigint").alias("id"),
        (F.col(taxonomy) if taxonomy else F.lit(None).cast("string")).alias("taxonomy"),
        F.lit(None).cast("string").alias("url"),
        F.lit(RANKS[kind]).alias("kind_rank"),
        F.array(F.col(item_id).cast("bigint") if item_id else F.lit(0).cast("bigint")).alias("ord"),
    )


def content_items(
    posts: DataFrame,
    post_terms: DataFrame,
    terms: DataFrame,
    authors: DataFrame,
    sites: DataFrame,
    cfg: MirrorConfig,
) -> DataFrame:
    """Homepage, published posts of allowed types, terms and authors in use.

    Process in the order of ``(kind_rank, ord)``.
    """
    parts = [
        _items(sites, "homepage", "", None, "home_url"),
        _items(allowed_types(published(posts), cfg), "post", "post_id", None, "permalink"),
    ]
    if cfg.include_taxonomies:
        parts.append(_items(nonempty_terms(terms, post_terms), "term", "term_id", "taxonomy", "url"))
    if cfg.include_authors:
        parts.append(_items(active_authors(authors, posts), "author", "author_id", None, "url"))
    return union_all(parts)


def sitemap_items(sites: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """Queue of the sites that publish a sitemap."""
    urls = expand_sitemaps(sitemaps, root_sitemaps(sites, sitemaps))
    return urls.select(
        "site",
        F.lit("sitemap_url").alias("kind"),
        F.lit(0).cast("bigint").alias("id"),
        F.lit(None).cast("string").alias("taxonomy"),
        "url",
        F.lit(RANKS["sitemap_url"]).alias("kind_rank"),
        "ord",
    )


def build_queue(items: DataFrame, sites: DataFrame, sitemaps: DataFrame, cfg: MirrorConfig) -> DataFrame:
    """Work list per site: its sitemap if it has one and settings ask for it, else all items."""
    if cfg.source == "all":
        return items
    with_sitemap = root_sitemaps(sites, sitemaps).select("site")
    others = items.join(with_sitemap, "site", "left_anti")
    return sitemap_items(sites, sitemaps).unionByName(others)
