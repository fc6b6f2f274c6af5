"""Joins between posts, terms, authors, media, sites and URLs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorleaf.functions.urls import match_path, path_key, url_host, url_path, with_slash
from mirrorleaf.operators.filters import published


def nonempty_terms(terms: DataFrame, post_terms: DataFrame) -> DataFrame:
    """Terms that at least one post carries."""
    return terms.join(post_terms.select("term_id").distinct(), "term_id", "left_semi")


def active_authors(authors: DataFrame, posts: DataFrame) -> DataFrame:
    """Authors of at least one published post."""
    return authors.join(published(posts).select("author_id").distinct(), "author_id", "left_semi")


def term_counts(post_terms: DataFrame) -> DataFrame:
    return post_terms.groupBy("term_id").agg(F.count(F.lit(1)).alias("post_count"))


def term_members(posts: DataFrame, post_terms: DataFrame) -> DataFrame:
    """Published posts of each term; joined on the post, so a huge term is no hot key."""
    return published(posts).join(post_terms, "post_id")


def author_members(posts: DataFrame, authors: DataFrame) -> DataFrame:
    """Published posts of known authors."""
    return published(posts).join(authors.select("author_id"), "author_id", "left_semi")


def enrich(
    posts: DataFrame, authors: DataFrame, post_terms: DataFrame, terms: DataFrame, media: DataFrame
) -> DataFrame:
    """Adds author name, category and tag names (by name) and the image URL.

    Everything is gathered per post id on narrow rows first, so a busy author is
    no hot key for post bodies, and those are shuffled once at most.
    """

    def sorted_names(taxonomy: str) -> Column:
        of_kind = F.when(F.col("taxonomy") == taxonomy, F.struct("name", "term_id"))
        return F.transform(F.array_sort(F.collect_list(of_kind)), lambda t: t["name"])

    names = (
        post_terms.join(terms.select("term_id", "taxonomy", "name"), "term_id")
        .groupBy("post_id")
        .agg(sorted_names("category").alias("categories"), sorted_names("post_tag").alias("tags"))
    )
    image = media.groupBy("post_id").agg(F.min("image_url").alias("featured_image"))
    gathered = (
        posts.select("post_id", "author_id")
        .join(authors.select("author_id", F.col("display_name").alias("author")), "author_id", "left")
        .drop("author_id")
        .join(names, "post_id", "left")
        .join(image, "post_id", "left")
    )
    return posts.join(gathered, "post_id", "left")


def _matchable(terms: DataFrame) -> DataFrame:
    """First term of each archive address."""
    return terms.groupBy(url_host("url").alias("_host"), match_path("url").alias("_match")).agg(
        F.min_by(
            F.struct("term_id", "taxonomy"), F.struct("taxonomy", "term_id")
        ).alias("_term")
    )


def match_terms(urls: DataFrame, terms: DataFrame) -> DataFrame:
    """URLs that are term archives: same host and path, query and last slash aside."""
    keyed = urls.withColumn("_host", url_host("url")).withColumn("_match", match_path("url"))
    return (
        keyed.join(_matchable(terms), ["_host", "_match"])
        .withColumn("term_id", F.col("_term.term_id"))
        .withColumn("taxonomy", F.col("_term.taxonomy"))
        .drop("_host", "_match", "_term")
    )


def resolve_targets(
    urls: DataFrame, posts: DataFrame, terms: DataFrame | None, sites: DataFrame
) -> DataFrame:
    """Adds ``site``, ``path``, ``kind`` and ``target_id``: post, else homepage, else term, else generic.

    Pass ``terms=None`` for queued URLs, which never resolve to a term. Every
    lookup table holds one row per key, so no URL is multiplied; home addresses are
    matched whole, so no key is as hot as a host.
    """
    keyed = urls.withColumn("site", url_host("url")).withColumn("path", path_key("url"))
    by_path = posts.groupBy(
        url_host("permalink").alias("site"), path_key("permalink").alias("path")
    ).agg(F.min("post_id").alias("_post"))
    homes = sites.select(with_slash("home_url").alias("_home")).distinct()
    found = keyed.join(by_path, ["site", "path"], "left").join(homes, with_slash("url") == F.col("_home"), "left")
    if terms is not None:
        found = (
            found.withColumn("_match", match_path("url"))
            .join(_matchable(terms).withColumnRenamed("_host", "site"), ["site", "_match"], "left")
            .drop("_match")
        )
        term_id = F.col("_term.term_id").cast("bigint")
    else:
        term_id = F.lit(None).cast("bigint")
    kind = (
        F.when(F.col("_post").isNotNull(), "post")
        .when(F.col("_home").isNotNull(), "homepage")
        .when(term_id.isNotNull(), "term")
        .otherwise("generic")
    )
    target = F.when(kind == "post", F.col("_post")).when(kind == "term", term_id)
    return found.withColumn("kind", kind).withColumn("target_id", target).drop("_post", "_home", "_term")


def site_of(rows: DataFrame, sites: DataFrame, url: str = "url") -> DataFrame:
    """Sets ``site`` to that of the longest home address that the URL lies below, else to its host.

    ``sites`` holds (site, home_url); several may share a host. Addresses are looked up
    once each, by all their leading paths.
    """
    homes = sites.groupBy(url_host("home_url").alias("_host"), with_slash(match_path("home_url")).alias("_below")).agg(
        F.min("site").alias("_site")
    )
    steps = F.split(F.btrim(url_path(url), F.lit("/")), "/+")
    below = F.transform(
        F.sequence(F.lit(0), F.size(steps)),
        lambda n: F.when(n == 0, F.lit("/")).otherwise(F.concat(F.lit("/"), F.array_join(F.slice(steps, 1, n), "/"), F.lit("/"))),
    )
    addresses = rows.select(F.col(url).alias("_url"), url_host(url).alias("_host"), below.alias("_paths")).distinct()
    leading = addresses.select("_url", "_host", F.explode(F.array_distinct("_paths")).alias("_below"))
    nearest = leading.join(homes, ["_host", "_below"]).groupBy("_url").agg(F.max_by("_site", F.length("_below")).alias("_site"))
    found = rows.join(nearest, F.col(url) == F.col("_url"), "left")
    return found.withColumn("site", F.coalesce("_site", url_host(url))).drop("_url", "_site")


def missing(requests: DataFrame, mirror: DataFrame) -> DataFrame:
    """Requested keys without a document."""
    return requests.join(mirror.select("site", "path"), ["site", "path"], "left_anti")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
