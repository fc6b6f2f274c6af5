"""The whole regeneration: from the work queue to mirror, log, status and site documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorleaf.config import MirrorConfig
from mirrorleaf.functions.urls import url_host
from mirrorleaf.operators.entities import resolve_targets, union_all
from mirrorleaf.operators.ranking import drop_overwritten
from mirrorleaf.operators.render import newest_pages
from mirrorleaf.operators.stats import run_status
from mirrorleaf.plans.archives import author_archives, homepages, term_archives
from mirrorleaf.plans.generate import (
    NO_ADDRESS,
    NO_RESULT,
    NOT_PUBLISHED,
    archive_outcomes,
    page_outcomes,
    post_outcomes,
    run_log,
    versions,
)
from mirrorleaf.plans.site_docs import write_site_documents
from mirrorleaf.session import persist_table
from mirrorleaf.sources.store import scan_mirror, write_mirror


@dataclass(frozen=True)
class Tables:
    """What documents are made from; ``posts`` are enriched.

    ``bare_posts`` are the same without what ``enrich`` adds. Lists and addresses of posts
    come from them, so these jobs needn't gather names that they don't show.
    """

    posts: DataFrame
    pages: DataFrame
    post_terms: DataFrame
    terms: DataFrame
    authors: DataFrame
    sites: DataFrame
    bare_posts: DataFrame | None = None

    @property
    def listed(self) -> DataFrame:
        return self.posts if self.bare_posts is None else self.bare_posts


def target(kind: Column, target_id: Column, site: Column, url: Column) -> Column:
    """One text per thing that a document is made from."""
    name = F.when(kind == "homepage", site).when(kind == "generic", url).otherwise(target_id.cast("string"))
    return F.concat(kind, F.lit(" "), name)


def resolve_queue(queue: DataFrame, posts: DataFrame, sites: DataFrame) -> DataFrame:
    """Queue rows with the target that each leads to.

    A queued URL of a post or homepage leads to that document, any other to its page.
    Columns: item_kind, item_id, label (the queued URL), kind_rank, ord, kind,
    target_id, site, url, target.
    """
    row = [F.col("kind").alias("item_kind"), F.col("id").alias("item_id"), F.col("url").alias("label"), "kind_rank", "ord"]
    listed = queue.where(F.col("kind") == "sitemap_url").select(*row, "url")
    listed = resolve_targets(listed, posts, None, sites).drop("path")
    others = queue.where(F.col("kind") != "sitemap_url").select(
        *row, "url", "site", "kind", F.col("id").alias("target_id")
    )
    found = listed.unionByName(others)
    return found.withColumn("target", target(F.col("kind"), F.col("target_id"), F.col("site"), F.col("url")))


def target_outcomes(
    targets: DataFrame, tables: Tables, cfg: MirrorConfig, page_kind: str = "sitemap_page", variant: str = "A"
) -> DataFrame:
    """Outcomes of the distinct targets, each made once, with ``target``.

    ``targets`` is a stored table and holds kind, target_id, site, url. ``page_kind`` and
    ``variant`` are the type and the title rule of pages known by URL only. Kinds that
    no target has are not planned.
    """
    ids = lambda kind, name: (
        targets.where(F.col("kind") == kind).select(F.col("target_id").alias(name)).distinct()
    )

    def posts() -> DataFrame:
        return post_outcomes(tables.posts.join(ids("post", "post_id"), "post_id", "left_semi"), tables.pages, cfg)

    def homes() -> DataFrame:
        wanted = targets.where(F.col("kind") == "homepage").select(F.col("site").alias("_host")).distinct()
        own = tables.sites.withColumn("_host", url_host("home_url")).join(wanted, "_host", "left_semi").drop("_host")
        return archive_outcomes(homepages(own, tables.listed, cfg), "homepage", cfg)

    def terms() -> DataFrame:
        own = tables.terms.join(ids("term", "term_id"), "term_id", "left_semi")
        return archive_outcomes(term_archives(own, tables.listed, tables.post_terms, cfg), "term", cfg)

    def authors() -> DataFrame:
        own = tables.authors.join(ids("author", "author_id"), "author_id", "left_semi")
        return archive_outcomes(author_archives(own, tables.listed, cfg), "author", cfg)

    def pages() -> DataFrame:
        urls = targets.where(F.col("kind") == "generic").select("url").distinct()
        return page_outcomes(newest_pages(urls, tables.pages), cfg, page_kind, variant)

    plans = {"post": posts, "homepage": homes, "term": terms, "author": authors, "generic": pages}
    present = {row.kind for row in targets.select("kind").distinct().collect()}  # five at most
    return union_all([
        plan().withColumn("target", target(F.lit(kind), F.col("item_id"), F.col("site"), F.col("url")))
        for kind, plan in plans.items()
        if kind in present or not present and kind == "generic"
    ])


def store_outcomes(spark: SparkSession, targets: DataFrame, outcomes: DataFrame, run_ts, mirror_path: str) -> DataFrame:
    """Make every document once, write the mirror, return the stored outcomes.

    Of several documents of one path the one that stands last in the queue counts:
    ``targets`` holds target, kind_rank, ord.
    """
    stored = persist_table(spark, outcomes.withColumn("row_id", F.monotonically_increasing_id()), "outcomes")
    accepted = stored.where(F.col("reason").isNull())
    places = targets.groupBy("target").agg(F.max(F.struct("kind_rank", "ord")).alias("place"))
    narrow = accepted.select("site", "path", "row_id", "target").join(places, "target")
    write_mirror(versions(drop_overwritten(accepted, ["place"], narrow=narrow), run_ts), mirror_path)
    return stored


def log_of(targets: DataFrame, stored: DataFrame, run_id: str, run_ts) -> DataFrame:
    """One line for each queued item, also for those whose target is gone."""
    made = stored.select("target", F.col("url").alias("made_url"), "reason", F.lit(True).alias("made"))
    rows = targets.join(made, "target", "left")
    gone = F.when(F.col("kind") == "post", NOT_PUBLISHED).otherwise(NO_RESULT)
    label = F.coalesce("label", "made_url", F.concat(F.lit(NO_ADDRESS), F.col("item_id").cast("string")))
    rows = rows.withColumn("reason", F.when(F.col("made").isNull(), gone).otherwise(F.col("reason"))).withColumn("url", label)
    return run_log(rows, run_id, run_ts)


def regenerate(
    spark: SparkSession, queue: DataFrame, tables: Tables, cfg: MirrorConfig, run_id: str, run_ts, folder: str
) -> tuple[DataFrame, DataFrame]:
    """Work through ``queue``; returns (log, status).

    The mirror is written below ``folder``/mirror, index, export and summary below
    ``folder``/site. Queue and outcomes are stored once; all else is read from them.
    """
    targets = persist_table(spark, resolve_queue(queue, tables.listed, tables.sites), "targets")
    mirror = f"{folder}/mirror"
    stored = store_outcomes(spark, targets, target_outcomes(targets, tables, cfg), run_ts, mirror)
    log = persist_table(spark, log_of(targets, stored, run_id, run_ts), "log")
    write_site_documents(scan_mirror(spark, mirror), tables.sites, tables.posts, cfg, run_ts, f"{folder}/site")
    return log, run_status(targets.select(F.lit(run_id).alias("run_id")), log)
