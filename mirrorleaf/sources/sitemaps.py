"""Sitemap documents: which URLs a site publishes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorleaf.config import ROOT_SITEMAPS
from mirrorleaf.functions.urls import on_same_site
from mirrorleaf.operators.entities import union_all
from mirrorleaf.session import persist_table, remove_folder, store_table

NAMESPACE = "http://www.sitemaps.org/schemas/sitemap/0.9"
# Children come before a document's own URLs; this ranks the latter last.
OWN_URLS = 2**62


def _plain_names(xml: Column) -> Column:
    """XML whose element names lost the prefix that stands for the sitemap namespace."""
    prefix = F.regexp_extract(xml, rf"""xmlns:([A-Za-z_][\w.-]*)\s*=\s*["']{re.escape(NAMESPACE)}["']""", 1)
    named = F.concat(F.lit(r"(</?)\Q"), prefix, F.lit(r":\E"))
    return F.when(prefix != "", F.regexp_replace(xml, named, F.lit("$1"))).otherwise(xml)


def _entries(sitemaps: DataFrame, kind: str, name: str) -> DataFrame:
    """(sitemap_url, pos, name) of the listed addresses; malformed XML has none."""
    plain = sitemaps.where(F.contains("xml", F.lit(NAMESPACE))).withColumn("xml", _plain_names(F.col("xml")))
    of_kind = plain.where(F.col("xml").rlike(rf"<{kind}[\s>]"))
    parsed = of_kind.select("sitemap_url", F.from_xml("xml", f"{kind} array<struct<loc:string>>").alias("doc"))
    return parsed.select("sitemap_url", F.posexplode(f"doc.{kind}").alias("pos", "entry")).select(
        "sitemap_url", F.col("pos").cast("bigint").alias("pos"), F.col("entry.loc").alias(name)
    )


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_url, pos, url) of every listed page."""
    return _entries(sitemaps, "url", "url")


def expand_sitemaps(sitemaps: DataFrame, roots: DataFrame) -> DataFrame:
    """Every page URL below the roots: (site, ord, url), same host as the site only.

    ``roots`` holds (site, home_url, sitemap_url). Indexes are followed to any depth.
    A step goes on from the documents that it reached for the first time, or at a later
    place than before; it never enters a document that lists it, directly or not, so
    cycles end. Each step keeps one row per document, so shared children do not
    multiply. ``ord`` is the position in reading order (children first); where a
    document is listed twice the later position counts, as the last write of a
    document does.

    XML is parsed once into a table of links; each step is a table too, so the walk
    stops as soon as a step is empty and survives lost executors.
    """
    spark = sitemaps.sparkSession
    children, links = store_table(spark, _entries(sitemaps, "sitemap", "child"), "sitemap-links")
    key = ["site", "home_url", "sitemap_url"]
    step = roots.select(
        *key, F.array(F.lit(0).cast("bigint")).alias("ord"), F.array("sitemap_url").alias("path")
    )
    step, folder = store_table(spark, step, "sitemap-step")
    steps, folders = [step], [links, folder]
    while not steps[-1].isEmpty():
        place = F.struct(F.concat("ord", F.array("pos")).alias("ord"), F.concat("path", F.array("child")).alias("path"))
        reached = (
            steps[-1]
            .join(children, "sitemap_url")
            .where(on_same_site("child", "home_url") & ~F.array_contains("path", F.col("child")))
            .groupBy("site", "home_url", F.col("child").alias("sitemap_url"))
            .agg(F.max(place).alias("place"))
            .select(*key, "place.ord", "place.path")
        )
        known = union_all(steps).groupBy(*key).agg(F.max("ord").alias("known"))
        later = F.col("known").isNull() | (F.col("ord") > F.col("known"))
        step, folder = store_table(spark, reached.join(known, key, "left").where(later).drop("known"), "sitemap-step")
        steps.append(step)
        folders.append(folder)
    documents = union_all(steps).groupBy(*key).agg(F.max("ord").alias("ord"))
    listed = documents.join(sitemap_urls(sitemaps), "sitemap_url").where(on_same_site("url", "home_url"))
    place = F.concat("ord", F.array(F.lit(OWN_URLS).cast("bigint"), F.col("pos")))
    expanded = persist_table(spark, listed.groupBy("site", "url").agg(F.max(place).alias("ord")), "sitemap-urls")
    for folder in folders:
        remove_folder(spark, folder)
    return expanded


def root_sitemaps(sites: DataFrame, sitemaps: DataFrame) -> DataFrame:
    """The root sitemap of each site that has one, by preferred name."""
    names = F.explode(
        F.array(*[F.struct(F.lit(i).alias("pref"), F.lit(n).alias("name")) for i, n in enumerate(ROOT_SITEMAPS)])
    )
    candidates = sites.select("site", "home_url", names.alias("root")).select(
        "site",
        "home_url",
        "root.pref",
        F.concat(F.rtrim("home_url", F.lit("/")), F.lit("/"), F.col("root.name")).alias("sitemap_url"),
    )
    present = candidates.join(sitemaps.select("sitemap_url"), "sitemap_url", "left_semi")
    return present.groupBy("site", "home_url").agg(F.min_by("sitemap_url", "pref").alias("sitemap_url"))


