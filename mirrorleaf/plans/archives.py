"""Archive documents of terms and authors, and the homepage of a site."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorleaf.config import ARCHIVE_POSTS, HOMEPAGE_POSTS, MirrorConfig
from mirrorleaf.functions.encoding import repair_text
from mirrorleaf.functions.front_matter import front_matter
from mirrorleaf.functions.text import list_date
from mirrorleaf.functions.urls import home_of, url_host, with_slash
from mirrorleaf.operators.entities import author_members, term_counts, term_members
from mirrorleaf.operators.filters import published
from mirrorleaf.operators.ranking import newest_first, top_per_group
from mirrorleaf.operators.render import to_markdown


def _link() -> Column:
    return F.concat(F.lit("- ["), "title", F.lit("]("), "permalink", F.lit(")"))


def _listed(top: DataFrame, key: str, line: Column) -> DataFrame:
    """One text per group out of its few ranked lines."""
    lines = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return top.groupBy(key).agg(F.array_join(F.transform(lines, lambda r: r["line"]), "\n").alias("listed"))


def _body(name: Column | str, about: Column, heading: str) -> Column:
    """Heading, description and list; empty parts leave nothing behind."""
    listed = F.concat(F.lit(f"## {heading}\n\n"), "listed", F.lit("\n"))
    return F.concat(
        F.lit("# "), name, F.lit("\n\n"), F.coalesce(about, F.lit("")), F.coalesce(listed, F.lit(""))
    )


def _documents(df: DataFrame, kind: str, head: Column, body: Column, item_id: Column, cfg: MirrorConfig) -> DataFrame:
    return df.select(
        "url",
        F.lit(kind).alias("kind"),
        item_id.alias("item_id"),
        (repair_text(head) if cfg.frontmatter else F.lit("")).alias("front_matter"),
        repair_text(body).alias("markdown"),
    )


def _paragraph(text: Column) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", F.concat(text, F.lit("\n\n")))


def term_archives(terms: DataFrame, posts: DataFrame, post_terms: DataFrame, cfg: MirrorConfig) -> DataFrame:
    """Newest posts of each term. Posts are cut down per term before terms join."""
    narrow = posts.select("post_id", "post_status", "published_on", "title", "permalink")
    members = term_members(narrow, post_terms)
    top = top_per_group(members, ["term_id"], newest_first(), ARCHIVE_POSTS)
    full = (
        terms.join(term_counts(members), "term_id", "left")
        .join(_listed(top, "term_id", _link()), "term_id", "left")
        .withColumn("post_count", F.coalesce("post_count", F.lit(0)))
    )
    head = front_matter(
        "term", title="name", url="url", type=F.lit("taxonomy_archive"), taxonomy="taxonomy",
        description="description", post_count="post_count",
    )
    about = _paragraph(to_markdown("description", home_of("url")))
    body = _body(F.col("name"), about, cfg.posts_heading)
    return _documents(full, "taxonomy_archive", head, body, F.col("term_id"), cfg)


def author_archives(authors: DataFrame, posts: DataFrame, cfg: MirrorConfig) -> DataFrame:
    """Newest posts of each author."""
    narrow = posts.select("post_id", "author_id", "post_status", "published_on", "title", "permalink")
    members = author_members(narrow, authors)
    top = top_per_group(members, ["author_id"], newest_first(), ARCHIVE_POSTS)
    full = authors.join(_listed(top, "author_id", _link()), "author_id", "left")
    head = front_matter("author", title="display_name", url="url", type=F.lit("author_archive"), bio="bio")
    body = _body(F.col("display_name"), _paragraph(F.col("bio")), cfg.posts_heading)
    return _documents(full, "author_archive", head, body, F.col("author_id"), cfg)


def homepages(sites: DataFrame, posts: DataFrame, cfg: MirrorConfig) -> DataFrame:
    """Newest posts of type 'post' of each site."""
    narrow = posts.select(
        "post_id", "post_type", "post_status", "published_on", "title", "permalink"
    ).withColumn("site", url_host("permalink"))
    blog = published(narrow).where(F.col("post_type") == "post")
    top = top_per_group(blog, ["site"], newest_first(), HOMEPAGE_POSTS)
    line = F.concat(_link(), F.lit(" ("), list_date("published_on"), F.lit(")"))
    full = sites.join(_listed(top, "site", line), "site", "left").withColumn("url", with_slash("home_url"))
    head = front_matter("homepage", title="name", url="url", type=F.lit("homepage"), description="description")
    about = F.concat("description", F.lit("\n\n"))
    body = _body(F.col("name"), about, cfg.recent_heading)
    return _documents(full, "homepage", head, body, F.lit(0).cast("bigint"), cfg)
