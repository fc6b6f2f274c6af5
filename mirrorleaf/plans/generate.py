"""Full generation: every queued item becomes a document or a logged reason.

An *outcome* row holds the document and, if there is none, the reason. Mirror
rows and the run log are two projections of the same outcomes, so nothing is
rendered twice when they are written once first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorleaf.config import FRONT_MATTER_WORDS, MirrorConfig
from mirrorleaf.functions.encoding import repair_text
from mirrorleaf.functions.front_matter import front_matter
from mirrorleaf.functions.text import FRONT_MATTER_FIELD, excerpt, non_empty, title_of
from mirrorleaf.functions.urls import home_of, is_excluded, path_key, slug_title, url_host
from mirrorleaf.operators.filters import allowed
from mirrorleaf.operators.ranking import drop_overwritten, latest_per_path
from mirrorleaf.operators.render import choose_html, clean_html, to_markdown
from mirrorleaf.operators.structured import append_structured
from mirrorleaf.plans.queue import RANKS
from mirrorleaf.session import persist_table, small_batches
from mirrorleaf.sources.pages import has_text, normalize_pages
from mirrorleaf.sources.store import with_bytes, write_mirror

# ---- fixed values: reasons in the run log ----------------------------------
NOT_PUBLISHED = "Post not found or not published."
EXCLUDED = "URL is excluded by rules."
TERM_EXCLUDED = "Term URL is excluded by rules."
AUTHOR_EXCLUDED = "Author URL is excluded by rules."
HOMEPAGE_EXCLUDED = "Homepage is excluded by rules."
NO_MARKDOWN = "Markdown conversion resulted in empty content for URL: "
TYPE_NOT_ALLOWED = ("Post type '", "' is not allowed in settings.")
NO_TEXT = "Rendered content is empty (tried method: {})."
NO_RESULT = "Empty content or processing failure"
NO_ADDRESS = "ID: "
# ----------------------------------------------------------------------------


def index_title() -> Column:
    """Title as the index reads it back; the body is searched only if it must be."""
    own = non_empty(F.regexp_extract("front_matter", FRONT_MATTER_FIELD % "title", 1))
    return F.coalesce(own, title_of(F.concat("front_matter", "markdown")))


def outcomes(
    df: DataFrame, item_kind: str, item_id: str, post_id: str | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Common columns of items that hold url, kind, front_matter, markdown and reason."""
    return df.select(
        url_host("url").alias("site"),
        path_key("url").alias("path"),
        "url",
        "kind",
        F.lit(item_kind).alias("item_kind"),
        F.lit(RANKS[item_kind]).alias("kind_rank"),
        F.col(item_id).cast("bigint").alias("item_id"),
        (F.col(post_id) if post_id else F.lit(None)).cast("bigint").alias("post_id"),
        index_title().alias("title"),
        "front_matter",
        "markdown",
        "reason",
        *keep,
    )


def page_outcomes(
    pages: DataFrame, cfg: MirrorConfig, kind: str = "sitemap_page", variant: str = "B"
) -> DataFrame:
    """Documents of pages known by URL only. Rejected pages are not rendered."""
    small_batches(pages.sparkSession)
    pages = normalize_pages(pages)
    reason = F.col("reason")
    if cfg.exclude_generic:
        reason = F.when(is_excluded("url", cfg), EXCLUDED).otherwise(reason)
    checked = pages.withColumn("reason", reason)
    usable = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    markdown = to_markdown(usable("html"), home_of("url"), usable("clean"))
    rendered = checked.withColumn("markdown", markdown)
    late = F.when(F.col("markdown") == "", F.concat(F.lit(NO_MARKDOWN), "url"))
    title = slug_title("url", variant, url_host("url"))
    title = F.replace(title, F.lit('"'), F.lit('\\"')) if variant == "A" else title
    head = front_matter("generic", title=title, url="url", type=F.lit(kind))
    return outcomes(
        rendered.withColumn("reason", F.coalesce("reason", late))
        .withColumn("kind", F.lit(kind))
        .withColumn("front_matter", repair_text(head) if cfg.frontmatter else F.lit(""))
        .withColumn("markdown", append_structured("markdown", "html", cfg)),
        "sitemap_url",
        "page_id",
    )


def post_outcomes(
    posts: DataFrame, pages: DataFrame, cfg: MirrorConfig, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Documents of enriched posts (author, categories, tags, featured_image).

    ``posts`` may also hold ``excerpt`` and ``modified_on``; columns in ``keep``
    stay in the result.
    """
    small_batches(posts.sparkSession)
    early = (
        F.when(F.col("post_status") != "publish", NOT_PUBLISHED)
        .when(
            ~allowed(F.col("post_type"), cfg),
            F.concat(F.lit(TYPE_NOT_ALLOWED[0]), "post_type", F.lit(TYPE_NOT_ALLOWED[1])),
        )
        .when(is_excluded("permalink", cfg), EXCLUDED)
    )
    chosen = choose_html(posts.withColumn("reason", early), pages, cfg).withColumn("clean", clean_html("html"))
    no_text = F.lit(NO_TEXT.format(cfg.content_method))
    checked = chosen.withColumn("reason", F.coalesce("reason", F.when(~has_text("html", "clean"), no_text)))
    usable = lambda c: F.when(F.col("reason").isNull(), F.col(c))
    columns = set(posts.columns)
    head = front_matter(
        "post",
        title="title",
        url="permalink",
        type="post_type",
        date="published_on",
        **({"modified": F.col("modified_on")} if "modified_on" in columns else {}),
        author="author",
        excerpt=excerpt(F.col("excerpt") if "excerpt" in columns else None, "body", FRONT_MATTER_WORDS),
        categories="categories",
        tags="tags",
        featured_image="featured_image",
    )
    markdown = to_markdown(usable("html"), home_of("permalink"), usable("clean"))
    rendered = checked.withColumn("markdown", markdown)
    if cfg.appends_structured_data:
        rendered = rendered.withColumn("markdown", append_structured("markdown", "fetched", cfg))
    return outcomes(
        rendered.withColumn("url", F.col("permalink"))
        .withColumn("kind", F.col("post_type"))
        .withColumn("front_matter", repair_text(head) if cfg.frontmatter else F.lit("")),
        "post",
        "post_id",
        "post_id",
        keep,
    )


def archive_outcomes(archives: DataFrame, item_kind: str, cfg: MirrorConfig) -> DataFrame:
    """Documents of ``plans.archives`` after the exclusion rules."""
    text = {"term": TERM_EXCLUDED, "author": AUTHOR_EXCLUDED, "homepage": HOMEPAGE_EXCLUDED}[item_kind]
    reason = F.when(is_excluded("url", cfg), text)
    return outcomes(archives.withColumn("reason", reason), item_kind, "item_id")


POSITION = ["kind_rank", "item_id"]


def versions(documents: DataFrame, run_ts) -> DataFrame:
    """Documents as mirror rows of one run."""
    return with_bytes(
        documents.withColumn("version_ts", F.lit(run_ts).cast("timestamp_ntz"))
        .withColumn("version_seq", F.lit(0).cast("bigint"))
        .withColumn("is_deleted", F.lit(False))
    )


def mirror_rows(done: DataFrame, run_ts) -> DataFrame:
    """Accepted documents, the last one of each path, as mirror versions."""
    return versions(latest_per_path(done.where(F.col("reason").isNull()), POSITION), run_ts)


def run(spark: SparkSession, done: DataFrame, run_id: str, run_ts, mirror_path: str) -> DataFrame:
    """Render once, write the mirror, return the run log.

    Outcomes are stored as they are rendered, without a shuffle. The mirror and
    the log read them back; documents move once, on their way to their site.
    """
    # numbered as it is written, so the numbers don't change
    stored = persist_table(spark, done.withColumn("row_id", F.monotonically_increasing_id()), "outcomes")
    accepted = drop_overwritten(stored.where(F.col("reason").isNull()), POSITION)
    write_mirror(versions(accepted, run_ts), mirror_path)
    return run_log(stored, run_id, run_ts)


def run_log(done: DataFrame, run_id: str, run_ts) -> DataFrame:
    """One line per item, accepted or rejected."""
    ok = F.col("reason").isNull()
    stamp = F.date_format(F.lit(run_ts).cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss")
    item = F.concat(F.lit("["), "item_kind", F.lit("] "), "url")
    failed = F.concat(F.lit("FAILED: "), item, F.lit(" - Reason: "), "reason")
    return done.select(
        F.lit(run_id).alias("run_id"),
        F.lit(run_ts).cast("timestamp_ntz").alias("ts"),
        F.col("item_kind").alias("kind"),
        "item_id",
        F.col("url").alias("label"),
        ok.alias("ok"),
        "reason",
        F.concat(
            F.lit("["), stamp, F.lit("] "), F.when(ok, F.concat(F.lit("OK: "), item)).otherwise(failed)
        ).alias("line"),
    )
