"""HTML to Markdown over a table.

Only the tree fold runs in Python, and behind it the decoder for the few pages
that show an encoded payload. Script removal, line ends, blank lines, trimming
and encoding repair are expressions around it.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mirrorleaf.config import MirrorConfig
from mirrorleaf.functions.encoding import repair_text
from mirrorleaf.functions.text import COMMENTS, RENDER_SCRIPTS, as_col, bind, plain_text, squeeze_blank_lines
from mirrorleaf.operators.payload import render_page
from mirrorleaf.session import small_batches

RELEASE_CHARS = 32 << 20


def _give_back() -> None:
    """Free memory that the allocators of a worker keep goes back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


@F.pandas_udf(StringType())
def _fold(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    size = 0  # characters since memory was given back
    for pages, homes in batches:
        yield pd.Series([render_page(p, h) if p else "" for p, h in zip(pages, homes)], dtype=object)
        size += sum(len(p) for p in pages if p)
        if size >= RELEASE_CHARS:
            size = 0
            _give_back()
    _give_back()


# A filter on the Markdown must not be pushed below the fold: that would fold
# every page twice. For the same reason the column is used once below.
_fold = _fold.asNondeterministic()


def clean_html(html: Column | str) -> Column:
    """HTML without scripts, styles and comments, with plain line ends."""

    def plain_ends(page: Column) -> Column:
        return F.when(F.contains(page, F.lit("\r")), F.regexp_replace(page, r"\r\n?", "\n")).otherwise(page)

    html = F.regexp_replace(as_col(html), RENDER_SCRIPTS, "")
    return bind(F.regexp_replace(html, COMMENTS, ""), plain_ends)


def to_markdown(html: Column | str, home_url: Column | str, clean: Column | str | None = None) -> Column:
    """Markdown of an HTML column; inside a page only its body counts.

    ``clean`` may pass the result of ``clean_html`` where it is at hand.
    """
    page = clean_html(html) if clean is None else as_col(clean)
    raw = _fold(page, F.coalesce(as_col(home_url), F.lit("")))
    return repair_text(bind(raw, squeeze_blank_lines))


def spread(pages: DataFrame) -> DataFrame:
    """Pages over all cores when their files give fewer splits than cores.

    Only small inputs are shuffled; a large one is rendered where it is read.
    For tables as read, before any join.
    """
    cores = pages.sparkSession.sparkContext.defaultParallelism
    if pages.rdd.getNumPartitions() >= cores:
        return pages
    return pages.repartition(cores)


def newest_pages(wanted: DataFrame, pages: DataFrame) -> DataFrame:
    """Adds ``page_id`` and ``html`` of the newest page of each wanted ``url``, else NULL.

    Addresses are matched on narrow rows and page bodies join by their unique
    id, so an address that was fetched very often is no hot key.
    """
    ids = pages.groupBy("url").agg(F.max("page_id").alias("page_id"))
    return wanted.join(ids, "url", "left").join(pages.select("page_id", "html"), "page_id", "left")


def choose_html(posts: DataFrame, pages: DataFrame, cfg: MirrorConfig) -> DataFrame:
    """Adds ``html``: the stored body, the fetched page, or the first with text.

    ``filter`` reads the stored body, ``http`` the page, ``both`` the page only
    where the body has no text. Only posts that need a page look for one.
    """
    if cfg.content_method == "filter":
        return posts.withColumn("html", F.col("body"))
    body_has_text = F.coalesce(plain_text("body"), F.lit("")) != ""
    needing = posts if cfg.content_method == "http" else posts.where(~body_has_text)
    found = newest_pages(needing.select("post_id", F.col("permalink").alias("url")), pages)
    with_text = F.when(plain_text("html") != "", F.col("html"))
    fetched = found.select("post_id", with_text.alias("fetched"))
    joined = posts.join(fetched, "post_id", "left")
    page = F.coalesce("fetched", F.lit(""))
    stored = F.lit(cfg.content_method == "both") & body_has_text
    return joined.withColumn("html", F.when(stored, F.col("body")).otherwise(page))


def render_markdown(pages: DataFrame, home_url: str | Column = "home_url") -> DataFrame:
    """Adds ``markdown`` to rows that hold ``html``."""
    small_batches(pages.sparkSession)
    return pages.withColumn("markdown", to_markdown("html", home_url))
