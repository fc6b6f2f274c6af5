"""Page bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorleaf.functions.encoding import repair_text
from mirrorleaf.functions.text import as_col, plain_text, trim_ws
from mirrorleaf.operators.render import clean_html

# ---- fixed values: reasons in the run log ------------------------------------
EMPTY_BODY = "HTTP Fetch returned empty body."
EMPTY_TEXT = "HTTP Fetch succeeded, but content extraction (<body>) resulted in empty text."
# ------------------------------------------------------------------------------


def body_of(html: Column | str) -> Column:
    """Inside of the body element, else the whole input."""
    html = as_col(html)
    inner = F.regexp_extract(html, r"(?is)<body(?:\s[^>]*)?>(.*?)(?:</body\s*>|\z)", 1)
    return F.when(html.rlike(r"(?i)<body[\s>]"), inner).otherwise(html)


def has_text(html: Column | str, clean: Column | str | None = None) -> Column:
    """True if the body holds text outside tags.

    The first tests stop at the first letter they meet; only pages that fail
    them are stripped of all their tags to be sure.
    """
    clean = clean_html(html) if clean is None else as_col(clean)
    text_in_body = clean.rlike(r"<(?i:body)(?:\s[^>]*)?(?s:.*?)>[^<]*?[^<\s]")
    text_without_body = ~clean.rlike(r"<(?i:body)[\s>]") & clean.rlike(r"(?:\A|>)[^<]*?[^<\s]")
    surely = F.coalesce(plain_text(body_of(html)) != "", F.lit(False))
    no_markup = ~F.contains(clean, F.lit("<"))
    return (
        F.when(no_markup & (trim_ws(clean) != ""), True)
        .when(text_in_body | text_without_body, True)
        .otherwise(surely)
    )


def normalize_pages(pages: DataFrame) -> DataFrame:
    """Repaired bodies, and the reason why a page cannot be used (NULL if it can).

    Also ``clean``, the HTML that is rendered.
    """
    repaired = pages.withColumn("html", repair_text("html")).withColumn("clean", clean_html("html"))
    empty = F.coalesce(F.col("html"), F.lit("")) == ""
    reason = F.when(empty, EMPTY_BODY).when(~has_text("html", "clean"), EMPTY_TEXT)
    return repaired.withColumn("reason", reason)


def scan_pages(spark: SparkSession, path: str) -> DataFrame:
    """Table of pages: page_id, url, html, reason."""
    return normalize_pages(spark.read.parquet(path).select("page_id", "url", "html")).drop("clean")
