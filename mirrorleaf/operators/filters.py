"""Which items are mirrored. Each function keeps or drops rows, nothing else."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mirrorleaf.config import MirrorConfig
from mirrorleaf.functions.text import plain_text
from mirrorleaf.functions.urls import is_excluded, on_same_site


def published(posts: DataFrame) -> DataFrame:
    return posts.where(F.col("post_status") == "publish")


def allowed(post_type: Column, cfg: MirrorConfig) -> Column:
    """Type test; an empty list of types stands for all public types."""
    return post_type.isin(*(cfg.post_types or cfg.public_types))


def allowed_types(posts: DataFrame, cfg: MirrorConfig) -> DataFrame:
    return posts.where(allowed(F.col("post_type"), cfg))


def exclude_urls(df: DataFrame, cfg: MirrorConfig, url: str = "url") -> DataFrame:
    return df.where(~is_excluded(url, cfg))


def same_site(df: DataFrame, home_url: str | Column, url: str = "url") -> DataFrame:
    """Rows whose URL lies on the host of ``home_url`` (a column)."""
    return df.where(on_same_site(url, home_url))


def require_text(df: DataFrame, html: str = "html") -> DataFrame:
    return df.where(F.coalesce(plain_text(html), F.lit("")) != "")


def real_edits(changes: DataFrame) -> DataFrame:
    """Changes without revisions and autosaves."""
    skipped = F.coalesce("is_revision", F.lit(False)) | F.coalesce("is_autosave", F.lit(False))
    return changes.where(~skipped)
