"""Settings of a mirror run.

``MirrorConfig`` is a plain driver-side value: it is read while a plan is being
built and never travels as a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

# ---- fixed values -------------------------------------------------------
# URL fragments that are never mirrored, whatever the user excludes.
ALWAYS_EXCLUDED = (
    "/wp-admin",
    "/wp-login",
    "/wp-json",
    "/wp-cron",
    "/feed",
    "/xmlrpc",
    "/cart",
    "/checkout",
    "/my-account",
)
# Names under which a site publishes its root sitemap, in order of preference.
ROOT_SITEMAPS = ("wp-sitemap.xml", "sitemap_index.xml")
# Accept values that ask for Markdown.
MARKDOWN_TYPES = ("text/markdown", "text/x-markdown", "application/markdown")
# How many posts an archive, a home page and a site summary list.
ARCHIVE_POSTS = 200
HOMEPAGE_POSTS = 50
SUMMARY_POSTS = 20
# Words in a front matter excerpt and in a summary excerpt.
FRONT_MATTER_WORDS = 30
SUMMARY_WORDS = 20
# Post types that are not counted as custom content types.
BUILT_IN_TYPES = ("post", "page", "attachment")
# -------------------------------------------------------------------------


@dataclass(frozen=True)
class MirrorConfig:
    """Options of a run; the defaults are those of a fresh installation."""

    enabled: bool = True
    source: str = "sitemap"  # 'sitemap' or 'all'
    post_types: tuple[str, ...] = ("post", "page")  # empty: every public type
    include_authors: bool = False
    include_taxonomies: bool = True
    batch_size: int = 10  # items in one step of a numbered backlog
    batch_delay: int = 2  # minutes
    generate_export: bool = True
    generate_summary: bool = True
    exclude_urls: str = ""  # one substring per line
    frontmatter: bool = True
    append_json_schema: bool = False
    regenerate_on_save: bool = True
    content_method: str = "both"  # 'filter', 'http' or 'both'
    exclude_generic: bool = True  # also apply exclusions to pages found by URL only
    ignored_types: tuple[str, ...] = ("BreadcrumbList",)
    posts_heading: str = "Příspěvky"
    recent_heading: str = "Nejnovější příspěvky"
    public_types: tuple[str, ...] = field(default=("post", "page", "product"))

    def __post_init__(self) -> None:
        if self.source not in ("sitemap", "all"):
            raise ValueError(f"unknown source {self.source!r}")
        if self.content_method not in ("filter", "http", "both"):
            raise ValueError(f"unknown content method {self.content_method!r}")
        if not 1 <= self.batch_size <= 100:
            raise ValueError(f"batch_size must be 1 to 100 items, not {self.batch_size}")
        if not 1 <= self.batch_delay <= 30:
            raise ValueError(f"batch_delay must be 1 to 30 minutes, not {self.batch_delay}")

    @property
    def exclusions(self) -> tuple[str, ...]:
        own = tuple(p for p in (line.strip() for line in self.exclude_urls.split("\n")) if p)
        return own + ALWAYS_EXCLUDED

    @property
    def appends_structured_data(self) -> bool:
        return self.append_json_schema and self.content_method == "http"
