"""URL expressions: host, path key, titles from slugs, exclusion, routing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirrorleaf.config import MirrorConfig
from mirrorleaf.functions.text import as_col, trim_ws, plain_text

HOST = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^(?:(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)?([^?#]*)"
# A path segment (with its leading slash) that must not reach the mirror:
# empty, '.', '..' or one that hides a slash or backslash behind percent codes.
UNSAFE_SEGMENT = r"(?i)/(?:(?:\.|%2e){1,2}|[^/]*%(?:2f|5c)[^/]*)?(?=/|\z)"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column | str) -> Column:
    """Lower-case host, '' when the URL has none."""
    return F.lower(F.regexp_extract(as_col(url), HOST, 1))


def url_path(url: Column | str) -> Column:
    return F.regexp_extract(as_col(url), PATH, 1)


def home_of(url: Column | str) -> Column:
    """Scheme and host of a URL, without a trailing slash."""
    return F.regexp_extract(as_col(url), r"^((?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//[^/?#]*)", 1)


def path_key(url: Column | str) -> Column:
    """Document path a URL maps to, always ending in ``index.md``.

    Query, fragment, extension and trailing slash do not take part, so
    different URLs may share a key.
    """
    path = F.concat(F.lit("/"), F.translate(url_path(url), "\\", "/"))
    # control characters first: without them a segment may turn out to be unsafe
    path = F.regexp_replace(path, r"[\x00-\x1F\x7F]", "")
    path = F.regexp_replace(path, UNSAFE_SEGMENT, "")
    path = F.btrim(F.regexp_replace(path, r"/+", "/"), F.lit("/"))
    path = F.regexp_replace(path, r"(?i)\.(?:html?|php)\z", "")
    return F.ltrim(F.concat(path, F.lit("/index.md")), F.lit("/"))


def capitalize_words(text: Column) -> Column:
    """Upper-case the first ASCII letter of each word, leave the rest alone."""
    first = lambda w: F.translate(F.left(w, F.lit(1)), LOWER, LOWER.upper())
    return F.array_join(
        F.transform(F.split(text, " "), lambda w: F.concat(first(w), F.substr(w, F.lit(2)))), " "
    )


def last_segment(path: Column) -> Column:
    return F.regexp_extract(F.btrim(path, F.lit("/")), r"([^/]*)\z", 1)


def slug_title(url: Column | str, variant: str = "B", site_name: Column | str | None = None) -> Column:
    """Title made from the last piece of a URL.

    Variant A reads the whole URL, query included. Variant B reads the path
    only, also turns '_' into spaces and falls back to the site name.
    """
    if variant == "A":
        return capitalize_words(F.replace(last_segment(as_col(url)), F.lit("-"), F.lit(" ")))
    fallback = F.lit("") if site_name is None else as_col(site_name)
    slug = last_segment(url_path(url))
    slug = F.when(slug == "", fallback).otherwise(slug)
    title = plain_text(capitalize_words(F.translate(slug, "-_", "  ")))
    title = F.replace(title, F.lit('"'), F.lit('\\"'))
    return trim_ws(F.translate(title, "\n\r", " "))


def markdown_url(url: Column | str) -> Column:
    """Address of the Markdown variant of a page."""
    url = as_col(url)
    joiner = F.when(F.contains(url, F.lit("?")), F.lit("&")).otherwise(F.lit("?"))
    return F.concat(url, joiner, F.lit("format=markdown"))


def is_excluded(url: Column | str, cfg: MirrorConfig) -> Column:
    """True when the whole URL holds one of the exclusion substrings."""
    url = as_col(url)
    return reduce(lambda a, b: a | b, [F.contains(url, F.lit(p)) for p in cfg.exclusions])


def on_same_site(url: Column | str, home_url: Column | str) -> Column:
    """Hosts agree, ignoring case; a URL without a host belongs nowhere."""
    host = url_host(url)
    return (host != "") & (host == url_host(home_url))


def match_path(url: Column | str) -> Column:
    """URL path without trailing slashes, the right-hand part of a URL match."""
    return F.rtrim(url_path(url), F.lit("/"))


def with_slash(url: Column | str) -> Column:
    return F.concat(F.rtrim(as_col(url), F.lit("/")), F.lit("/"))


def site_key(domain: Column | str, path: Column | str, blog_id: Column | str | None) -> Column:
    """Folder of a site below the mirror root; '' for a single site."""
    if blog_id is None:
        return F.lit("")
    domain, path, blog_id = as_col(domain), as_col(path), as_col(blog_id)
    name = F.lower(F.concat(domain, F.lit("-"), F.btrim(F.coalesce(path, F.lit("")), F.lit("/"))))
    name = F.regexp_replace(F.translate(name, "./", "--"), r"[^a-z0-9 _-]", "")
    name = F.btrim(F.regexp_replace(name, r"[\s-]+", "-"), F.lit("-"))
    unnamed = F.concat(F.lit("site-"), blog_id.cast("string"))
    name = F.when(F.coalesce(domain, F.lit("")) == "", unnamed).otherwise(name)
    return F.concat(F.lit("sites/"), blog_id.cast("string"), F.lit("-"), name, F.lit("/"))
