"""Text expressions: trimming, tag stripping, excerpts, reading documents back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
# What trimming removes (no-break space is not part of it).
TRIM = " \t\n\r\x00\x0b"
# What plain text, and what rendering leave out; Spark and Python read both alike.
SCRIPT_BLOCK = r"(?s)<(?i:(script|style)[^>]*>.*?</\1>)"
RENDER_SCRIPTS = r"(?s)<(?i:(script|style|noscript)[^>]*>.*?</\1>)"
COMMENTS = r"(?s)<!--.*?-->"
# -----------------------------------------------------------------------------
TAG = r"<(?:!--(?s:.*?)-->|[^\s>][^>]*+>)"
FRONT_MATTER_FIELD = r'(?s)^---\s*\n.*?%s:\s*"([^"]+)"'
FIRST_HEADING = r"(?md)^#\s+(.+)$"


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim_ws(text: Column | str) -> Column:
    return F.btrim(as_col(text), F.lit(TRIM))


def rtrim_ws(text: Column | str) -> Column:
    return F.rtrim(as_col(text), F.lit(TRIM))


def plain_text(html: Column | str) -> Column:
    """Text without script and style blocks, comments and tags, trimmed."""

    def without_tags(page: Column) -> Column:
        stripped = F.regexp_replace(F.regexp_replace(page, SCRIPT_BLOCK, ""), TAG, "")
        return trim_ws(F.when(F.contains(page, F.lit("<")), stripped).otherwise(page))

    # a column is cheap to repeat, an expression is not
    return without_tags(F.col(html)) if isinstance(html, str) else bind(html, without_tags)


def squeeze_blank_lines(text: Column) -> Column:
    squeezed = F.regexp_replace(text, r"\n{3,}", "\n\n")
    return trim_ws(F.when(F.contains(text, F.lit("\n\n\n")), squeezed).otherwise(text))


def non_empty(text: Column) -> Column:
    """The value, or NULL for an empty string."""
    return F.when(text != "", text)


def excerpt(own: Column | None, body: Column | str, words: int, tail: str = "") -> Column:
    """Own excerpt, else the first words of the body and a tail if words were cut."""
    pieces = F.split(plain_text(body), r"\s+", words + 1)
    cut = F.array_join(F.slice(pieces, 1, words), " ")
    made = F.when(F.size(pieces) > words, F.concat(cut, F.lit(tail))).otherwise(cut)
    return made if own is None else F.coalesce(non_empty(own), made)


def title_of(document: Column | str) -> Column:
    """Title in the front matter, else the first heading, else 'Untitled'."""
    document = as_col(document)
    return F.coalesce(
        non_empty(F.regexp_extract(document, FRONT_MATTER_FIELD % "title", 1)),
        non_empty(trim_ws(F.regexp_extract(document, FIRST_HEADING, 1))),
        F.lit("Untitled"),
    )


def url_of(document: Column | str) -> Column:
    """URL in the front matter, else '#'."""
    found = F.regexp_extract(as_col(document), FRONT_MATTER_FIELD % "url", 1)
    return F.coalesce(non_empty(found), F.lit("#"))


def list_date(value: Column | str) -> Column:
    """``YYYY-MM-DD`` of a date, a timestamp or their text form."""
    return F.date_format(as_col(value).cast("timestamp_ntz"), "yyyy-MM-dd")
