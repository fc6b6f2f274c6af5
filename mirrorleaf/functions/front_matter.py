"""YAML front matter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mirrorleaf.functions.encoding import repair_text
from mirrorleaf.functions.text import as_col, trim_ws, plain_text

# Fixed value: keys of each document kind, in the order they are written.
KEYS = {
    "post": (
        "title", "url", "type", "date", "modified", "author", "excerpt",
        "categories", "tags", "featured_image",
    ),
    "term": ("title", "url", "type", "taxonomy", "description", "post_count"),
    "author": ("title", "url", "type", "bio"),
    "homepage": ("title", "url", "type", "description"),
    "generic": ("title", "url", "type"),
}
_ESCAPED = {"title", "author", "excerpt", "description", "bio"}
_LISTS = {"categories", "tags"}
_DROPPED_WHEN_EMPTY = {"author", "categories", "tags", "featured_image"}


def yaml_escape(text: Column | str) -> Column:
    """One line of plain, repaired text that is safe between double quotes."""
    text = F.replace(repair_text(plain_text(text)), F.lit('"'), F.lit('\\"'))
    return trim_ws(F.translate(text, "\n\r", " "))


def _line(key: str, value: Column, kind: str) -> Column:
    if key in _LISTS:
        quoted = F.transform(value, lambda v: F.concat(F.lit('"'), yaml_escape(v), F.lit('"')))
        line = F.concat(F.lit(f"{key}: ["), F.array_join(quoted, ", "), F.lit("]"))
        return F.when(F.size(value) > 0, line)
    if key == "post_count":
        return F.concat(F.lit("post_count: "), value.cast("string"))
    # titles of generic pages come from a slug and arrive escaped
    shown = yaml_escape(value) if key in _ESCAPED and kind != "generic" else value
    line = F.concat(F.lit(f'{key}: "'), shown, F.lit('"'))
    return F.when(value != "", line) if key in _DROPPED_WHEN_EMPTY else line


def front_matter(kind: str, **values: Column | str) -> Column:
    """Front matter of a document; NULL or empty optional values leave no line."""
    unknown = set(values) - set(KEYS[kind])
    if unknown:
        raise ValueError(f"{sorted(unknown)} are no front matter keys of a {kind}")
    lines = [_line(key, as_col(values[key]), kind) for key in KEYS[kind] if key in values]
    return F.concat_ws("\n", F.lit("---"), *lines, F.lit("---"), F.lit(""), F.lit(""))
