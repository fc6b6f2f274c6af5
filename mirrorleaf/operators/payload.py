"""Recovery of page copy that a page builder stored as Base64 of a nested array.

Works on the few pages that still show an encoded run after rendering.
"""

from __future__ import annotations

import base64
import re

from mirrorleaf.functions.text import COMMENTS, RENDER_SCRIPTS
from mirrorleaf.operators.html_fold import WS, fold

# ---- fixed values ---------------------------------------------------------
# Keys whose values are visible copy.
CONTENT_KEYS = frozenset(
    (
        "content", "text", "title", "subtitle", "heading", "description", "caption",
        "button_text", "link_text", "popup_text", "popup_title", "book_title", "book_author",
        "name", "company",
    )
)
RUN = re.compile(r"(?<![A-Za-z0-9+/_\-=])([A-Za-z0-9+/_\-]{40,}={0,2})(?![A-Za-z0-9+/_\-=])")
WHOLE_RUN = re.compile(r"[A-Za-z0-9+/_\-]+={0,2}")
LONG_RUN = re.compile(r"(?<![A-Za-z0-9+/_\-=])[A-Za-z0-9+/_\-]{120,}={0,2}(?![A-Za-z0-9+/_\-=])")
COLOUR = re.compile(r"#?[a-f0-9]{3,8}", re.IGNORECASE)
SETTING = re.compile(
    r"(?:rgba?\(|https?://|/wp-content/|data:image/|[0-9.]+%?\Z)", re.IGNORECASE
)
# ---------------------------------------------------------------------------
_SCRIPTS = re.compile(RENDER_SCRIPTS)
_COMMENTS = re.compile(COMMENTS)
_SCALAR = re.compile(rb"(?:i:[+-]?\d+|d:[^;]*|b:[01]|N|[rR]:\d+);")
_STRING = re.compile(rb's:(\d+):"')
_ARRAY = re.compile(rb"a:(\d+):\{")


def _pairs(data: bytes) -> list[tuple[str, str]] | None:
    """(key, string value) pairs of a serialized array, nested ones included.

    None if the bytes are anything but arrays, strings and scalars. Objects are
    refused, never built.
    """
    found: list[tuple[str, str]] = []
    waiting: list[list] = []  # open arrays: [entries left, key or None]
    at = len(data) - len(data.lstrip())
    if not _ARRAY.match(data, at):
        return None
    while True:
        token: str | None = None
        if opened := _ARRAY.match(data, at):
            if waiting and waiting[-1][1] is None:
                return None  # an array cannot be a key
            waiting.append([int(opened[1]), None])
            at = opened.end()
        else:
            if text := _STRING.match(data, at):
                end = text.end() + int(text[1])
                if data[end : end + 2] != b'";':
                    return None
                token = data[text.end() : end].decode("utf-8", "replace")
                at = end + 2
            elif scalar := _SCALAR.match(data, at):
                at = scalar.end()
            else:
                return None
            entry = waiting[-1]
            if entry[1] is None:
                entry[1] = token or ""
                continue
            if token:
                found.append((entry[1], token))
            entry[0], entry[1] = entry[0] - 1, None
        while waiting and waiting[-1][0] == 0:
            if data[at : at + 1] != b"}":
                return None
            at += 1
            waiting.pop()
            if waiting:
                waiting[-1][0], waiting[-1][1] = waiting[-1][0] - 1, None
        if not waiting:
            return found


def _is_noise(text: str) -> bool:
    """Colours, addresses, numbers, icons and other values nobody reads."""
    if len(text.encode()) < 3 or COLOUR.fullmatch(text) or SETTING.match(text):
        return True
    lowered = text.lower()
    return "<svg" in lowered or "<use " in lowered


def decode_payload(payload: str) -> str:
    """Visible copy of one encoded payload, '' if it is none."""
    payload = payload.strip("\"'" + WS)
    if len(payload) < 40 or not WHOLE_RUN.fullmatch(payload):
        return ""
    body = payload.translate(str.maketrans("-_", "+/")).rstrip("=")
    padding = len(payload) - len(body)
    if len(body) % 4 == 1 or (padding and (len(body) + padding) % 4):
        return ""
    pairs = _pairs(base64.b64decode(body + "=" * (-len(body) % 4)))
    kept = (text.strip(WS) for key, text in pairs or () if key in CONTENT_KEYS)
    return "\n\n".join(dict.fromkeys(text for text in kept if not _is_noise(text)))


def render_page(page: str, home: str) -> str:
    """Markdown of a cleaned page, with the copy of its payloads in their place.

    Payloads are looked for only if the Markdown shows a long encoded run.
    Decoding shortens the page, so the repetition for nested payloads ends.
    """
    markdown = fold(page, home)
    while LONG_RUN.search(markdown):
        decoded = decode_payload(page) or RUN.sub(lambda m: decode_payload(m[1]) or m[0], page)
        if decoded == page:
            break
        page = _COMMENTS.sub("", _SCRIPTS.sub("", decoded)).replace("\r\n", "\n").replace("\r", "\n")
        markdown = fold(page, home)
    return markdown
