"""One pass over one page: HTML in, raw Markdown out.

This is the small per-row helper behind ``render``. It keeps a stack of open
elements; closing an element turns what it collected into Markdown and hands
it to its parent. What can be done on a column (script removal, line ends,
blank lines, trimming, encoding repair) is done in Spark around it.
"""

from __future__ import annotations

import re
from html import unescape

WS = " \t\n\r\x00\x0b"

# ---- fixed values: how elements are treated ------------------------------
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
CONTAINERS = frozenset(
    "div section article main figure figcaption details summary address dl fieldset hgroup".split()
)
DROPPED = frozenset(
    "script style noscript iframe form input textarea select button svg canvas video audio map "
    "object embed nav header footer aside".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# -------------------------------------------------------------------------
LISTS = frozenset(("ul", "ol"))
SECTIONS = frozenset(("thead", "tbody", "tfoot"))
CELLS = frozenset(("td", "th"))
# Elements that open with more than their own text to collect.
STRUCTURED = LISTS | SECTIONS | frozenset(("table", "li", "tr", "code"))
# Starting one of these closes an open paragraph.
BLOCKS = HEADINGS | CONTAINERS | LISTS | frozenset(
    "p table blockquote pre hr form nav header footer aside".split()
)
# An end tag may close these on its way; anything else stops it.
INLINE = frozenset(
    "a abbr b big cite code em font i kbd label mark q s samp small span strike strong sub sup time "
    "tt u var".split()
)
# Tags that close an open one of the same family, and where the search stops.
SIBLINGS = {
    "li": (frozenset(("li",)), LISTS),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
    "td": (CELLS, frozenset(("tr", "table"))),
    "th": (CELLS, frozenset(("tr", "table"))),
    "tr": (frozenset(("tr",)), SECTIONS | {"table"}),
    "thead": (SECTIONS, frozenset(("table",))),
    "tbody": (SECTIONS, frozenset(("table",))),
    "tfoot": (SECTIONS, frozenset(("table",))),
}
END_STOPS = {
    "li": LISTS, "td": frozenset(("table",)), "th": frozenset(("table",)),
    "tr": frozenset(("table",)), "thead": frozenset(("table",)),
    "tbody": frozenset(("table",)), "tfoot": frozenset(("table",)),
}
# Elements nested deeper are not opened; their text goes to the element around them. The
# lower limit is for elements whose Markdown repeats something for each level.
MAX_DEPTH = 6000
MAX_REPEATED = 32
REPEATED = LISTS | frozenset(("table", "blockquote"))
_SPACES = re.compile(r"[ \t]+")
_ANY_SPACE = re.compile(r"[ \t\n\x0b\f\r]+")
_LANGUAGE = re.compile(r"language-(\w+)", re.ASCII)


# A named reference needs its semicolon, so '?a=1&copy=2' stays an address.
_REFERENCE = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[a-zA-Z][a-zA-Z0-9]*;)")


def decode(text: str) -> str:
    """Text with its character references resolved."""
    if "&" not in text:
        return text
    return _REFERENCE.sub(lambda found: unescape(found[0]), text)


class _Open:
    """An open element and what it has collected so far."""

    items = None  # list items, or table rows in document order
    depth = 0  # nesting level of a list
    item = False  # an li that belongs to a list
    bare = False  # direct child of such an li: only its inside counts
    raw = None  # untouched text, kept inside pre and code only
    code = None  # first code element of a pre
    secs = ()  # table sections that collect rows below here
    paragraph = 0  # place of the open p that only inline elements part from here
    barrier = 0  # place of the nearest element that is not inline

    def __init__(self, tag, attrs=""):
        self.tag = tag
        self.attrs = attrs
        self.parts = []  # Markdown pieces


def _rtrim(parts: list[str]) -> None:
    while parts:
        kept = parts[-1].rstrip(WS)
        if kept:
            parts[-1] = kept
            return
        parts.pop()


def _trimmed(parts: list[str]) -> str:
    """The pieces as one text without white space around it; a single piece is not copied."""
    _rtrim(parts)
    first = 0
    while first < len(parts) and not parts[first].lstrip(WS):
        first += 1
    if first < len(parts):
        parts[first] = parts[first].lstrip(WS)
    return "".join(parts[first:]) if first else "".join(parts)


def _few(parts: list[str]) -> list[str]:
    """The same text in few pieces, so that handing it on through many levels stays cheap."""
    return parts if len(parts) < 64 else ["".join(parts)]


def _block(parts: list[str], text: str) -> None:
    """Append a block, with a blank line before it unless it comes first."""
    if any(parts):
        _rtrim(parts)
        parts.append("\n\n")
    parts.append(text)
    parts.append("\n\n")


def _after_break(parts: list[str], text: str) -> None:
    """Append a block that always starts on a new paragraph."""
    _rtrim(parts)
    parts.append(f"\n\n{text}\n\n")


def _table(items: list) -> str:
    rows = []
    for kind, part in items:
        if kind == "row":
            rows.append((part[0], False))
        else:
            rows.extend((cells, kind == "thead" or th) for cells, th in part)
    rows = [row for row in rows if row[0]]
    if not rows:
        return ""
    width = max(len(cells) for cells, _ in rows)
    ruler = "| " + " | ".join(["---"] * width) + " |"
    lines, ruled = [], False
    for cells, is_header in rows:
        lines.append("| " + " | ".join(cells + [""] * (width - len(cells))) + " |")
        if is_header and not ruled:
            lines.append(ruler)
            ruled = True
    text = "\n".join(lines)
    if not ruled:
        first, _, rest = text.strip(WS).partition("\n")
        text = f"{first}\n{ruler}\n{rest}"
    return text.strip(WS)


# A tag with its attributes, or any other markup declaration. Quoted values may
# hold '>'; a tag whose quotes do not pair up ends at the first '>'.
_TOKEN = re.compile(
    r"""<(?:(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+|[^>]*+)|[!?/][^>]*+)>"""
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")


def _attributes(text: str) -> dict[str, str]:
    """Attribute values by lower-case name; the first of a name counts."""
    found: dict[str, str] = {}
    for name, value in _ATTRIBUTE.findall(text):
        if value[:1] in ("'", '"'):
            value = value[1:].removesuffix(value[0])
        found.setdefault(name.lower(), decode(value))
    return found


class _Fold:
    def __init__(self, home: str):
        self.home = home.rstrip("/")
        self.in_body = False
        self._clear()

    def _clear(self):
        self.stack = [_Open("#root")]
        self.places = {}  # of the open elements of each tag

    # ---- events ----
    def feed(self, page):
        # text, then slash, name and attributes of the tag behind it, and so on
        pieces = iter(_TOKEN.split(page))
        text, start, end = self._text, self._start, self._end
        for data in pieces:
            if data:
                text(data)
            closing = next(pieces, None)
            tag = next(pieces, None)
            attrs = next(pieces, None)
            if tag is not None:
                if closing:
                    end(tag.lower())
                else:
                    start(tag.lower(), attrs)

    def _start(self, tag, attrs):
        if tag == "body":
            if not self.in_body:  # what came before belongs to the head
                self.in_body = True
                self._clear()
            return
        if tag == "html":
            return
        if tag in BLOCKS:
            self._close_paragraph()
        family = SIBLINGS.get(tag)
        if family:
            self._close_until(*family)
        if tag in VOID:
            self._void(tag, attrs)
        elif len(self.stack) > MAX_DEPTH or (tag in REPEATED and len(self.places.get(tag, ())) >= MAX_REPEATED):
            if tag in BLOCKS:
                self.stack[-1].parts.append("\n\n")
        else:
            self._push(tag, attrs)

    def _end(self, tag):
        stack = self.stack
        if stack[-1].tag == tag:
            self._close_down_to(len(stack) - 1)
            return
        if tag in ("body", "html") or tag in VOID:
            return
        at = self._last(tag)
        if at == 0 or self._last_of(END_STOPS.get(tag, ())) > at:
            return
        if (tag in INLINE or tag == "p") and stack[-1].barrier > at:
            return
        self._close_down_to(at)

    def _last(self, tag):
        """Place of the innermost open element of a tag, else 0."""
        places = self.places.get(tag)
        return places[-1] if places else 0

    def _last_of(self, tags):
        return max(map(self._last, tags), default=0)

    def _text(self, data):
        data = decode(data)
        top = self.stack[-1]
        if top.raw is not None:
            top.raw.append(data)
        if top.item:
            top.parts.append(_ANY_SPACE.sub(" ", data))
        elif top.tag not in LISTS:
            if "  " in data or "\t" in data:  # most text needs no change
                data = _SPACES.sub(" ", data)
            top.parts.append(data)

    # ---- stack ----
    def _push(self, tag, attrs):
        parent = self.stack[-1]
        node = _Open(tag, attrs)
        if parent.raw is not None or tag == "pre" or tag == "code":
            node.raw = []
        if parent.item:
            node.bare = tag not in LISTS
        if parent.secs:
            node.secs = parent.secs
        place = len(self.stack)
        if tag in INLINE:
            node.paragraph, node.barrier = parent.paragraph, parent.barrier
        else:
            node.barrier = place
            if tag == "p":
                node.paragraph = place
        self.places.setdefault(tag, []).append(place)
        if tag not in STRUCTURED:
            self.stack.append(node)
            return
        if tag in LISTS:
            node.items = []
            if parent.item:
                node.depth = self.stack[-2].depth + 1
        elif tag == "table":
            node.items = []
        elif tag == "li":
            node.item = parent.tag in LISTS
        elif tag in SECTIONS and parent.tag == "table":
            node.items = []
            parent.items.append((tag, node.items))
            node.secs = (*parent.secs, node)
        elif tag == "tr":
            node.items = [[], False]  # cells, has a th
            if parent.tag == "table":
                parent.items.append(("row", node.items))
            for section in node.secs:
                section.items.append(node.items)
        elif tag == "code":
            owner = self._last("pre")
            if owner and self.stack[owner].code is None:
                self.stack[owner].code = node
        self.stack.append(node)

    def _close_paragraph(self):
        if self.stack[-1].paragraph:
            self._close_down_to(self.stack[-1].paragraph)

    def _close_until(self, family, stops):
        at = self._last_of(family)
        if at > self._last_of(stops):
            self._close_down_to(at)

    def _close_down_to(self, at):
        stack = self.stack
        while len(stack) > at:
            node, parent = stack.pop(), stack[-1]
            self.places[node.tag].pop()
            if node.raw is not None and parent.raw is not None:
                parent.raw.append("".join(node.raw))
            self._emit(node, parent)

    def finish(self) -> str:
        self._close_down_to(1)
        return "".join(self.stack[0].parts)

    # ---- Markdown ----
    def _void(self, tag, attrs):
        top = self.stack[-1]
        if top.item or top.tag in LISTS:
            return
        if tag == "br":
            _rtrim(top.parts)
            top.parts.append("  \n")
        elif tag == "hr":
            _after_break(top.parts, "---")
        elif tag == "img":
            attrs = _attributes(attrs)
            src = attrs.get("src") or ""
            if src:
                if not src.startswith(("http", "//")):
                    src = f"{self.home}/{src.lstrip('/')}"
                _block(top.parts, f"![{attrs.get('alt') or ''}]({src})")

    def _emit(self, node, parent):
        tag, out = node.tag, parent.parts
        if parent.tag in LISTS and not node.item:
            return
        if node.item:
            number = len(parent.items) + 1
            mark = f"{number}. " if parent.tag == "ol" else "- "
            text = "".join(node.parts).strip(WS)
            parent.items.append(f"{'  ' * parent.depth}{mark}{text}\n")
        elif node.bare:
            out.append("".join(node.parts))
        elif tag in LISTS:
            listed = "".join(node.items)
            if parent.item:
                out.append("\n" + listed)
            elif listed.strip(WS):
                _after_break(out, listed.strip(WS))
        elif tag in CELLS and parent.tag == "tr":
            text = "".join(node.parts)
            parent.items[0].append(text.strip(WS))
            parent.items[1] = parent.items[1] or tag == "th"
            out.append(text)
        elif tag in DROPPED:
            return
        elif tag in HEADINGS:
            text = "".join(node.parts).strip(WS)
            if text:
                _block(out, f"{'#' * int(tag[1])} {text}")
        elif tag == "p" or tag in CONTAINERS:
            text = _trimmed(node.parts)
            if text:
                _block(out, text)
        elif tag in ("strong", "b"):
            out += ["**", *_few(node.parts), "**"]
        elif tag in ("em", "i"):
            out += ["*", *_few(node.parts), "*"]
        elif tag == "a":
            href = _attributes(node.attrs).get("href") or ""
            text = "".join(node.parts).strip(WS)
            out.append(f"[{text}]({href})" if text and href else text)
        elif tag == "blockquote":
            text = "".join(node.parts).strip(WS)
            if text:
                _after_break(out, "> " + text.replace("\n", "\n> "))
        elif tag == "pre":
            source, language = node, ""
            if node.code is not None:
                source = node.code
                found = _LANGUAGE.search(_attributes(source.attrs).get("class") or "")
                language = found.group(1) if found else ""
            _after_break(out, f"```{language}\n{''.join(source.raw)}\n```")
        elif tag == "code":
            out.append(f"`{''.join(node.raw)}`")
        elif tag == "table":
            text = _table(node.items)
            if text:
                _after_break(out, text)
        else:
            out += _few(node.parts)


def fold(page: str, home: str = "") -> str:
    """Markdown of one page whose scripts, styles and comments are gone."""
    if not page:
        return ""
    folder = _Fold(home)
    folder.feed(page)
    return folder.finish()
