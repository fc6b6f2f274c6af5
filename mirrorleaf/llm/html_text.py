"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is cut into blocks at block-level tags. Each block has a word count, the share of
its words that are links, the same of the blocks before and after it, and what its open
elements and their class names say. A decision tree, trained on the labelled table of
html_training, tells the blocks of the article from the rest.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mirrorleaf.llm import html_training
from mirrorleaf.llm.arrow import slices

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/><]*+)((?:"[^"]*+"|'[^']*+'|[^'"<>])*+)>""")
_CLASS = re.compile(r"""\b(class|id|role)\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
# What short blocks say that are about the site, not of the article.
_NOTICE = re.compile(
    r"©|\bcopyright\b|\ball rights reserved\b|\b(?:uses?|accept|our) cookies\b|\b(?:cookie|privacy) policy\b|\bterms of (?:use|service)\b", re.I
)
NOTICE_WORDS = 30  # in a block, at most
_TAG_NAME = re.compile(r"</?([a-zA-Z][^\s/><]*+)")
_UNSEEN = re.compile(r"""type\s*=\s*["']?hidden""", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Element names and class words, grouped by what they say.
RAW = frozenset("script style template noscript title textarea iframe svg object canvas select option button annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong "
    "sub sup time tt u var wbr img math semantics mrow mi mn mo ms mtext mspace mstyle merror mpadded mphantom menclose mfenced "
    "mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts none mtable mtr mtd maction".split()
)
BESIDE = frozenset("nav footer aside dialog menu".split())
FORM = frozenset("form fieldset".split())
CONTROLS = frozenset("input select textarea button label".split())
FORM_WORDS = 30  # for each control of a form, and once more: a form that holds more words is wrapped around a page
WITHIN = frozenset("article main".split())
BESIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads advert adverts advertisement "
    "sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay newsletter subscribe "
    "signup login comment comments reply replies respond discussion share sharing social related recommended widget toolbar "
    "pagination pager search copyright contentinfo complementary".split()
)
# Names that an article's own parts have as well; the tree weighs them against the text.
UNSURE_WORDS = frozenset(
    "menu header promotion notice notices alert reply replies discussion share sharing social related search".split()
)
# Words that name no subject: what stands beside them in a name says what the element is about.
GENERIC_WORDS = frozenset(
    "box bar wrapper wrap container block section area form link links list button inner outer top bottom left right main page site "
    "global widget item items row col column panel slot unit text title body head holder module component js is the".split()
)
# Words that are never about the subject of an article.
ALWAYS_BESIDE = frozenset("nav navbar navigation ad ads advert adverts advertisement sponsor sponsored sidebar masthead breadcrumb breadcrumbs".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond".split())
WITHIN_WORDS = frozenset("article content main post entry story".split())
NEGATIONS = frozenset("no has with without".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

TAGS = {tag: k for k, tag in enumerate("p li div td dd dt blockquote".split(), 1)}  # whose blocks come in rows
IN_BESIDE, IN_WITHIN, IN_UNSURE = 1, 2, 4
FEATURES = 12
_LETTERS = re.compile(r"[^\W\d_]+")
_HEADING_OPENS = re.compile(r"\s*+(?:<(?:div|header|a|span)\b[^<>]*+>\s*+)*+<h[1-6]\b[^<>]*+>", re.I)


def _named_after(name: str, html: str, at: int) -> bool:
    """Whether what follows begins with a heading that has all words of the name."""
    opens = _HEADING_OPENS.match(html, at)
    if opens is None:
        return False
    ends = html.find("</h", opens.end())
    heading = html[opens.end() : ends] if ends >= 0 else ""
    words = _LETTERS.findall(name.lower())
    return set(words) <= set(_LETTERS.findall(unescape(re.sub(r"<[^>]*>", "", heading)).lower())) - COMMENT_WORDS


def _own_flags(tag: str, attributes: str, flags: int, html: str = "", at: int = 0) -> int:
    """Flags of an element inside elements with ``flags``; it is followed by what ``html`` has from ``at`` on."""
    if tag in BESIDE:
        flags |= IN_BESIDE
    elif tag in WITHIN:
        flags |= IN_WITHIN
    elif tag == "header" and not flags & IN_WITHIN:
        flags |= IN_BESIDE
    if attributes and tag not in ("html", "body"):
        names: list[list[str]] = []
        for kind, value in _CLASS.findall(attributes):
            name = ["", *(w.lower() for w in _NAME.findall(value))]
            if kind.lower() == "id" and not BESIDE_WORDS.isdisjoint(name) and (tag in HEADINGS or _named_after(value, html, at)):
                continue
            names += [["", *(w.lower() for w in _NAME.findall(part))] for part in value.split()]
        within = any(w in WITHIN_WORDS for name in names for w in name)
        for name in names:
            # in an article, a name with a subject of its own ("cookie-recipe") is weighed against the text
            subject = flags & IN_WITHIN and any(w and w not in BESIDE_WORDS and w not in GENERIC_WORDS and not w.isdigit() for w in name)
            for before, word in zip(name, name[1:]):
                if word in BESIDE_WORDS and before not in NEGATIONS and not (word == "header" and (within or flags & IN_WITHIN)):
                    unsure = word in UNSURE_WORDS or subject and word not in ALWAYS_BESIDE and word not in COMMENT_WORDS
                    flags |= IN_UNSURE if unsure else IN_BESIDE
        if within:
            flags |= IN_WITHIN
        if _HIDDEN.search(attributes):
            flags |= IN_BESIDE
    return flags


class _Blocks:
    """Text blocks of one page while its tags go by."""

    def __init__(self):
        self.texts: list[str] = []
        self.rows: list[tuple] = []
        self.parts: list[str] = []
        self.linked = 0
        self.tag = ""
        self.open: list[tuple[str, int]] = []  # block-level elements and their flags
        self.count: dict[str, int] = {}
        self.in_link = False
        self.forms: list[list[int]] = []  # controls and words of each form so far
        self.form_of: list[list[int]] = []  # the forms that each block is in
        self.open_forms: list[int] = []

    def text(self, raw: str) -> None:
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            if self.in_link:
                self.linked += len(raw.split())

    def flush(self) -> None:
        words = "".join(self.parts).split()
        if words:
            text = " ".join(words)
            flags = self.open[-1][1] if self.open else 0
            if len(words) <= NOTICE_WORDS and _NOTICE.search(text):
                flags |= IN_UNSURE
            self.texts.append(text)
            self.rows.append((
                len(words), min(1.0, self.linked / len(words)), 2 * bool(flags & IN_BESIDE) or bool(flags & IN_UNSURE), bool(flags & IN_WITHIN),
                self.tag in HEADINGS, self.tag == "li", text[-1] in ".!?…\"'»”", TAGS.get(self.tag, 0),
            ))
            self.form_of.append(list(self.open_forms[-1:]))
            for form in self.open_forms[-1:]:
                self.forms[form][1] += len(words)
        self.parts, self.linked = [], 0

    def control(self, tag: str, attributes: str) -> None:
        if tag in CONTROLS and self.open_forms and not _UNSEEN.search(attributes):
            self.forms[self.open_forms[-1]][0] += 1

    def finished(self) -> np.ndarray:
        """The rows. Blocks of a form, but not of one around the page's text, stand beside the article."""
        self.flush()
        rows = np.array(self.rows, np.float64).reshape(-1, 8)
        real = [words < FORM_WORDS * (1 + controls) for controls, words in self.forms]
        for k, forms in enumerate(self.form_of):
            if any(real[form] for form in forms):
                rows[k, 2] = 2
        return rows

    def start(self, tag: str, attributes: str, html: str = "", at: int = 0) -> None:
        self.control(tag, attributes)
        if tag == "a":
            self.in_link = True
        elif tag == "br":
            self.parts.append(" ")
        elif tag not in INLINE:
            self.flush()
            self.tag = tag
            if self.open and self.open[-1][0] == "p":  # ends where another block begins
                self.open.pop()
                self.count["p"] -= 1
            if tag not in VOID and (tag != "p" or attributes.strip()):
                flags = self.open[-1][1] if self.open else 0
                self.open.append((tag, _own_flags(tag, attributes, flags, html, at)))
                self.count[tag] = self.count.get(tag, 0) + 1
                if tag in FORM:
                    self.open_forms.append(len(self.forms))
                    self.forms.append([0, 0])

    def end(self, tag: str) -> None:
        if tag == "a":
            self.in_link = False
        elif tag not in INLINE and tag not in VOID:
            self.flush()
            self.tag, self.in_link = "", False
            if self.count.get(tag):
                while True:
                    name, _ = self.open.pop()
                    self.count[name] -= 1
                    if name in FORM:
                        self.open_forms.pop()
                    if name == tag:
                        break


def blocks(html: str | None) -> tuple[list[str], np.ndarray]:
    """(text of each block, features of each block without those of its neighbours)."""
    page, at = _Blocks(), 0
    html = html or ""
    size = len(html)
    ends: dict[str, int] = {}  # where a search for an end tag that found none began
    while at < size:
        tag = html.find("<", at)
        if tag < 0 or tag + 1 >= size:
            page.text(html[at : size if tag < 0 else tag])
            break
        page.text(html[at:tag])
        following = html[tag + 1]
        if html.startswith("<!--", tag):
            end = html.find("-->", tag + 2)
            at = size if end < 0 else end + 3
            continue
        if following in "!?":
            end = html.find(">", tag)
            at = size if end < 0 else end + 1
            continue
        if not (following.isascii() and following.isalpha() or following == "/" and html[tag + 2 : tag + 3].isalpha()):
            page.text("<")
            at = tag + 1
            continue
        match = _TAG.match(html, tag)
        if match is None:  # quotes that don't close, or a tag inside a tag
            end = html.find(">", tag)
            if end < 0:
                break
            name = _TAG_NAME.match(html, tag)[1].lower()
            closing, attributes, at = following == "/", "", end + 1
        else:
            closing, name, attributes, at = match[1] == "/", match[2].lower(), match[3], match.end()
        if closing:
            page.end(name)
        elif name in RAW and not attributes.endswith("/"):
            page.control(name, attributes)
            if name not in ends:
                close = re.compile(f"</{name}(?=[\\s/>])[^>]*+>", re.I).search(html, at)
                if close is None:
                    ends[name] = at
            if name in ends:
                if name in ("script", "style", "title", "textarea", "template", "noscript", "iframe"):
                    break  # the rest of the page is inside
            else:
                at = close.end()
            if name not in INLINE:
                page.parts.append(" ")
        else:
            page.start(name, attributes, html, at)
    rows = page.finished()
    return page.texts, rows


def with_neighbours(rows: np.ndarray) -> np.ndarray:
    """Add word count and link density of the block before and after each, and how many blocks
    of its tag without links stand around it in a row; a page is one array."""
    none = np.zeros((1, 2))
    near, tag = rows[:, :2], np.where(rows[:, 1] > 0, -1, rows[:, 7])
    change = np.flatnonzero(np.diff(tag, prepend=np.nan) != 0)
    run = np.repeat(np.diff(np.append(change, len(tag))), np.diff(np.append(change, len(tag)))).astype(np.float64)
    run[tag < 0] = 0
    return np.concatenate(
        [rows[:, :7], np.concatenate([none, near])[:-1][: len(rows)], np.concatenate([near, none])[1:], np.minimum(run, 4)[:, None]], axis=1
    )


class Tree:
    """A binary decision tree by Gini impurity; ties go to the first feature and the least cut."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 14):
        self.feature, self.cut, self.left, self.right, self.value = [], [], [], [], []
        self._grow(x, y, depth)
        for name in ("feature", "cut", "left", "right", "value"):
            setattr(self, name, np.array(getattr(self, name)))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int) -> int:
        node = len(self.feature)
        for name, value in (("feature", -1), ("cut", 0.0), ("left", 0), ("right", 0), ("value", y.mean() > 0.5)):
            getattr(self, name).append(value)
        best = None
        if depth and 0 < y.sum() < len(y):
            for f in range(x.shape[1]):
                values = np.unique(x[:, f])
                for cut in (values[1:] + values[:-1]) / 2:
                    low = x[:, f] <= cut
                    impurity = sum(s.sum() * (1 - s.mean()) for s in (y[low], y[~low]))
                    if best is None or impurity < best[0] - 1e-9:
                        best = (impurity, f, cut)
        if best is not None:
            low = x[:, best[1]] <= best[2]
            self.feature[node], self.cut[node] = best[1], best[2]
            self.left[node] = self._grow(x[low], y[low], depth - 1)
            self.right[node] = self._grow(x[~low], y[~low], depth - 1)
        return node

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        while True:
            open_ = np.flatnonzero(self.feature[node] >= 0)
            if not len(open_):
                return self.value[node].astype(bool)
            at = node[open_]
            low = x[open_, self.feature[at]] <= self.cut[at]
            node[open_] = np.where(low, self.left[at], self.right[at])


@lru_cache(1)
def trained_tree() -> Tree:
    xs, ys = [], []
    for html, labels in html_training.pages():
        _, rows = blocks(html)
        if len(rows) != len(labels):
            raise ValueError("a labelled page has other blocks than labels")
        xs.append(with_neighbours(rows))
        ys.append(np.array(labels, np.float64))
    return Tree(np.concatenate(xs), np.concatenate(ys))


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """The blocks of the article, in page order, with an empty line between them."""
    cut = [blocks(html) for html in pages]
    if not cut:
        return []
    main = tree.predict(np.concatenate([with_neighbours(rows) for _, rows in cut]))
    out, at = [], 0
    for texts, _ in cut:
        out.append("\n\n".join(t for t, m in zip(texts, main[at : at + len(texts)].tolist(), strict=True) if m))
        at += len(texts)
    return out


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tree = trained_tree()
    for whole in batches:
        for batch in slices(whole, "html"):
            texts = main_texts(batch.column("html").to_pylist(), tree)
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text) for each row of ``pages``.

    White space inside a block becomes one space, blocks are joined by an empty line,
    character references are decoded. Null and empty pages, and pages without an article
    block, have an empty text. A page that breaks off inside a script or a tag ends there.
    Repeated rows get a row each; an empty table gives none; other columns are not read.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    schema = f"page_id {dict(rows.dtypes)['page_id']}, url string, text string"
    return rows.mapInArrow(_extracted, schema)
