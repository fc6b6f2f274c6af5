"""A small labelled table of page blocks: what the decision tree of html_text learns from.

Each page is a list of (markup, label); the markup of a page is read as one document, and
the label holds for the blocks that its part begins: 1 for the article, 0 for the rest.
W stands for words, L for linked words.
"""

from __future__ import annotations

import re
from itertools import product

_PAGES = """
nav>ul>li|L1|0 nav>ul>li|L1|0 nav>ul>li|L2|0 div.ad|W9.|0 article>h1|W6|1 article>p|W40.|1 article>p|W1.|1 article>p|W25.|1 footer|W12|0
header|W3|0 header>nav>a|L4|0 main>h1|W8.|1 main>p|W30.|1 main>ul>li|W5|1 main>ul>li|W9.|1 main>p|L3|1 aside|W20.|0 aside>ul>li|L4|0 footer|W6|0
div.menu>a|L2|0 div.menu>a|L1|0 div#content>h2|W5|1 div#content>p|W60.|1 div#content>p|W3.|1 div.sidebar>p|W25.|0 div.comments>p|W30.|0 div.comments>p|W8.|0 div.footer|W9|0
div|L2|0 div|L1|0 div|L2|0 h1|W7|1 p|W45.|1 p|W80.|1 p|W4.|1 p|W50.|1 div|L3|0 div|L2|0 div|L1|0
article>header>h1|W9|1 article>header>p|W4|1 article>p|W35.|1 article>blockquote|W12.|1 article>div.ad|W10.|0 article>p|W33.|1 article>aside|W22.|0 article>p|W2.|1 article>div.share>a|L1|0 article>section#comments>p|W40.|0 article>footer|W7|0
div.cookie-notice|W24.|0 div.cookie-notice>a|L2|0 nav|L8|0 div.post>h1|W5.|1 div.post>p|W55.|1 div.post>pre|W14|1 div.post>table>tr>td|W2|1 div.post>table>tr>td|W6|1 form>p|W11.|0 form>label|W2|0 div.related>ul>li|L6|0 div.related>ul>li|L7|0
form|W4|0 table>tr>td|L1|0 table>tr>td|L2|0 p|W38.|1 p|W52.|1 p|W6.|1 div.banner|W14.|0 div.newsletter>p|W18.|0
main>article>h1|W4|1 main>article>p|W1|1 main>article>p|L9|1 main>div.comments>article>p|W21.|0 main>div.comments>article>p|W3.|0 div.promo|W16.|0
div|W3|0 div|L3|0 div|W48.|1 div|W64.|1 div|W41.|1 div|L2|0 div|W2|0
nav>ul>li|L1|0 article>p|W1.|1 footer|W30.|0
section>h2|W3|1 section>p|W20.|1 section>p|W28.|1 section.alert>p|W30.|0 div.widget>p|W9.|0
header>h1|W3|0 header>p|W12.|0 div.entry>p|W5.|1 div.entry>p|W7.|1 div.entry>p|L2|1 footer>p|W16.|0
article>p|W3|1
article>h1|W5|1 article>p|W1|1
div.post|W4|1
div.content>p|W2|1 div.content>ul>li|L1|1 div.content>ul>li|L2|1
article>ul>li|L3|1 article>p|W1|1 article>p|L1|1 article>h2|W2|1
p|W30.|1
p|W9.|1 p|W14.|1
h1|W4|1 p|W12|1
div|L1|0 p|W22.|1
div|W45.|1
section>h1|W6|1 section>p|W11.|1 section>p|W2.|1
nav|L1|0 main>div|W1|1
p|W3|0
div|W1|0 div|L1|0
ul>li|L1|0 ul>li|L1|0 ul>li|L2|0 p|W9.|1 p|W30.|1 p|W18.|1 ul>li|L2|0 ul>li|L1|0
article>p|W30.|1 article>p.share-price|W12.|1 article>p.share-price|W6.|1 article>div.notice>p|W20.|1 article>div.share|W2|0 article>div.share>a|L2|0 article>p|W28.|1
article>p.search-index|W9|1 article>p.search-index|W15.|1 article>div.alert|W30.|1 article>div.social|W3|0 article>div.social>a|L1|0 article>div.related>ul>li|L6|0
main>section.discussion>p|W25.|1 main>section.discussion>p|W5.|1 main>section.discussion>p|W3.|1 main>div.related>p|L5|0 main>div.related>p|L9|0
article>aside|W1|0 article>p|W2.|1 article>aside>h2|W2|0 article>aside>p|W1.|0 article>aside>p|W60.|0 article>p|W2|1 article>footer|W1|0
main>h1|W1|1 main>div.sidebar|W1|0 main>div.sidebar>ul>li|W4|0 main>p|W9.|1 main>div.sidebar>p|W5.|0 main>div.sidebar>h2|W3|0
div.search|W2|0 div.cookie|W20.|0 article>div.cookie-consent>p|W3.|0 div.alert|W9.|0 div.social|L3|0 div.notice|W40.|0
div|L2|0 div|L1|0 div|W40.|1 div|L6|1 div|W52.|1 div|W35.|1 div|L2|0 div|W8|0
p|W45.|1 p|L8|1 p|W38.|1 p|W3.|1 p|W47.|1 div|L3|0 div|W7.|0 div|L1|0
table>tr>td|L1|0 table>tr>td|W6.|0 table>tr>td|L2|0 p|W34.|1 p|L12|1 p|W60.|1 table>tr>td|L4|0 table>tr>td|W11|0
div|L1|0 div|L3|0 div|W5|0 div|L2|0 div|W55.|1 div|W6.|1 div|W48.|1 div|L1|0 div|W14.|0 div|L1|0
div|L2|0 div|W12.|0 div|L1|0 h1|W6|1 div|W30.|1 div|L4|1 div|W28.|1 div|L9|0 div|L2|0 div|W16|0
table>tr>td|L2|0 table>tr>td|L3|0 table>tr>td|W50.|1 table>tr>td|W2.|1 table>tr>td|W44.|1 table>tr>td|L3.|1 table>tr>td|W70.|1 table>tr>td|L5|0 table>tr>td|W9.|0
article>p|L2|1 article>p|W6.|1 article>p|L3|1 article>p|W12|1 article>p|L1|1
"""


def _layouts() -> list[str]:
    """Pages of one element, where only the neighbours tell short and linked blocks apart, and the same in an article."""
    out = []
    for n, (long, short) in enumerate(product((17, 22, 28, 36, 50, 75), (2, 4, 6, 9, 12))):
        tag = ("div", "p", "table>tr>td")[n % 3]
        plain = (
            f"L1|0 W{short}.|0 L{long}|0 L2|0 W{long}.|1 L{short}|1 W{long + 5}.|1 W{short}.|1 W{long + 9}.|1 "
            f"L{1 + n % 4}|0 W{short + 1}|0 L1|0 W{short}|0"
        )
        out.append(" ".join(f"{tag}|{block}" for block in plain.split()))
        out.append(" ".join(f"main>{tag}|{block[:-1]}1" for block in plain.split()))
        for around in product(("L1", "L2", "W1.", "W2"), ("L1", "L2", "W1.", "W2")):
            out.append(" ".join(f"article>p|{block}|1" for block in (around[0], f"W{short}.", around[1])))
        for within in ("", "article>"):  # named boilerplate beside the same neighbours
            beside = [f"{name}|{kind}{n_words}|0" for name, kind, n_words in product(("div.ad", "aside", "div.sidebar>p"), "WL", (short, f"{long}."))]
            out.append(" ".join(f"{within}{block} {within}p|W{long + 3}.|1" for block in beside))
        out.append(" ".join(f"{block} {tag}|W{long + 3}.|1" for block in (f"nav|W{short}.|0", f"div.alert|W{short}.|0", f"footer|W{long}|0")))
        inside = f"W{short}|1 W{long}.|1 L{short}|1 W{short}.|1 L2|1 W1.|1 L1|1 W{short}.|1 L3|1"
        out.append(" ".join(["nav|L2|0", *(f"article>p|{block}" for block in inside.split()), f"footer|W{short}|0"]))
    return out


def _rows_of_blocks() -> list[str]:
    """Short blocks of one tag in a row: paragraphs of dialogue, lists of things. Two in a row say nothing."""
    out = []
    for short, n in product((1, 2, 3, 4, 6, 9), (3, 4, 6)):
        for stop in ("", "."):
            for tag in ("p", "ul>li", "div"):
                row = " ".join([f"{tag}|W{short}{stop}|1"] * n)
                out.append(f"h1|W3|1 {row}")
                out.append(row)
                out.append(f"nav|L2|0 div>p|W{30 + n}.|1 {row} div>p|W{28 + n}.|1 div.footer|W{short}|0 div|L2|0")
                out.append(f"div|L1|0 div|L2|0 {row} p|L1|0 div|L1|0")
        out.append(f"div|L1|0 p|W{short}|0 p|W{short}|0 div|L{n}|0")
    return out


def _markup(path: str, text: str) -> str:
    match = re.fullmatch(r"([WL])(\d+)(\.?)", text)
    words = " ".join(["word"] * int(match[2])) + match[3]
    if match[1] == "L":
        words = f'<a href="/x">{words}</a>'
    opened, closed = "", ""
    for step in path.split(">"):
        tag, kind, name = re.fullmatch(r"(\w+)([.#]?)([\w-]*)", step).groups()
        attribute = {".": f' class="{name}"', "#": f' id="{name}"', "": ""}[kind]
        opened, closed = f"{opened}<{tag}{attribute}>", f"</{tag}>{closed}"
    return f"{opened}{words}{closed}"


def pages() -> list[tuple[str, list[int]]]:
    """(html, label of each block) of each page."""
    out = []
    for line in [*_PAGES.strip().splitlines(), *_layouts(), *_rows_of_blocks()]:
        parts = [part.split("|") for part in line.split()]
        html = "".join(_markup(path, text) for path, text, _ in parts)
        out.append((f"<html><body>{html}</body></html>", [int(label) for *_, label in parts]))
    return out
