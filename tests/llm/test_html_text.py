import time

import pytest

from mirrorleaf.llm import html_text as ht
from mirrorleaf.llm import html_training


def text(html):
    return ht.main_texts([html], ht.trained_tree())[0]


def test_the_tree_knows_its_table():
    for html, labels in html_training.pages():
        _, rows = ht.blocks(html)
        assert ht.trained_tree().predict(ht.with_neighbours(rows)).tolist() == [bool(x) for x in labels]


CASES = [
    ("<nav><a>Home</a></nav><article><h1>T &amp; U</h1><p>One  two\nthree<br>four.</p><p>To.</p></article><footer>x</footer>", "T & U\n\nOne two three four.\n\nTo."),
    ("<article><p><b>open<br><p>next</p></article>", "open\n\nnext"),
    ("<header>Site</header><main><p>Short</p><p><a href=x>link only</a></p></main><div class='advert'>Buy this thing now, today.</div>", "Short\n\nlink only"),
    ("<article><p>a</p><section class='comments'><p>hi there, dear reader of mine.</p></section><p>b</p></article>", "a\n\nb"),
    ("<div id='content'><p>Words here.</p><form><p>Your name, please.</p><input></form></div><div class=cookie-notice>We use cookies.</div>", "Words here."),
    ("<article>ok<script>if (a < b) '</p>'</script><style>p{}</style><p>tail <a hr", "ok\n\ntail"),
    ("<article><!-- <p>no</p> --><p>yes &copy; &#233; &lt;p&gt; a < b</p><script>never closed", "yes © é <p> a < b"),
    ("<article><header><h1>Head</h1></header><p>x</p><footer>f</footer><aside>side words here.</aside></article>", "Head\n\nx"),
    ("<p>One two three four five six.</p>", "One two three four five six."),
    ("<body class='no-sidebar'><div class='post no-sidebar'>Hello <i>w</i>orld</div></body>", "Hello world"),
    ("<article><p hidden>gone</p><p>here</p><div style='display: none'>gone</div></article>", "here"),
    ("<article><p class='ad'>Buy it now.<p>text<p id=x>more</article>", "text\n\nmore"),
    ("", ""),
    (None, ""),
    ("<<<>", ""),
    ("</div></p><a", ""),
]


@pytest.mark.parametrize("html, expected", CASES)
def test_cases(html, expected):
    assert text(html) == expected


@pytest.mark.parametrize("html", [
    "<font>" * 40_000 + "<p>x" * 40_000, '<a "' * 100_000, "<div>" * 100_000 + "</section>" * 100_000, "<svg>" * 50_000,
    "<a " * 200_000, "<!--" * 100_000, "<x" + "'" * 300_000, "<div>x</p>" * 60_000, "&amp" * 100_000, "<" * 500_000,
])
def test_hostile_pages_take_linear_time(html):
    start = time.process_time()
    ht.blocks(html)
    assert time.process_time() - start < 8


def test_odd_rows(spark):
    rows = [(k, f"u{k}", html, "x", 1) for k, (html, _) in enumerate(CASES)] + [(None, None, None, None, None), (0, "u0", CASES[0][0], "x", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, n_chars int")
    found = ht.extract_main_text(pages).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.text) for r in found) == sorted(
        [(False, k, t) for k, (_, t) in enumerate(CASES)] + [(True, 0, ""), (False, 0, CASES[0][1])]
    )
    assert ht.extract_main_text(pages.limit(0)).count() == 0


def test_generated_pages(spark):
    import re
    from html import unescape

    from mirrorleaf.llm.queries import op7_html_text

    sf = "/root/testdata/sf0.01"
    html = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for row in op7_html_text(spark, sf).collect():
        article = re.search(r"<article>(.*?)(</article>|$)", html[row.page_id], re.S)[1]
        parts = [" ".join(unescape(re.sub(r"<[^>]*>?", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert row.text == "\n\n".join(p for p in parts if p) and row.n_chars == len(row.text)


@pytest.mark.parametrize("html, expected", [
    ("<article><section id='discussion'><h2>Discussion</h2><p>Two words.</p><p>It says more here.</p></section></article>", "Discussion\n\nTwo words.\n\nIt says more here."),
    ("<article><h2 id='related-work'>Related work</h2><p id='x'>Others did so.</p></article>", "Related work\n\nOthers did so."),
    ("<main><div id='related-work-1'><h2>2. <b>Related</b> Work</h2><p>Yes.</p></div></main>", "2. Related Work\n\nYes."),
    ("<article><p>One.</p><p class='share-price'>The share price rose by ten percent today.</p></article>", "One.\n\nThe share price rose by ten percent today."),
    ("<article><p>As <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds.</p></article>", "As x=2 holds."),
    ("<article><p>a</p><div class='share'><a>Share</a></div><section id='comments'><h2>Comments</h2><p>Nice text, thank you all.</p></section></article>", "a"),
    ("<p>One two three four five six.</p><div class='alert'>You have to log in to read all this.</div>", "One two three four five six."),
])
def test_names_that_article_parts_have_as_well(html, expected):
    assert text(html) == expected


LONG = ["The river rose in the night and by the morning the lower road could not be used by any of the carts, so people walked.",
        "Later in the week the water fell again, and the council met to speak about the bridge that had been promised years ago.",
        "Nobody was hurt, but the mill lost its wheel and two barns that stood near the bank were taken away by the stream."]


@pytest.mark.parametrize("tag", ["<div>{}</div>", "<table><tr><td>{}</td></tr></table>"])
def test_neighbours_decide_on_pages_without_article_markup(tag):
    link = lambda x: f"<a href='/x'>{x}</a>"
    linked, short = "Read the report of the mill here", "It was May."
    blocks = [
        link("Home"), "We use cookies on this site.", link("News today"), LONG[0], link(linked), LONG[1], short, LONG[2],
        link("About us"), "Copyright 2024 The Valley Paper and its writers", link("Imprint"), "All rights reserved by the owner",
    ]
    assert text("".join(tag.format(b) for b in blocks)).split("\n\n") == [LONG[0], linked, LONG[1], short, LONG[2]]


def test_the_tree_splits_on_neighbours():
    assert {7, 9} <= set(ht.trained_tree().feature.tolist())


def test_a_form_around_the_page_is_no_form():
    page = "".join(f"<p>{x} {x}</p>" for x in LONG)
    kept = "\n\n".join(f"{x} {x}" for x in LONG)
    assert text(f'<form id="aspnetForm"><input type="hidden" name="v"><div class="content">{page}</div></form>') == kept
    inner = "<form><label>Name</label><input><textarea>x</textarea><p>Write to us, and say what you think of it all.</p><button>Send</button></form>"
    assert text(f"<form><input type='hidden'>{page}</form>{inner}") == kept
    assert text(f"<article>{page}{inner}</article>") == kept and text(f"{page}{inner}") == kept
    assert text(inner) == ""


@pytest.mark.parametrize("blocks", [
    ["<h1>A tale</h1>", "<p>He came in.</p>", "<p>She sat.</p>", "<p>They left.</p>"],
    ["<div>", "<p>He came in.</p>", "<p>She sat.</p>", "<p>They left.</p>", "<p>It was late.</p>", "</div>"],
    [f"<p>{LONG[0]}</p>", "<ul><li>a</li>", "<li>b b</li>", "<li>c</li>", "<li>d</li></ul>", f"<p>{LONG[1]}</p>"],
    ["<ul>", *["<li>two eggs</li>"] * 4, "</ul>"],
])
def test_rows_of_short_blocks_stay(blocks):
    import re

    words = [re.sub("<[^>]*>", "", b) for b in blocks]
    assert text("".join(blocks)) == "\n\n".join(w for w in words if w)


def test_links_and_single_lines_are_no_rows():
    links = "".join(f"<li><a href=x>Page {k}</a></li>" for k in range(5))
    assert text(f"<ul>{links}</ul><p>{LONG[0]}</p><div>Tel. 12</div><div><a>Imprint</a></div>") == LONG[0]


@pytest.mark.parametrize("html, kept", [
    (f'<main><div class="cookie-recipe"><p>{LONG[0]}</p></div></main>', True),
    (f'<main><section id="newsletter-history"><p>{LONG[0]}</p></section></main>', True),
    (f'<article><div class="banner-image"><p>{LONG[0]}</p></div></article>', True),
    ('<article><p>Text.</p><div class="newsletter-box"><p>Write your address here.</p></div></article>', False),
    ('<article><p>Text.</p><div class="cookie-consent"><p>Yes, please.</p></div></article>', False),
    (f'<article><p>Text.</p><div class="ad-story"><p>{LONG[0]}</p></div></article>', False),
])
def test_names_with_a_subject_of_their_own(html, kept):
    assert (LONG[0] in text(html)) is kept and ("Text." in text(html)) is not kept


def test_notices_in_plain_blocks():
    page = "".join(f"<div>{x}</div>" for x in LONG)
    cookies = "<div>We use cookies to make this site work and to see who reads it.</div>"
    rights = "<div>Copyright 2024 by the writers of the valley paper</div>"
    assert text(cookies + page + rights) == "\n\n".join(LONG)
    assert text(f"<article><p>{LONG[0]}</p><p>My grandmother baked, and our cookies were gone by noon each day.</p></article>").endswith("each day.")


def test_a_heading_is_read_to_its_end():
    data = "x" * 5_000
    html = f'<article><section id="related-work"><h2><span data-x="{data}">Related work</span></h2><p>Others did so.</p></section></article>'
    assert text(html) == "Related work\n\nOthers did so."
    name = "t" * 300
    assert text(f"<{name} '><p>x y</p></{name}><p>{LONG[0]}</p>").endswith(LONG[0])


@pytest.mark.parametrize("layout", range(6))
def test_generated_layouts(layout):
    """Pages of several layouts, put together from parts of known role."""
    import random

    rnd = random.Random(layout)
    words = lambda n: " ".join(rnd.choice("river mill stone winter bread letter garden harbour paper cloud".split()) for _ in range(n))
    good = total = 0
    for _ in range(40):
        parts = [(f"<p>{(w := words(rnd.randrange(20, 60)))}.</p>", w + ".", True) for _ in range(rnd.randrange(2, 7))]
        parts.insert(0, (f"<h1>{(w := words(4))}</h1>", w, True))
        menu = "".join(f"<li><a href='/x'>{words(rnd.randrange(1, 3))}</a></li>" for _ in range(rnd.randrange(3, 9)))
        foot = f"<div class='footer'><p>{words(8)}</p></div>"
        body = "".join(html for html, *_ in parts)
        around = ["<div>{}</div>", "<article>{}</article>", "<main>{}</main>", "<div id='content'>{}</div>", "<form><input type=hidden>{}</form>", "<section class='post'>{}</section>"][layout]
        page = f"<html><body><nav><ul>{menu}</ul></nav>{around.format(body)}<div class='sidebar'><ul>{menu}</ul></div>{foot}</body></html>"
        total += 1
        good += text(page) == "\n\n".join(t for _, t, main in parts if main)
    assert good >= 0.95 * total
