import random
import re
import time
from itertools import product

import pytest

from lodequery.llm import main_text, queries
from tests.conftest import SF

LONG = "A sentence of some length that stands here, with commas and an end. " * 3
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h1>Site name</h1></header><nav><ul><li><a href="/x">One</a></li><li><a href="/y">Two</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies. Accept them, please, all of them.</p></div>
<article><h1>Title &amp; more</h1><p>{LONG}</p><p>Short.<div class="ad">Buy now. Really, it is good.</div><p>x&nbsp; y<br>z &lt;b&gt;</p>
<form><p>Sign up. Enter it here.</p><input></form><p><b>Last</b> one, with <a href="/l">a link</a>, ends here.</p><script>no()</script></article>
<section id="comments"><article class="comment"><p>{LONG}</p></article></section>
<aside class="sidebar"><p>{LONG}</p></aside><footer>&copy; someone. {LONG}</footer></body></html>"""
WANT = "\n".join(["Title & more", LONG.strip(), "Short.", "x y z <b>", "Last one, with a link, ends here."])


def test_the_article_alone():
    assert main_text.main_text(PAGE) == WANT


def test_without_article_element():
    page = f'<body><div class="menu"><a href=a>A</a> <a href=b>B</a></div><div><h2>Head</h2><p>{LONG}</p><p>Tiny.</p><p>{LONG}</p></div><div class="footer">Legal. {LONG}</div>'
    assert main_text.main_text(page) == "\n".join(["Head", LONG.strip(), "Tiny.", LONG.strip()])


def test_class_words_of_the_whole_page_say_nothing():
    assert main_text.main_text(f'<body class="with-sidebar"><p>{LONG}</p></body>') == LONG.strip()


@pytest.mark.parametrize("words", ["post has-comments", "content-area with-sidebar", "content no-sidebar", "entry story-share", "page form-page", "main-content search-results", "text-legal", "reader-view", "content", "wrap"])
@pytest.mark.parametrize("inner", ["{}", "<article>{}</article>", "<form action=x>{}</form>"])
def test_class_words_around_the_text(words, inner):
    text = f"<h1>Head</h1><p>{LONG}</p><p>{LONG}</p>"
    page = f'<body><nav><a href=a>Alpha</a> <a href=b>Beta</a></nav><div class="{words}">{inner.format(text)}</div><footer>&copy; someone</footer></body>'
    assert main_text.main_text(page) == "\n".join(["Head", LONG.strip(), LONG.strip()])


def test_comments_and_teasers_beside_an_article_go_however_long():
    page = f'<article><p>{LONG}</p></article><section id="comments"><article><p>{LONG * 9}</p></article></section><div class="related-posts"><article><p>{LONG * 9}</p></article></div>'
    assert main_text.main_text(page) == LONG.strip()


def test_links_and_formulas_of_an_article_stay():
    links = "".join(f'<li><a href="/{i}">Item {i}</a></li>' for i in range(5))
    page = f"<article><p>{LONG}</p><ul>{links}</ul><p>It is <math><mi>x</mi><mo>=</mo><mn>1</mn></math>.</p></article>"
    assert main_text.main_text(page).split("\n") == [LONG.strip(), *(f"Item {i}" for i in range(5)), "It is x=1."]


@pytest.mark.parametrize("page", [
    "".join(f'<p>{LONG}</p><div class="ad">Buy now, {i}.</div>' for i in range(10_000)), "<a" * 500_000 + ">", "<div>" * 30_000 + "x", "<div></b></i></x>" * 30_000, "<p>a <!" * 30_000, "<p title='" * 30_000,
    "<table><tr><td>" * 20_000, "<div class=ad>x" * 20_000,
])
def test_time_is_near_linear(page):
    started = time.perf_counter()
    main_text.main_text(page)
    assert time.perf_counter() - started < 12


@pytest.mark.parametrize("page, want", [
    (None, ""), ("", ""), ("   ", ""), ("<p", ""), ("<script>never closed", ""), ("<!-- open", ""),
    (f"<article><p>{LONG}</p><p>cut <b", f"{LONG.strip()}\ncut"), (f"<article><p>{LONG}<a href=\"x", LONG.strip()),
    (f"<article><p title='a > b'>{LONG}</article></div></p></article>", LONG.strip()), (f"<ARTICLE><P>{LONG}</P></ARTICLE>", LONG.strip()),
])
def test_odd_pages(page, want):
    assert main_text.main_text(page) == want


def test_long_page_is_not_cut():
    page = "<article>" + f"<p>{LONG}</p>" * 3000 + "</article>"
    assert main_text.main_text(page).count("\n") == 2999


def test_minimum_cut_against_all_cuts():
    r = random.Random(6)
    for _ in range(150):
        n = r.randint(1, 8)
        gain = [r.uniform(-3, 3) for _ in range(n)]
        edges = [(i, j, r.uniform(0, 2)) for i in range(n) for j in range(i) if r.random() < 0.5]
        cost = lambda side: sum(g if not s else 0 for g, s in zip(gain, side, strict=True) if g > 0) + sum(-g for g, s in zip(gain, side, strict=True) if g < 0 and s) + sum(c for i, j, c in edges if side[i] != side[j])  # noqa: B023, E731
        assert cost(main_text.minimum_cut(gain, edges)) == pytest.approx(min(map(cost, product([False, True], repeat=n))))


def test_op7_on_the_table(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op7_minimum_cut(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)
        inside = re.search(r"<article>(.*?)(</article>|\Z)", pages[r.page_id].html, re.DOTALL)[1]
        assert r.text.split() == [w for w in main_text.entities.unescape(re.sub(r"<[^>]*(>|\Z)", " ", inside)).split()]


def test_op7_cases(spark):
    rows = [(1, None, "u", 5), (None, PAGE, None, 5), (2, PAGE, "u", 5), (2, PAGE, "u", 5), (3, "", "u", 5)]
    df = spark.createDataFrame(rows, "page_id long, html string, url string, text int")
    got = sorted(((r.page_id, r.url, r.text, r.n_chars) for r in main_text.extract(df, "page_id", "html", ["url"]).collect()), key=repr)
    assert got == sorted(((i, u, main_text.main_text(h), len(main_text.main_text(h))) for i, h, u, _ in rows), key=repr)
    assert main_text.extract(df.limit(0), "page_id", "html", ["url"]).collect() == []


SECTION = "<h2>Part</h2><p>" + "Findings of earlier years are set out here, one after the other, in full. " * 4 + "</p><p>" + "They agree in most points, though not in all of them, as will be seen below. " * 4 + "</p>"
SECTION_TEXT = ["Part", ("Findings of earlier years are set out here, one after the other, in full. " * 4).strip(), ("They agree in most points, though not in all of them, as will be seen below. " * 4).strip()]


@pytest.mark.parametrize("name", ["related-work", "social-policy", "market-share", "reader-letters", "search-engines", "skip-list", "legal-history", "alert-systems", "forms", "discussion", "legal", "sharedMemory", "ad-hoc", "notice-and-comment", "nav-mesh"])
def test_sections_of_an_article_stay(name):
    page = f'<article><h1>Head</h1><p>{LONG}</p><section class="{name}">{SECTION}</section><p>{LONG}</p></article>'
    assert main_text.main_text(page).split("\n") == ["Head", LONG.strip(), *SECTION_TEXT, LONG.strip()]


@pytest.mark.parametrize("inside, want", [
    ("See <svg><title>x</title><path d='M0'/><text>svg</text></svg> the icon and <script>if (a < b) '</p>'</script>then more", "See the icon and then more"),
    ("Press <button type=button>Go <i>now</i></button>or wait", "Press or wait"), ("One <noscript><img src=a><p>x</p></noscript>two", "One two"),
    ("A <picture><source srcset=a><img src=b></picture> picture", "A picture"), ("An <object data=x>old</object>object", "An object"), ("Sum: <output>12</output> of it", "Sum: 12 of it"),
    ("At <meter value=1>half</meter> height", "At half height"), ("The <ruby>kan<rt>read</rt></ruby> sign", "The kanread sign"), ("An <x-term lang=en>own</x-term> element", "An own element"),
    ("No <span hidden>secret <b>and</b> <span>more</span></span>secret", "No secret"), ("Not <i aria-hidden=true>*</i>marked", "Not marked"), ("Out <span style='color:red; display: none'>gone</span>of sight", "Out of sight"),
    ("Pick <select><option>a<option>b</select>one", "Pick one"), ("A <iframe src=x><p>old</p></iframe>frame", "A frame"), ("Left <span hidden>open", "Left"),
])
def test_a_paragraph_stays_whole(inside, want):
    page = f"<article><p>{LONG}</p><p>{inside}</p><p>{LONG}</p></article>"
    assert main_text.main_text(page).split("\n") == [LONG.strip(), want, LONG.strip()]


#: What stands around an article, in hand-made layouts: all of it goes.
AROUND = {
    "header by id": '<div id="header"><h1>My Site</h1><p>Tagline of the whole site, about this and that, with a full stop.</p></div>{}<div id="bottom">All rights reserved by the owners of this site. Do not copy.</div>',
    "header by class": '<div class="site-header"><p>Welcome to the site of many things, dear visitors.</p></div>{}',
    "header by element": "<header><p>Welcome to the site of many things, dear visitors.</p></header>{}",
    "masthead": '<div class="masthead"><h1>The Daily Paper</h1></div>{}',
    "page top": '<div class="page-header"><a href="/">Home</a> <h2>Paper</h2></div>{}<div class="page-bottom">Printed by the printers, in the year of print.</div>',
    "share inside": '<div>{}</div><div class="share-buttons"><p>Share this with all of your friends, today.</p></div>',
    "related list": '{}<div class="related-posts"><ul><li><a href=a>Another story of length</a></li><li><a href=b>One more</a></li></ul></div>',
    "comments": '{}<div class="comment-list"><p>I think that this is right, and so does everyone I know around here.</p></div>',
    "reader comments": '{}<section id="reader-comments"><p>I think that this is right, and so does everyone I know around here.</p></section>',
    "sidebar": '<div class="left-sidebar"><p>About the author, who has written a lot of things over the years.</p></div>{}',
    "cookie bar": '<div id="cookie-banner"><p>We use cookies to make this site work. You may accept them.</p></div>{}',
    "newsletter": '{}<div class="newsletter-signup"><p>Get our letter, every week, for nothing. Sign up here.</p></div>',
    "skip link": '<a class="skip-link" href="#x">Skip</a><div class="skip-to-content"><p>Skip all of this and go on to the content, please.</p></div>{}',
    "breadcrumbs": '<div class="breadcrumbs">You are here: home, news, today.</div>{}',
    "hidden": "{}<div hidden><p>This is not shown to anyone who reads this page here.</p></div>",
    "menu role": '<div role="navigation"><p>Places to go on this site, in order of their names.</p></div>{}',
    "label": '<section aria-label="Related articles"><p>More of the same can be found in these, one and all.</p></section>{}',
    "form": '{}<form action="/s"><p>Write to us, and we write back to you, some day.</p><input name=q></form>',
    "dialog": '<div role="dialog"><p>Your session will end in a short while, so be quick.</p></div>{}',
    "copyright": '{}<p class="copyright">Owned by the owners, who own all of it, for ever.</p>',
    "sponsor": '{}<div class="sponsored-content"><p>This soap is the best of soaps, so buy it now, today.</p></div>',
    "pager": '{}<div class="pagination"><a href=1>1</a> <a href=2>2</a></div>',
}


@pytest.mark.parametrize("layout", AROUND)
@pytest.mark.parametrize("box", ["<article>{}</article>", '<div class="content">{}</div>', "<main>{}</main>", '<div id="post-12"><div class="post-header"><h1>Head</h1></div>{}</div>'])
def test_what_stands_around_an_article_goes(layout, box):
    body = f"<p>{LONG}</p><p>Tiny.</p><p>{LONG}</p>"
    text = main_text.main_text("<html><head><title>T</title><body>" + AROUND[layout].format(box.format(body)) + "</body></html>")
    assert text.split("\n") == (["Head"] if "post-header" in box else []) + [LONG.strip(), "Tiny.", LONG.strip()]


def test_what_is_inserted_in_an_article_goes():
    inserted = '<div class="ad">Buy now, it is good. Really good, they say.</div><div class="share-bar"><p>Share this with friends, do it now.</p></div><aside><p>Also read that other one.</p></aside><div class="social-links"><a href=a>X</a></div>'
    page = f"<article><p>{LONG}</p>{inserted}<p>{LONG}</p></article>"
    assert main_text.main_text(page).split("\n") == [LONG.strip()] * 2
