"""Main text of web pages by minimum-cut labelling of blocks.

A page is cut into blocks at its block-level elements. A classifier gives each block a log-odds of being content,
from the elements around it (their tags, roles and class words), its links, length and punctuation; positive
log-odds are the capacity of its edge from the source, negative ones that of its edge to the sink. Edges between blocks that follow each
other, and between neighbours in the same container, have capacities that fall with the distance in the DOM. A
maximum flow saturates the cheapest set of edges that parts source and sink; blocks that the source
still reaches are content. So a short paragraph stays with its neighbours, and an advert in their midst goes.

A class name speaks against its container only if it is made of such words alone ("comments", "share-buttons"): "related-work" or "market-share" doesn't. Words that may also
name a section of an article ("discussion") don't count against prose in one. Class words of a container (and a form around all) are set aside where it holds most of the
page's text and no other text is marked as an article. The classifier's weights are fixed, as no table has labelled blocks.

Blocks end at block-level elements and nowhere else: a picture, a script, a button or an element of unknown name within a paragraph leaves it whole, and what it holds
of hidden or skipped text goes without a gap.

Time is linear in the page, but for the cut's rounds (few, as paths are short). Very long pages are taken whole, one at a time.

Defined results: null and empty pages have an empty text; of pages that break off, the part that is there counts, without an
unfinished tag at the end; repeated rows are extracted each; an empty table gives no rows. Only the columns named are read.
"""
from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodequery.llm.shared import batched, rows_of, small_batches

# What HTML elements are.
BLOCKS = frozenset(
    "address article aside blockquote body caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head "
    "header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is none of the page's; those that hold nothing but text; and those that may lack an end tag.
SKIPPED = frozenset("script style title textarea template noscript svg iframe object canvas select button datalist option audio video head".split())
RAW = frozenset("script style title textarea iframe".split())
UNENDED = frozenset(("head", "option"))
#: What closes an open element without an end tag.
CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Words of tags, roles and classes that stand for what is not, or is, the article.
AWAY_TAGS = frozenset("nav footer aside form menu dialog fieldset".split())
AWAY_WORDS = frozenset(
    "ad ads advert advertisement adverts alert announcement banner bottombar breadcrumb breadcrumbs comment comments complementary consent contentinfo "
    "cookie cookies copyright dialog disclaimer discussion feedback footer form legal login masthead menu menubar modal nav navbar navigation "
    "newsletter notice notification notifications outbrain pager pagination paywall popup promo promoted promotion reader recommended related "
    "replies reply respond search share sharing sidebar signup social sponsor sponsored subscribe subscription taboola teaser teasers toolbar topbar "
    "tracking trending widget widgets".split()
)
#: Of these, what may as well be the name of an article's section.
SOFT_WORDS = frozenset("alert announcement discussion disclaimer feedback legal notice promotion reader recommended related respond search share social tracking trending".split())
#: Words that leave the meaning of such a word as it is.
PARTNERS = frozenset(
    "list lists link links item items box bar area section block container wrapper wrap inner outer holder group row col column grid card cards panel pane module unit slot zone "
    "frame site page global main top bottom left right header head heading title body content text post posts article articles story stories entry entries button buttons icon "
    "icons btn input field fields count thread strip tabs tab toggle close fixed sticky floating mobile desktop primary secondary sub user inline".split()
)
#: Names of links past the menus.
SKIP_NAMES = frozenset(("skip", "skip link", "skip links", "skip nav", "skip navigation", "skip to content", "skip content", "skip main"))
#: What names the top and the bottom of a page, outside its articles.
EDGE_WORDS = frozenset("header masthead branding tagline bottom".split())
EDGE_PARTNERS = frozenset("site page global main top wrapper wrap container inner box bar area section app the".split())
#: First words of class names that tell what else the page has.
MODIFIERS = frozenset("no not with without has have is".split())
#: Elements that may stand around a whole page.
AROUND = frozenset(("form", "fieldset"))
#: Characters outside links from which a section of an article is prose.
PROSE = 200
#: A container with more than this part of the text, and fewer than so many characters marked as an article outside it, isn't boilerplate by its words.
MOST_TEXT, FEW_MARKED = 0.5, 100
HERE_WORDS = frozenset("article articlebody body content entry main post story text".split())

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.DOTALL)
_UNFINISHED = re.compile(r"<(?:[a-zA-Z/!?]|\Z)")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_WORD = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")


@dataclass(eq=False)
class Node:
    """An open element: how its name and words speak for or against content, the text in it, and its place in the tree."""

    tag: str
    hidden: bool
    depth: int
    parent: Node | None
    in_article: bool
    article: bool = False
    here: bool = False
    away: bool = False  # by what the element is
    away_words: bool = False  # by its class words, or a form
    soft: bool = False  # by no other than words that may name a section
    within: bool = False  # itself or an element around it is said to be the content
    text: int = 0  # characters outside links
    marked: int = 0  # of these, in something like an article and nothing that isn't content
    odds: float = 0.0


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    node: Node


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(raw)} if raw.strip(" /\n\t") else {}


def _names(attrs: dict[str, str]) -> list[list[str]]:
    """The words of each class name, id or role; a label is one name."""
    names = [t for k in ("class", "id", "role", "itemprop") for t in attrs.get(k, "").split()] + [attrs.get("aria-label", "")]
    found = ([w.lower() for w in _WORD.findall(n) if not w.isdigit()] for n in names)
    return [words for words in found if words and words[0] not in MODIFIERS]


def _made_of(words: list[str], main: frozenset, partners: frozenset) -> bool:
    return any(w in main for w in words) and all(w in main or w in partners for w in words)


def _hidden(tag: str, attrs: dict[str, str]) -> bool:
    return tag in SKIPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in attrs.get("style", "").replace(" ", "")


def _opened(tag: str, attrs: dict[str, str], parent: Node) -> Node:
    names = [] if tag in ("html", "body") else _names(attrs)
    article = tag in ("article", "main") or attrs.get("role") in ("main", "article") or attrs.get("itemprop") == "articleBody"
    here = any(w in HERE_WORDS for words in names for w in words)
    away = tag in AWAY_TAGS and tag not in AROUND or tag == "header" and not parent.in_article
    against = [words for words in names if _made_of(words, AWAY_WORDS, PARTNERS) or " ".join(words) in SKIP_NAMES]
    if not (parent.in_article or parent.within or here):
        against += [words for words in names if _made_of(words, EDGE_WORDS, EDGE_PARTNERS)]
    soft = bool(against) and tag not in AROUND and all(len(words) == 1 and words[0] in SOFT_WORDS for words in against)
    within = parent.within or here or article
    return Node(tag, parent.hidden or _hidden(tag, attrs), parent.depth + 1, parent, parent.in_article or article, article, here, away, tag in AROUND or bool(against), soft, within)


def _judge(nodes: list[Node], found: list[Block]) -> None:
    """Sets the odds of all nodes, which are in page order, parents first."""
    marked, clean = {nodes[0]: False}, {nodes[0]: True}
    for e in nodes[1:]:
        clean[e] = clean[e.parent] and not e.away and not e.away_words
        marked[e] = marked[e.parent] or e.article or e.here
    for b in found:
        n = max(0, len(b.text) - b.linked)
        b.node.text += n
        b.node.marked += n if marked[b.node] and clean[b.node] else 0
    for e in reversed(nodes[1:]):
        e.parent.text += e.text
        e.parent.marked += e.marked
    root = nodes[0]
    for e in nodes[1:]:
        around = e.text > MOST_TEXT * root.text and root.marked - e.marked < FEW_MARKED
        prose = e.soft and e.parent.in_article and e.text >= PROSE
        if e.away or e.away_words and not around and not prose:
            e.odds = min(e.parent.odds, 0.0) - 5.0
        else:
            good = 0.0 if e.parent.odds <= -5.0 else 3.0 if e.article else 1.0 if e.here else 0.0  # nothing in boilerplate is made good by its name
            e.odds = e.parent.odds + good


def _raw_end(page: str, at: int, name: str) -> int:
    """Where an element ends that holds nothing but text."""
    end = re.compile(f"</{name}[^>]*>", re.IGNORECASE).search(page, at)
    return end.end() if end else len(page)


def _past(page: str, at: int, name: str) -> int:
    """Where an inline element ends: at its end tag, or before that of a block around it."""
    depth, opened = 1, Counter()
    while m := _TAG.search(page, at):
        at, found = m.end(), (m[2] or m[5] or "").lower()
        closing = m[1] or m[4]
        if found == name:
            depth += -1 if closing else 1
            if not depth:
                return at
        elif found in RAW and not closing:
            at = _raw_end(page, at, found)
        elif found in BLOCKS and found not in VOID:
            if closing and not opened[found]:
                return m.start()
            opened[found] += -1 if closing else 1
    return len(page)


def blocks(page: str | None) -> list[Block]:
    """Blocks with text, in page order."""
    page = page or ""
    if m := _UNFINISHED.search(page, page.rfind(">") + 1):
        page = page[: m.start()]
    out: list[Block] = []
    node = Node("", False, 0, None, False)
    nodes, is_open = [node], Counter()
    held: list[str] = []
    linked, in_link, at = 0, False, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text and not node.hidden:
                out.append(Block(text, linked, node.tag in HEADINGS, node))
            held.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not node.hidden:
            text = entities.unescape(raw) if "&" in raw else raw
            held.append(text)
            if in_link:
                linked += len(text.strip())

    while m := _TAG.search(page, at):
        say(page[at : m.start()])
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, raw = (m[1], m[3]) if m[2] else (m[4], m[6])
        if name not in BLOCKS:
            if name == "br":
                say(" ")
            if name in VOID:
                continue
            if name in RAW and not closing:
                at = _raw_end(page, at, name)
            elif not closing and (name in SKIPPED or "hidden" in raw or "none" in raw) and not raw.endswith("/") and _hidden(name, _attributes(raw)):
                at = _past(page, at, name)
            elif name == "a":
                in_link = not closing
            continue
        flush()
        if closing:
            while is_open[name]:
                is_open[node.tag] -= 1
                stop, node = node.tag == name, node.parent
                if stop:
                    break
            continue
        if name in VOID:
            continue
        for tag in CLOSES.get(name, ("p", *HEADINGS)):
            if node.tag == tag and node.parent is not None:
                is_open[tag] -= 1
                node = node.parent
        if name in CLOSES and node.tag == name and node.parent is not None:
            is_open[name] -= 1
            node = node.parent
        if name == "body":  # whatever the head left open
            while node.parent is not None and node.tag != "html":
                is_open[node.tag] -= 1
                node = node.parent
        node = _opened(name, _attributes(raw), node)
        nodes.append(node)
        is_open[name] += 1
    say(page[at:])
    flush()
    _judge(nodes, out)
    return out


def odds(b: Block) -> float:
    """The classifier's log-odds of content, from fixed weights."""
    n = max(1, len(b.text))
    ends = sum(b.text.count(c) for c in ".!?;:。！？")
    length = min(len(b.text), 300) / 300
    return b.node.odds - 0.8 + 3.0 * length + (0.8 if ends else 0.0) - (1.0 if b.node.in_article and b.node.odds > 0 else 5.0) * min(1.0, b.linked / n) + (0.5 if b.heading else 0.0) * (1 + b.node.in_article)


#: Distances in the tree aren't told apart beyond this.
FAR = 40


def distance(a: Node, b: Node) -> int:
    """Edges between two elements of the tree, FAR at most."""
    n = 0
    while a is not b and n < FAR:
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
        n += 1
    return n


#: Capacity between blocks one edge apart in the tree; falls with their distance.
SMOOTH = 1.2


def neighbours(found: list[Block]) -> list[tuple[int, int, float]]:
    """(i, j, capacity) of blocks that follow each other, and of the next in the same container past others."""
    edges, last = [], {}
    for j, b in enumerate(found):
        box = id(b.node.parent)
        i = last.get(box)
        if j:
            edges.append((j - 1, j, SMOOTH / max(1, distance(found[j - 1].node, b.node) - 1)))
        if i is not None and i != j - 1:
            edges.append((i, j, SMOOTH / 2))
        last[box] = j
    return edges


def minimum_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the source's side of a minimum cut.

    gain: capacity from the source if positive, to the sink if negative. Dinic's rounds: levels by distance from nodes with capacity left
    from the source, then paths that go down one level at a time until none is left, each edge being given up once it leads nowhere.
    """
    left = list(gain)
    near: list[list[list]] = [[] for _ in gain]
    for i, j, c in edges:
        there, back = [j, c, None], [i, c, None]
        there[2], back[2] = back, there
        near[i].append(there)
        near[j].append(back)
    while True:
        level = {i: 0 for i, g in enumerate(left) if g > 1e-9}
        starts, queue, met = list(level), deque(level), False
        while queue:
            i = queue.popleft()
            met = met or left[i] < -1e-9
            for e in near[i]:
                if e[1] > 1e-9 and e[0] not in level:
                    level[e[0]] = level[i] + 1
                    queue.append(e[0])
        if not met:
            return [i in level for i in range(len(gain))]
        tried = [0] * len(gain)
        for start in starts:
            path, i = [], start
            while left[start] > 1e-9:
                if left[i] < -1e-9:
                    amount = min(left[start], -left[i], *(e[1] for e in path)) if path else 0.0
                    left[start] -= amount
                    left[i] += amount
                    for e in path:
                        e[1] -= amount
                        e[2][1] += amount
                    path, i = [], start
                elif tried[i] < len(near[i]):
                    e = near[i][tried[i]]
                    if e[1] > 1e-9 and level.get(e[0]) == level[i] + 1:
                        path.append(e)
                        i = e[0]
                    else:
                        tried[i] += 1
                elif path:
                    i = path.pop()[2][0]
                    tried[i] += 1
                else:
                    break


def main_text(page: str | None) -> str:
    """The content blocks of a page, a line each."""
    found = blocks(page)
    kept = minimum_cut([odds(b) for b in found], neighbours(found))
    return "\n".join(b.text for b, k in zip(found, kept, strict=True) if k)


def extract(df: DataFrame, id_col: str, html_col: str, keep: list[str] = ()) -> DataFrame:
    """id_col, the columns in keep, ``text`` and ``n_chars`` (code points) of every page; a narrow step, without a shuffle."""
    small_batches(df.sparkSession)
    cols = [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = pa.schema([*(b.schema.field(c) for c in cols), ("text", pa.string()), ("n_chars", pa.int64())])
            texts = ((*r[1:], t, len(t)) for r in rows_of([b], html_col, *cols) for t in [main_text(r[0])])
            yield from batched(texts, out)

    fields = [*(df.schema[c] for c in cols), StructField("text", StringType()), StructField("n_chars", LongType())]
    return df.select(html_col, *cols).mapInArrow(run, StructType(fields))
