"""Main text of web pages: the maximum-scoring contiguous region.

A page is a sequence of words and tags. Words score positive, tags and words of links or of boilerplate elements
negative; the weights are log odds counted on labelled pages. One linear scan finds the contiguous region with the
largest sum; what stands in boilerplate elements counts as nothing there. An exact step follows: the region grows to the element
that encloses it and on to the outermost article, main or content container around it (on body level, to the plain text
on either side), and the text of menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments inside it is
left out.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papertrail.llm.common import bounded_batches

# Elements and names of the HTML vocabulary.
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary
table tbody td tfoot th thead title tr ul""".split())
CONTAINER = frozenset("""article aside blockquote body button canvas center details dialog div dl fieldset figure footer form
head header html main menu nav noscript object ol section select svg table tbody td template tfoot th thead tr ul""".split())
BOILERPLATE = frozenset("""aside button canvas dialog footer form head header menu nav noscript object select svg
template""".split())
BOILERPLATE_NAMES = frozenset("""ad ads adsense advert advertisement adverts banner breadcrumb breadcrumbs comment comments
consent cookie cookies disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices
pager pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup social
sponsor sponsored subscribe toolbar widget""".split())
BOILERPLATE_ROLES = frozenset("alert banner complementary contentinfo dialog form menu navigation search".split())
#: Parts of a name that say where or how a piece stands, not what it is; and parts after which a name tells of something else.
LAYOUT_NAMES = frozenset("""area bar block bottom box button buttons container inner item items left link links list right section top wrap
wrapper""".split())
QUALIFIERS = frozenset("has hide no with without".split())
#: What readers write may be longer than the article.
READERS = frozenset("comment comments disqus replies reply respond".split())
CONTENT_NAMES = frozenset("article content entry main post story".split())
NEVER_BOILERPLATE = frozenset("html body article main".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?:(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|(?P<rest>[^>]*)(?:>|\Z))", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME = re.compile(r"[a-z0-9]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in RAW}

#: Marks the main text of a labelled page.
CONTENT, END_CONTENT = "<!--content-->", "<!--/content-->"

# Labelled pages, written for this module; the markers enclose the main text.
LABELLED = [
    """<html><head><title>News</title><style>p{}</style></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/a">World news</a>
</li></ul></nav><article><!--content--><h1>Rain ends the long drought</h1><p>Heavy rain fell over the whole valley on Monday night.</p>
<p>Farmers said that it came just in time for the <b>early</b> harvest.</p><!--/content--></article><footer>&copy; Valley News, all rights
kept</footer></body></html>""",
    """<body><div id="menu"><a href="1">One</a> <a href="2">Two</a></div><div class="cookie-notice">We use cookies on this site. <button>OK
</button></div><div class="post"><!--content--><h2>How to plant a tree</h2><p>Dig a hole that is twice as wide as the roots.<p>Fill it with
soil and water it well for the first two years.<ul><li>Use a stake in windy places.</li><li>Keep grass away from the trunk.</li></ul>
<!--/content--></div><div id="comments"><p>Nice post, thank you!</p><p>Mine died.</p></div></body>""",
    """<html><body><header><a href="/"><img src="l.png">Site name</a></header><aside><h3>Related</h3><ul><li><a href="x">Old story about
boats</a></li><li><a href="y">Another story</a></li></ul></aside><main><!--content--><p>The committee met on Tuesday and agreed on the plan for the new
bridge, which <a href="z">engineers</a> had proposed last year.</p><blockquote>We are pleased.</blockquote><p>Work starts in May.</p>
<!--/content--></main><form><input><button>Subscribe</button></form><footer><a href="/i">Imprint</a></footer></body></html>""",
    """<div class="ad">Buy one, get one free today.</div><div class="text"><!--content--><h1>Soup</h1><p>Cut the onions and fry them slowly.<br>Add
the stock.</p><table><tr><td>Onions</td><td>500 g</td></tr></table><p>Serve hot.</p><!--/content--></div><div class="share"><a>Share</a>
<a>Send</a></div><script>track("</p>")</script>""",
    """<body><table><tr><td><a href=a>A</a><br><a href=b>B</a></td><td><!--content--><p>An old page keeps its menu in a table cell and its text in the
next one, as pages did for many years.<p>It is still easy to read.<!--/content--></td></tr></table></body>""",
    """<body><main><article class="post"><!--content--><h1>A week in the hills</h1><p>We left on Monday and walked for five days along the
old road.</p><p>The weather was kind, and the huts were almost empty.</p><!--/content--></article><div id="comments"><h2>2 comments</h2>
<ol class="comment-list"><li><article class="comment-body"><p>Thank you, I walked there last year and loved it.</p><a href="#r">Reply</a></article>
</li><li><article class="comment-body"><p>Which hut was the best one?</p><a href="#r">Reply</a></article></li></ol></div></main></body>""",
]


class _Page:
    """Text segments of a page and the scored sequence of segments and tags."""

    def __init__(self, source: str, marked: bool = False, spared: frozenset[int] = frozenset()):
        self.spared = spared  # places of elements that their name does not make boilerplate
        self.named: dict[int, tuple[int, bool]] = {}  # element dropped by its name: its place, whether its share of words may spare it
        self.titles: list[int] = []  # elements that hold an h1
        self.texts: list[str] = []
        self.blocks: list[int] = []
        self.homes: list[int] = []  # element that holds the segment
        self.kept: list[bool] = []
        self.links: list[bool] = []
        self.parents, self.names = [-1], [""]
        self.content = [False]  # article, main or named as content
        self.gaps: list[bool] = []  # entries of the sequence inside boilerplate
        self.sequence: list[tuple[str, int, int]] = []  # class, number of words or 1, segment or -1
        self.inside: list[bool] = []  # of labelled pages: whether an entry belongs to the main text
        self._read(source, marked)

    def _read(self, source: str, marked: bool) -> None:
        stack: list[tuple[str, int, bool]] = []
        dropped = links = block = readers = 0  # readers: depth of the outermost open element with what readers wrote
        left_open: dict[str, bool] = {}  # whether the page opens an element more often than it closes it
        inside = False
        at, end = 0, len(source)
        while at < end:
            token = _TOKEN.search(source, at)
            stop = token.start() if token else end
            if stop > at and not (text := source[at:stop]).isspace():
                text = html.unescape(text)
                kind = "boilerplate" if dropped else "link" if links else "word"
                self.sequence.append((kind, len(text.split()), len(self.texts)))
                self.inside.append(inside)
                self.gaps.append(bool(dropped))
                self._segment(text, block, stack, dropped, bool(links))
            elif stop > at:
                self._segment(" ", block, stack, dropped)
            if not token:
                break
            at = token.end()
            name = (token["name"] or "").lower()
            if not name:
                if marked and token.group() in (CONTENT, END_CONTENT):
                    inside = token.group() == CONTENT
                continue
            self.sequence.append((f"</{name}" if token["close"] else f"<{name}", 1, -1))
            self.inside.append(inside)
            self.gaps.append(bool(dropped))
            if name in RAW and not token["close"]:
                closing = _RAW_END[name].search(source, at)
                at = closing.end() if closing else end
                continue
            if name == "h1" and not token["close"]:
                self.titles.append(stack[-1][1] if stack else 0)
            if name in BLOCK:
                block += 1
            elif name == "br":
                self._segment(" ", block, stack, dropped)
            if name == "a":
                links = 0 if token["close"] else 1
            if token["close"]:
                if any(open_name == name for open_name, _, _ in stack):
                    while True:
                        open_name, _, drops = stack.pop()
                        dropped -= drops
                        if open_name == name:
                            break
                    readers = readers if len(stack) >= readers else 0
                continue
            while stack and stack[-1][0] in ("p", "li") and name in BLOCK:  # closed by any following block
                dropped -= stack.pop()[2]
                readers = readers if len(stack) >= readers else 0
            if name in VOID:
                continue
            attributes = token["attrs"] or token["rest"] or ""
            called = _named(attributes) if name not in NEVER_BOILERPLATE or name == "article" else ""
            if name in ("article", "main") and dropped and not readers and called not in READERS:
                # The text is never part of a menu left open: of an element that the page opens more often than it closes.
                for n, _, drops in stack:
                    if drops and n not in left_open:
                        left_open[n] = len(re.findall(rf"<{n}(?=[\s/>])", source, re.I)) > len(re.findall(rf"</{n}(?=[\s/>])", source, re.I))
                stack = [(n, e, drops and not left_open[n]) for n, e, drops in stack]
                dropped = sum(drops for _, _, drops in stack)
            drops = name in BOILERPLATE or (name not in NEVER_BOILERPLATE and _hidden(attributes))
            if called in READERS:
                drops = True
            elif called and not drops and name not in NEVER_BOILERPLATE and token.start() not in self.spared:
                drops = True
                self.named[len(self.names)] = token.start(), not any(n in ("article", "main") for n, _, _ in stack)
            if drops or name in CONTAINER:
                self.parents.append(stack[-1][1] if stack else 0)
                self.names.append(name)
                self.content.append(name in ("article", "main") or (name not in ("html", "body") and _content(token["attrs"] or token["rest"] or "")))
                stack.append((name, len(self.names) - 1, drops))
                dropped += drops
                readers = readers or (len(stack) if called in READERS else 0)

    def _segment(self, text: str, block: int, stack: list, dropped: int, link: bool = False) -> None:
        self.texts.append(text)
        self.links.append(link)
        self.blocks.append(block)
        self.homes.append(stack[-1][1] if stack else 0)
        self.kept.append(not dropped)

    def ancestors(self, home: int) -> list[int]:
        out = []
        while home >= 0:
            out.append(home)
            home = self.parents[home]
        return out


def _hidden(attributes: str) -> bool:
    """Whether an element has a role of boilerplate or is hidden."""
    if not attributes or attributes.isspace():
        return False
    for name, *values in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "role" and value.strip() in BOILERPLATE_ROLES or name == "hidden" or (name, value) == ("aria-hidden", "true"):
            return True
        if name == "style" and _UNSEEN.search(value):
            return True
    return False


def _named(attributes: str) -> str:
    """The boilerplate name in class or id of an element: a whole name or its head word, the last part that does not tell of
    layout (sidebar, site-sidebar, ad-banner, sidebar-left), unless a part before is has, with, no and the like. Else empty."""
    if not attributes or attributes.isspace():
        return ""
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for token in next((v for v in values if v), "").lower().split():
                parts = _NAME.findall(token)
                while len(parts) > 1 and (parts[-1] in LAYOUT_NAMES or parts[-1].isdigit()):
                    parts.pop()
                if parts and parts[-1] in BOILERPLATE_NAMES and QUALIFIERS.isdisjoint(parts):
                    return parts[-1]
    return ""


def _spared(page: _Page) -> frozenset[int]:
    """Places of elements whose name says boilerplate but which hold an h1, or most of the page's plain words outside of
    article and main."""
    if not page.named:
        return frozenset()
    size = len(page.names)
    words, titled, menu = [0] * size, [False] * size, [False] * size
    for e in range(1, size):  # parents come before their children
        menu[e] = menu[page.parents[e]] or page.names[e] in BOILERPLATE
    for text, home, link in zip(page.texts, page.homes, page.links):
        words[home] += 0 if link or menu[home] else len(text.split())
    for home in page.titles:
        titled[home] = True
    for e in range(size - 1, 0, -1):
        words[page.parents[e]] += words[e]
        titled[page.parents[e]] |= titled[e]
    return frozenset(place for e, (place, by_share) in page.named.items() if titled[e] or (by_share and 2 * words[e] > words[0]))


def _content(attributes: str) -> bool:
    """Whether a class or id names an element as content: a whole name or the last part of one (post, entry-content)."""
    for name, *values in _ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id"):
            for token in next((v for v in values if v), "").lower().split():
                if (parts := _NAME.findall(token)) and parts[-1] in CONTENT_NAMES:
                    return True
    return False


def fit_weights(labelled: Iterable[str] = LABELLED) -> dict[str, float]:
    """Weight per class of words and tags: smoothed log odds of standing in the main text, from pages whose main
    text the content markers enclose. Plain words stay positive and all else negative; a tag that the pages do
    not show gets the weight of all tags together."""
    within, without = Counter(), Counter()
    for source in labelled:
        page = _Page(source, marked=True)
        for (kind, count, _), inside in zip(page.sequence, page.inside):
            (within if inside else without)[kind] += count
            if kind[0] == "<":
                (within if inside else without)["<"] += count
    odds = {k: math.log((within[k] + .5) / (without[k] + .5)) for k in {*within, *without}}
    return {k: max(.5, v) if k == "word" else min(-.1, v) for k, v in odds.items()}


def best_region(scores: list[float]) -> tuple[int, int]:
    """First and last entry of the contiguous run with the largest sum, in one pass; of equal sums the first run,
    made as long as possible. (0, -1) if no entry is positive."""
    best, first, last, total, start = 0.0, 0, -1, 0.0, 0
    for i, s in enumerate(scores):
        if total < 0 or (total == 0 and s <= 0):
            total, start = 0.0, i
        total += s
        if total > best or (total == best and best > 0 and start == first):
            best, first, last = total, start, i
    return first, last


def main_text(source: str | None, weights: dict[str, float]) -> str:
    """The main text of one page: blocks joined by a line break, white space inside a block made one blank."""
    if not source:
        return ""
    page = _Page(source)
    if spared := _spared(page):
        page = _Page(source, spared=spared)
    other = weights.get("<", -.1)
    first, last = best_region([0 if gap else weights.get(kind, other) * count for (kind, count, _), gap in zip(page.sequence, page.gaps)])
    met = [seg for _, _, seg in page.sequence[first:last + 1] if seg >= 0 and page.kept[seg]]
    if not met:
        return ""
    common = page.ancestors(page.homes[met[0]])
    for seg in met[1:]:
        if page.homes[seg] != page.homes[met[0]]:
            line = set(page.ancestors(page.homes[seg]))
            common = [e for e in common if e in line]
    top = next((e for e in reversed(common) if page.content[e]), common[0])
    if page.names[top] in ("", "html", "body"):
        chosen = range(_reach(page, met[0], -1), _reach(page, met[-1], 1) + 1)
    else:
        under = {top}
        for element, parent in enumerate(page.parents):  # parents come before their children
            if parent in under:
                under.add(element)
        chosen = [seg for seg, home in enumerate(page.homes) if home in under]
    blocks: dict[int, list[str]] = {}
    for seg in chosen:
        if page.kept[seg]:
            blocks.setdefault(page.blocks[seg], []).append(page.texts[seg])
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def _reach(page: _Page, seg: int, step: int) -> int:
    """Last segment from ``seg`` on that way that is plain text of the body itself; boilerplate between is passed over, a
    link or an element with text of its own ends it."""
    at, reached = seg + step, seg
    while 0 <= at < len(page.texts):
        if page.kept[at] and not page.texts[at].isspace():
            if page.links[at] or page.names[page.homes[at]] not in ("", "html", "body"):
                break
            reached = at
        at += step
    return reached


def extract_main_text(pages: DataFrame, labelled: Iterable[str] = LABELLED, html_column: str = "html") -> DataFrame:
    """``pages`` with ``text`` (empty where there is none) and ``n_chars`` (its code points) in place of the page source.

    A null or empty page has an empty text; pages of any length are read whole; other columns are kept, except
    ``text`` and ``n_chars``; repeated rows stay; an empty table gives an empty one.
    """
    bounded_batches(pages.sparkSession)
    weights = fit_weights(labelled)
    own = [c for c in pages.columns if c not in ("text", "n_chars", html_column)]
    schema = pages.select(own).schema.add("text", "string").add("n_chars", "long")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(source, weights) for source in batch["__html"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in own], pa.array(texts, pa.string()),
                                              pa.array(map(len, texts), pa.int64())], names=[*own, "text", "n_chars"])

    return pages.select(*own, F.col(html_column).alias("__html")).mapInArrow(extract, schema)
