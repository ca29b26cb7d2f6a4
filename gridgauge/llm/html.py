"""Main text of web pages by line-block distribution.

Markup is stripped to one line for each block of text; each boundary of a region (``div``, ``section``, ``td``
and the like) is a window of empty lines.  Tag structure only weighs lines: a line counts its characters
outside links, three times in ``article`` or ``main``, and nothing in a region that can't be part of an article
(menus, footers, sidebars, forms, adverts, reader comments).  The weights are summed over a sliding window.
The distribution of the sums gives the page's threshold, ``SURGE`` of their own-weighted mean: text surges
where a sum rises to it and dives where a sum falls to zero, and what stands between is the article's core.

Around the core stays what belongs to it: the other lines of the smallest region that holds all surging text
(short paragraphs, captions, lists), a first heading before it, and, beside it, regions of its kind that hold a
paragraph, a heading or the like, or a sentence, with all their lines, however short and in whatever script.  Runs
of lines that are only links go if they stand before or after the core, except in ``article`` and ``main`` and in
closing paragraphs.  A copyright notice goes if nothing but such and links follows it.

Cases: null or empty html, and pages without a line of text, have the empty text; broken, nested and unclosed
markup is read as browsers do, as far as blocks are concerned, and in time in proportion to the page's length; a
page of nothing but links keeps them; equal pages give equal texts, so repeated rows and ties change nothing; an
empty table gives an empty result; pages are read whole.  Other columns of the table aren't looked at, whatever
their names; ``keep`` columns named ``text`` or ``n_chars`` are refused.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridgauge.llm.common import per_batch

#: Lines in a window; threshold as a share of the windowed sums' own-weighted mean; weight of a character in article or main.
WINDOW, SURGE, ARTICLE = 3, 0.25, 3

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg math canvas select textarea button audio video title".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
REGIONS = frozenset("article aside body center details dialog div fieldset footer form head header main menu nav search section td th".split())
BOILERPLATE = frozenset("nav aside footer form head menu dialog search".split())
CLOSES_P = BLOCKS - frozenset("body caption dd dt head html legend li option optgroup summary tbody td tfoot th thead tr".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
LISTS = ("ul", "ol", "dl", "table")
#: What can stand in a head.
HEAD = frozenset("base link meta noscript script style template title".split())
INSIDE = frozenset(("article", "main"))
#: Words of a class, an id or a role that mark a container as no part of an article, if all other words of the name are neutral.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising advertorial banner banners sponsor sponsored sponsors promo promos promotion promotions promoted"
    " nav navbar navigation menu menus menubar breadcrumb breadcrumbs pagination pager toc toolbar topbar"
    " sidebar sidebars aside rail widget widgets footer header masthead contentinfo complementary"
    " notice notices cookie cookies consent gdpr alert alerts popup popups modal overlay disclaimer paywall toast dialog"
    " comment comments commentlist commentary respond disqus reply replies discussion reactions"
    " share sharing social follow newsletter subscribe subscription signup login related recommended recommendations trending"
    " search searchbox form copyright legal hidden".split()
)
NEUTRAL = frozenset(
    "area article articles bar block body bottom box button buttons card cards col column container content desktop entry fixed float global group head holder icons inner item items"
    " left level link links list main middle mobile module news outer page pane panel post posts primary reader readers right row secondary section site slot sticky story sub text"
    " thread top unit user users view wrap wrapper zone".split()
)
#: Words for an article after one of its topics; words of names of an article's own header.
ARTICLES, TOPICS = frozenset("article articles content news page post story text".split()), frozenset("copyright discussion legal notice notices promotion search social".split())
OWN_HEADER = frozenset("article content entry post story".split())
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style|href)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: A quote that nothing closes is a character like any other, so a tag always ends at the first ``>`` outside quotes or with the page.
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*+)(?:>|\Z)""", re.S)
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}
#: Elements that hold running text; what opens a copyright notice.
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote dd figcaption caption summary".split())
NOTICE = re.compile(r"\W*(?:©|\(c\)|copyright\b)\W*(?:\(c\)|©|by\b|\d{4})|\W*all rights reserved\b|.{0,80}\ball rights reserved\W*\Z", re.I | re.S)
SENTENCE = re.compile(r"[.!?…。！？][\"'”’»)\]]*\Z")
#: A region's mark: none, by its element, by its name (or a form).
PLAIN, BY_ELEMENT, BY_NAME = 0, 1, 2


def says_dull(token: str, in_article: bool) -> bool:
    """Whether a class name or an id says that the container is no part of an article: all its words do, or are neutral."""
    words = [w.lower() for w in NAME.findall(token)]
    if not words:
        return False
    found = MARKS.intersection(words)
    if "".join(words) in MARKS:
        found = found | {"".join(words)}
    elif not found or not MARKS.union(NEUTRAL).issuperset(words):
        return False
    if words[-1] in ARTICLES and found <= TOPICS:
        return False
    return not (found <= {"header", "masthead"} and (in_article or OWN_HEADER.intersection(words)))


def mark(name: str, attributes: str, in_article: bool) -> int:
    """How the element is marked as no part of an article."""
    if name == "form":
        return BY_NAME
    if name in BOILERPLATE or name == "header" and not in_article:
        return BY_ELEMENT
    if not attributes or name in ("html", "body", "main"):
        return PLAIN
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return BY_ELEMENT
        if key in ("class", "id", "role") and any(says_dull(token, in_article) for token in value.split()):
            return BY_NAME
    return PLAIN


class Page:
    """Lines of text with their places among all lines, and the tree of regions that they stand in.  A region comes after its parent."""

    def __init__(self, html: str):
        self.texts: list[str] = []
        self.weights: list[int] = []
        self.places: list[int] = []
        self.of: list[int] = []  # region of a line
        self.block: list[str] = []  # innermost block or region of a line
        self.parent, self.kind, self.marks, self.inside, self.holds = [0], [("", "")], [PLAIN], [False], [0]
        self.place = 0
        self.gap = True
        self.held: list[str] = []
        self.linked: list[str] = []
        self.stack: list[tuple[str, int]] = [("", 0)]  # name, region
        self.open: dict[str, list[int]] = {}  # places in the stack by name
        self.blocks: list[int] = [0]  # places in the stack of blocks other than p
        self.link = 0  # depth of the stack at an open link
        self.read(html)
        self.flush()

    def flush(self) -> None:
        if self.held:
            text = " ".join(unescape("".join(self.held)).split())
            self.held.clear()
            if text:
                linked = len(" ".join(unescape("".join(self.linked)).split())) if self.linked else 0
                name, region = self.stack[-1]
                self.texts.append(text)
                self.weights.append(max(0, len(text) - linked))
                self.places.append(self.place)
                self.of.append(region)
                self.block.append(name)
                self.place += 1
                self.gap = False
            self.linked.clear()

    def boundary(self) -> None:
        if not self.gap:
            self.place += WINDOW
            self.gap = True

    def say(self, text: str) -> None:
        self.held.append(text)
        if self.link:
            self.linked.append(text)

    def push(self, name: str, region: int) -> None:
        self.open.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS and name != "p":
            self.blocks.append(len(self.stack))
        self.stack.append((name, region))

    def close(self, k: int) -> None:
        """End the open elements from place ``k`` of the stack on."""
        self.flush()
        for at in range(len(self.stack) - 1, k - 1, -1):
            name, region = self.stack.pop()
            self.open[name].pop()
            if self.blocks[-1] == at:
                self.blocks.pop()
            if region != self.stack[-1][1]:
                self.boundary()
        if len(self.stack) < self.link:
            self.link = 0

    def last(self, names) -> int:
        return max((self.open[n][-1] for n in names if self.open.get(n)), default=0)

    def start(self, name: str, attributes: str, alone: bool) -> None:
        """A start tag that is neither void nor raw."""
        if name in BLOCKS:
            self.flush()
            if name in CLOSES_P and (k := self.last(("p",))) > self.blocks[-1]:
                self.close(k)
            if name in SIBLINGS and (k := self.last(SIBLINGS[name])) > self.last(LISTS):
                self.close(k)
        region = self.stack[-1][1]
        if name == "a":
            self.link = len(self.stack) if any(m[1].lower() == "href" for m in ATTRIBUTE.finditer(attributes)) else 0
        said = mark(name, attributes, self.inside[region])
        if name in INSIDE and not said:
            self.holds[region] |= 1 if name == "article" else 2
        if name == "h1":
            self.holds[region] |= 4
        if name in REGIONS or said and not self.marks[region]:
            if alone and name not in BLOCKS:
                return
            self.flush()
            self.boundary()
            self.link = 0
            names = " ".join(sorted((m[2] or "").strip("\"'") for m in ATTRIBUTE.finditer(attributes) if m[1].lower() == "class")) if attributes else ""
            self.parent.append(region)
            self.kind.append((name, names))
            self.marks.append(said)
            self.inside.append(self.inside[region] or name in INSIDE and not said)
            self.holds.append(0)
            self.push(name, len(self.parent) - 1)
        elif name in BLOCKS:
            self.push(name, region)

    def end(self, name: str) -> None:
        if name == "br":
            self.say(" ")
        elif name == "a":
            self.link = 0
        elif name in BLOCKS:
            if k := self.last((name,)):
                self.close(k)
            else:
                self.flush()
        elif (k := self.last((name,))) > self.blocks[-1]:
            self.close(k)

    def read(self, html: str) -> None:
        at, n = 0, len(html)
        absent: set[str] = set()  # raw elements that nothing ends from here on
        while at < n:
            m = TOKEN.search(html, at)
            text = html[at : m.start() if m else n]
            if self.stack[-1][0] == "head" and text.strip():
                self.close(len(self.stack) - 1)
            self.say(text)
            if m is None:
                break
            at = m.end()
            if m[2] is None:
                if m[0].startswith("<![CDATA["):
                    self.say(m[0][9:].removesuffix("]]>"))
                continue
            name = m[2].lower()
            if m[1]:
                self.end(name)
                continue
            if self.stack[-1][0] == "head" and name not in HEAD:
                self.close(len(self.stack) - 1)
            alone = m[0].endswith("/>")
            if name in RAW:
                self.say(" ")
                if alone and name in ("svg", "math"):
                    continue
                if name not in absent and (end := ENDS[name].search(html, at)):
                    at = end.end()
                else:
                    absent.add(name)
                    at = n if name in ("script", "style", "title", "textarea") else at
            elif name in VOID:
                if name == "hr":
                    self.flush()
                elif name == "br":
                    self.say(" ")
            else:
                self.start(name, m[3], alone)


def dull_regions(page: Page) -> np.ndarray:
    """Regions without text of the article.

    A region marked only by its name, or a form, isn't dull if it wraps the page: if it holds a ``main``, an ``article`` with a first heading, or, for forms, any of them.
    """
    holds = list(page.holds)
    for k in range(len(holds) - 1, 0, -1):
        holds[page.parent[k]] |= holds[k]
    dull = np.zeros(len(holds), bool)
    for k in range(1, len(holds)):
        wraps = holds[k] & 2 or (holds[k] if page.kind[k][0] == "form" else holds[k] & 5 == 5)
        dull[k] = dull[page.parent[k]] or page.marks[k] == BY_ELEMENT or page.marks[k] == BY_NAME and not wraps
    return dull


def core(weights: np.ndarray, window: int = WINDOW, surge: float = SURGE) -> np.ndarray:
    """For each line whether it stands between a surge point and the dive point after it."""
    sums = np.convolve(weights, np.ones(window, np.int64))[window - 1 :]  # of the line and the ones after it
    total = sums.sum()
    if not total:
        return np.zeros(len(weights), bool)
    threshold = surge * float(np.square(sums, dtype=float).sum()) / float(total)
    place = np.arange(len(sums))
    starts = (sums > 0) & np.concatenate(([True], sums[:-1] == 0))
    begun = np.maximum.accumulate(np.where(starts, place, 0))
    surged = np.maximum.accumulate(np.where(sums >= threshold, place, -1))
    return (sums > 0) & (surged >= begun)


def kept(page: Page, window: int = WINDOW, surge: float = SURGE) -> np.ndarray:
    """For each line of text whether it belongs to the main text."""
    n = len(page.texts)
    of, places = np.array(page.of), np.array(page.places)
    usable = ~dull_regions(page)[of]
    in_article = np.array(page.inside)[of]
    usable &= ~closing_notices(page, usable & ~in_article)
    own = np.array(page.weights, np.int64) * usable
    if not own.any():
        own = np.array([len(x) for x in page.texts], np.int64) * usable
    lines = np.zeros(page.place + window, np.int64)
    lines[places] = own * np.where(in_article, ARTICLE, 1)
    central = core(lines, window, surge)[places] & usable
    if not (central & (own > 0)).any():
        return central
    first, last = np.flatnonzero(central & (own > 0))[[0, -1]]
    at = np.arange(n)
    between = (at >= first) & (at <= last)
    central &= between
    # The smallest region that holds all surging text.
    counts = np.bincount(of[central], minlength=len(page.parent))
    direct = counts > 0
    for k in range(len(counts) - 1, 0, -1):
        counts[page.parent[k]] += counts[k]
    home = int(np.flatnonzero(counts == central.sum())[-1])
    whole = page.kind[home][0] in ("", "body")
    under = np.zeros(len(counts), bool)
    under[home] = True
    for k in range(home + 1, len(counts)):
        under[k] = under[page.parent[k]]
    links_only = usable & (own == 0)
    beside = np.concatenate(([False], links_only[:-1])) | np.concatenate((links_only[1:], [False]))
    paragraph = np.array([x in PARAGRAPHS for x in page.block])
    menu = links_only & beside & ~between & ~in_article & ~(paragraph & (at > last))
    if whole:
        near = direct[of] | between & (own > 0)
        kinds = {(page.parent[k], page.kind[k]) for k in np.flatnonzero(direct).tolist()}
    else:
        near = under[of]
        kinds = {(page.parent[home], page.kind[home])}
    up = {home}
    k = home
    while k:
        k = page.parent[k]
        up.add(k)
    # Regions beside the core, each with all regions in it.
    beside_core = list(range(len(counts)))
    for k in range(1, len(counts)):
        beside_core[k] = k if (page.parent[k], page.kind[k]) in kinds else beside_core[page.parent[k]]
    wanted = np.flatnonzero(usable & ~central & ~near & (own > 0)).tolist()
    said = {k for k in wanted if paragraph[k] or SENTENCE.search(page.texts[k])}
    belong = {beside_core[page.of[k]] for k in said} - {0} - up
    belong = {k for k in belong if (page.parent[k], page.kind[k]) in kinds}
    for k in wanted:
        region = page.of[k]
        if region in up:
            near[k] = page.block[k] == "h1" and k < first or bool(SENTENCE.search(page.texts[k]))
        else:
            near[k] = beside_core[region] in belong
    return central | usable & near & ~menu


def closing_notices(page: Page, usable: np.ndarray) -> np.ndarray:
    """Lines of copyright notices after which nothing but such, links and unusable lines come; none if nothing else is left."""
    found = np.zeros(len(usable), bool)
    for k in np.flatnonzero(usable & (np.array(page.weights) > 0))[::-1].tolist():
        if not NOTICE.match(page.texts[k]):
            return found
        found[k] = True
    return np.zeros(len(usable), bool)


def main_text(html: str | None, window: int = WINDOW, surge: float = SURGE) -> str:
    page = Page(html or "")
    if not page.texts:
        return ""
    return "\n\n".join(x for x, y in zip(page.texts, kept(page, window, surge).tolist()) if y)


def extract(df: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the ``keep`` columns, ``text`` and ``n_chars`` of each page, in one pass without a shuffle."""
    if clash := {"text", "n_chars"}.intersection((id_col, *keep)):
        raise ValueError(f"columns of the result: {sorted(clash)}; rename those of the table first")
    kinds = dict(df.dtypes)
    df = df.select(id_col, *keep, F.col(html_col).cast("string").alias("gridgauge_html"))

    def make():
        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(x) for x in b.column("gridgauge_html").to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(id_col), *(b.column(c) for c in keep), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[id_col, *keep, "text", "n_chars"])

        return f

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (id_col, *keep)), "text string, n_chars long"])
    return per_batch(df, make, schema)
