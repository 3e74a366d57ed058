"""Operator 2: main text of web pages by minimum-cut labelling.

A page becomes a sequence of text blocks. A classifier on length, punctuation, link share, tags and class names gives each block a
cost, which becomes the capacity of its edge from the source (content) or to the sink (boilerplate). Smoothness edges join blocks that
follow each other, blocks of the same parent and blocks with the last one of the parent above, heavier the nearer they are in the tree
and lighter across the border of a marked region. A maximum flow on all blocks of the page separates content from boilerplate at the
least total cost: a short line among paragraphs goes with them, the same line among links doesn't.

The scanner takes time in proportion to the page, whatever its markup: nothing is matched with backtracking, elements that are open
are counted by name, and distances in the tree are walked along the path that the scanner took.

Defined cases: a null or empty page has the empty text; broken markup, missing end tags and cut pages are read as far as they go;
an element without end tag reaches to the end of its parent (a script, a style or a comment to the end of the page), and a block that
starts inside an element that can't hold blocks ends it; ties go to boilerplate; null ids and repeated rows stay; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_GAP = re.compile(r"[\s/]*")
_KEY = re.compile(r"=?[^\s/>=]*")
_EQUALS = re.compile(r"\s*=\s*")
_BARE = re.compile(r"[^\s>]*")
_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")

#: Elements whose content is no markup: without end tag, the first two take the rest of the page, the others end at once.
_RAW = {n: re.compile(rf"</{n}(?=[\s/>])[^>]*>?", re.I) for n in ("script", "style", "textarea", "title", "iframe")}
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark math mi mn mo mrow ms mtext msub msup object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An element that a start tag ends if it is open and innermost of its kind, and what stops the search.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_ENDED = frozenset("p li dt dd tr td th option".split())
_STOPS = frozenset("ul ol dl table div section article main aside nav body blockquote".split())
#: Elements that can't hold blocks, and the blocks that end them.
_NARROW = frozenset("svg math select option optgroup datalist".split())
_BLOCKS = frozenset("body p div section article main aside nav header footer h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre form figure".split())

#: Evidence of regions, by tag, role and the words of class names and ids.
_BOILERPLATE_TAGS = frozenset("nav footer aside form button menu dialog fieldset address select option datalist noscript".split())
_UNSEEN_TAGS = frozenset("svg template canvas".split())
_CONTENT_TAGS = frozenset(("article", "main"))
_CONTENT_WORDS = frozenset("article content post entry story main body text".split())
_STRONG_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense breadcrumb breadcrumbs comment comments commentlist consent cookie cookies discussion disqus footer footnav gdpr login menu menubar modal nav navbar navigation "
    "newsletter overlay pager pagination popup promo promoted promotion recommendations replies reply respond sidebar signin signup social sponsor sponsored subscribe subscription toolbar topbar".split()
)
_WEAK_WORDS = frozenset("alert alerts banner banners copyright dialog dropdown feedback form masthead notice notices notification privacy rail reactions recommend recommended related search share sharing skip teaser widget widgets".split())
_UNLESS = frozenset("has with no without is non".split())
_BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

#: Costs in hundredths: what a region gives to each block in it.
STRONG, WEAK, UNSEEN, INSIDE, HINTED = -450, -320, -1000, 30, 20
#: A block's own: for any, each doubling of its length over 25 characters; below that length, else at the end of a sentence; links all over, a copyright line.
SIZE, BASE, DOUBLING, SHORT, SENTENCE, LINKED, COPYRIGHT = 25, -20, 50, -30, 30, -320, -300
TAGS = {"p": 5, "h1": 50, "h2": 50, "h3": 50, "h4": 50, "h5": 50, "h6": 50, "blockquote": 20, "pre": 20, "li": -10, "td": -10, "th": -10}
#: Weights of edges between neighbours, with the last block of the same parent and (the first of a parent) of the parent above; divisor across a region's border.
NEIGHBOUR, SIBLING, ABOVE, BORDER = 120, 60, 110, 4


class _Element:
    """holder: the element whose children a block in this one stands among; block: the innermost that is not inline; near: the innermost open
    one of those that a start tag can end, up to the last that stops the search; scope: that one."""

    __slots__ = ("block", "holder", "level", "linked", "mark", "name", "near", "parent", "scope")

    def __init__(self, name: str, parent: _Element | None, mark: int):
        self.name, self.parent, self.mark = name, parent, mark
        if parent is None:
            self.block = self.holder = self.scope = self
            self.near, self.level, self.linked = None, 0, False
            return
        inline = name in _INLINE
        self.block = parent.block if inline else self
        self.holder = parent.holder if inline or name in TAGS and name not in ("blockquote", "pre") else self
        self.level = parent.holder.level + 1 if self.holder is self else 0
        self.near = self if name in _ENDED else None if name in _STOPS else parent.near
        self.scope = self if name in _STOPS else parent.scope
        self.linked = parent.linked or name == "a"


def _mark(name: str, attrs: dict[str, str], above: int) -> int:
    """The cost that an element gives to what is inside; above: that of its parent."""
    if name in ("html", "body"):
        return above
    own = 0
    if name in _UNSEEN_TAGS or "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
        own = UNSEEN
    elif name in _BOILERPLATE_TAGS or name == "header" and above <= 0 or attrs.get("role", "").lower() in _BOILERPLATE_ROLES:
        own = STRONG
    words = [{w.lower() for w in parts} for key in ("class", "id") for token in attrs.get(key, "").split() if (parts := _PARTS.findall(token)) and parts[0].lower() not in _UNLESS]
    for group in words:
        if group & _STRONG_WORDS:
            own = min(own, STRONG)
        elif group & _WEAK_WORDS or "header" in group and above <= 0:
            own = min(own, WEAK)
    if own == 0:
        if name in _CONTENT_TAGS or attrs.get("role", "").lower() in _CONTENT_TAGS or attrs.get("itemprop", "").lower() == "articlebody":
            own = INSIDE
        elif any(group & _CONTENT_WORDS for group in words):
            own = HINTED
    if own == INSIDE and (name == "main" and above > UNSEEN or above > STRONG):
        return INSIDE
    return min(own, above) if own < 0 or above < 0 else max(own, above)


class Block:
    __slots__ = ("cost", "element", "text")

    def __init__(self, text: str, element: _Element, linked: int, size: int):
        self.text, self.element = text, element
        n = len(text)
        cost = element.mark + BASE + TAGS.get(element.block.name, 0) + round(DOUBLING * math.log2(1 + n / SIZE)) + LINKED * linked // max(size, 1)
        if n < SIZE:
            cost += SHORT
        elif text[-1] in ".!?…:;。！？»”\"":
            cost += SENTENCE
        if text[0] in "©®" or text[:9].lower() == "copyright":
            cost += COPYRIGHT
        self.cost = cost

    @property
    def faint(self) -> bool:
        """Boilerplate by no more than being short."""
        return self.element.mark >= 0 > self.cost >= BASE + SHORT


def weigh(found: list[Block]) -> list[int]:
    """The costs of blocks. A run of short lines, as a list or a table, is evidence once, not for each line."""
    out, at = [b.cost for b in found], 0
    while at < len(found):
        to = at
        while to < len(found) and found[to].faint:
            to += 1
        for i in range(at, to):
            out[i] = -(-out[i] // (to - at))
        at = max(to, at + 1)
    return out


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[dict[str, str], int]:
    """The attributes of a tag from here on, and the place behind its end (that of the page, if it has none)."""
    out: dict[str, str] = {}
    while True:
        at = _GAP.match(page, at).end()
        if at > last[">"]:
            return out, len(page)
        if page[at] == ">":
            return out, at + 1
        key = _KEY.match(page, at)
        at, value = key.end(), ""
        if equals := _EQUALS.match(page, at):
            at = equals.end()
            quote = page[at : at + 1]
            if quote in ('"', "'") and quote and at < last[quote]:
                end = page.index(quote, at + 1)
                value, at = page[at + 1 : end], end + 1
            else:
                bare = _BARE.match(page, at)
                value, at = bare[0], bare.end()
        out.setdefault(key[0].lower(), value)


def blocks(page: str) -> list[Block]:
    root = _Element("", None, 0)
    now, out, seen = root, [], root
    parts: list[str] = []
    linked = size = at = 0
    count: Counter[str] = Counter()
    inside: Counter[tuple[int, str]] = Counter()
    last = {c: page.rfind(c) for c in "\"'>"}
    endless: set[str] = set()

    def flush() -> None:
        nonlocal linked, size
        if parts:
            text = "".join(parts)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(text, seen, linked, size))
            parts.clear()
        linked = size = 0

    def put(text: str) -> None:
        nonlocal linked, size, seen
        if not text:
            return
        if not size:
            seen = now
        parts.append(text)
        if not text.isspace():
            size += len(text)
            if now.linked:
                linked += len(text)

    def close(target: _Element) -> None:
        """End elements up to this one."""
        nonlocal now
        while True:
            e, now = now, now.parent
            count[e.name] -= 1
            inside[id(now.scope), e.name] -= 1
            if e is target:
                return

    def start(name: str, attrs: dict[str, str]) -> None:
        nonlocal now
        if name in _BLOCKS and any(count[x] > 0 for x in _NARROW):
            e, outer = now, None
            while e.parent and e.name not in _STOPS:
                outer = e if e.name in _NARROW else outer
                e = e.parent
            if outer:
                close(outer)
        if name == "a" and inside[id(now.scope), name] > 0:
            e = now
            while e.name != name:
                e = e.parent
            close(e)
        if ends := _ENDS.get(name):
            e = now.near
            while e is not None and e.name not in ends:
                e = e.parent.near
            if e is not None:
                close(e)
        now = _Element(name, now, _mark(name, attrs, now.mark) if attrs or name not in _INLINE else now.mark)
        count[name] += 1
        inside[id(now.parent.scope), name] += 1

    n = len(page)
    while at < n:
        i = page.find("<", at)
        if i < 0 or i + 1 >= n:
            put(page[at:])
            break
        if i > at:
            put(page[at:i])
        c = page[i + 1]
        if c == "!" or c == "?":
            if page.startswith("<!--", i):
                end = page.find("-->", i + 4)
                at = n if end < 0 else end + 3
            else:
                at = page.find(">", i) + 1 if i < last[">"] else n
            continue
        end_tag = c == "/"
        m = _NAME.match(page, i + 1 + end_tag)
        if not m:
            put("<")
            at = i + 1
            continue
        name = m[0].lower()
        at = m.end()
        attrs: dict[str, str] = {}
        if page[at : at + 1] == ">":
            at += 1
        else:
            attrs, at = _attributes(page, at, last)
        if name in ("br", "hr"):
            put(" ")
        if name not in _INLINE:
            flush()
        if end_tag:
            if inside[id(now.scope), name] > 0 or name == now.scope.name or name not in _INLINE and count[name] > 0:
                e = now
                while e.name != name:
                    e = e.parent
                close(e)
            continue
        if name in _VOID:
            continue
        if raw := _RAW.get(name):
            if end := None if name in endless else raw.search(page, at):
                at = end.end()
            elif name in ("script", "style"):
                at = n
            endless |= set() if end else {name}
            continue
        if page[at - 2 : at] != "/>" or name not in _NARROW:
            start(name, attrs)
    flush()
    return out


def _apart(a: _Element, b: _Element) -> int:
    """Steps between two holders in the tree of holders."""
    steps = 0
    while a is not b:
        if a.level >= b.level:
            a = a.parent.holder
        else:
            b = b.parent.holder
        steps += 1
    return steps


def edges(found: list[Block]) -> list[tuple[int, int, int]]:
    """Smoothness edges (i, j, weight): neighbours, weaker the further apart, and the last blocks of the same parent and of the parent above."""
    out, last = [], {}

    def join(i: int, j: int, weight: int) -> None:
        border = found[i].element.mark != found[j].element.mark and min(found[i].element.mark, found[j].element.mark) < 0
        if weight := weight // BORDER if border else weight:
            out.append((i, j, weight))

    for j, b in enumerate(found):
        holder = b.element.holder
        if j:
            join(j - 1, j, NEIGHBOUR * 2 // (2 + _apart(found[j - 1].element.holder, holder)))
        if (i := last.get(id(holder))) is not None:
            join(i, j, SIBLING)
        elif holder.parent and (i := last.get(id(holder.parent.holder))) is not None:
            join(i, j, ABOVE)
        last[id(holder)] = j
    return out


def minimum_cut(costs: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Labels (content or not) of least total cost: a block against its sign pays |cost|, an edge between labels its weight."""
    return _flow(costs, links)


def _flow(costs: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Dinic's maximum flow; what the source still reaches is content."""
    n = len(costs)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to, room = [], []

    def edge(a: int, b: int, there: int, back: int) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, c in enumerate(costs):
        if c > 0:
            edge(source, i, c, 0)
        elif c < 0:
            edge(i, sink, -c, 0)
    for i, j, w in links:
        edge(i, j, w, w)

    def levels() -> list[int]:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in head[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
            if level[sink] >= 0 and level[a] >= level[sink]:
                break
        return level

    while (level := levels())[sink] >= 0:
        tried = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                cut = next(k for k, e in enumerate(path) if not room[e])
                at = to[path[cut] ^ 1]
                del path[cut:]
                continue
            while tried[at] < len(head[at]):
                e = head[at][tried[at]]
                if room[e] and level[to[e]] == level[at] + 1:
                    break
                tried[at] += 1
            if tried[at] < len(head[at]):
                path.append(e)
                at = to[e]
            elif at == source:
                break
            else:
                level[at] = -1
                at = to[path.pop() ^ 1]
    return [x >= 0 for x in levels()[:n]]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join([b.text for b, keep in zip(found, minimum_cut(weigh(found), edges(found)), strict=True) if keep])


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col("`page_id`").cast("bigint").alias("page_id"), F.col("`url`").cast("string").alias("url"), F.col("`html`").alias("html"))
    return rows.mapInArrow(_run, "page_id bigint, url string, text string, n_chars bigint")
