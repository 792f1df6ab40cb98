"""HTML main text by minimum-cut labelling of a page's blocks.

A page is read into blocks of text. A logistic score of each block (tags and names around it, length, link
share, punctuation) gives its two terminal capacities: what it costs to call it boilerplate or content. Blocks
that follow each other, and the next block of the same parent, are tied by edges that weigh less the
further apart they are in the element tree. The minimum cut, found by max-flow, labels all blocks at once.

Content blocks are joined in page order. Each page is labelled alone, in the task that reads it, so nothing
is shuffled. Null or empty html gives empty text; pages without content blocks too. Malformed markup is
read as far as it goes: unclosed elements end with their parent, a head ends at the first element or text that it cannot
hold, an unclosed tag is text, a self-closed or unclosed ``svg`` and the like is empty. A form around the main element or
most of the text is no boilerplate. Time grows with the page's length, not with its depth. Repeated rows are
extracted one by one; white space is any Unicode white space after decoding.
"""

from __future__ import annotations

import re
from collections import deque
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailprism.llm.common import batches

TAG = re.compile(
    r"""<!--(?:.*?-->|>|->|.*)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"""
    r"""|<(/?)([A-Za-z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>""",
    re.S,
)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

# fixed values: HTML element names
RAW = frozenset("script style noscript template iframe object canvas svg title textarea select audio video noframes".split())
#: Of these, the ones that hold no markup; the others can hold each other.
PLAIN = frozenset("script style iframe title textarea noframes".split())
#: Code runs to the end of the page where its end tag is missing; other elements of ``RAW`` are then empty.
CODE = frozenset(("script", "style"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split()
)
BOILER_TAGS = frozenset("nav footer aside form menu dialog button fieldset datalist search head".split())
MAIN_TAGS = frozenset(("article", "main"))
#: Elements that an opening tag ends, if open in the same parent.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: What a head can hold besides raw elements; anything else ends it, as its end tag is optional.
HEAD_VOIDS = frozenset("base link meta".split())
#: Elements that servers wrap around a whole page; one that holds most of the page's text says nothing about it.
WRAPPERS = frozenset("form fieldset dialog".split())
SCOPES = frozenset("ul ol dl table tbody thead tfoot article section div main body html".split())

#: Words of class, id and role that speak for boilerplate or for content.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs cookie cookies consent gdpr footer foot "
    "header masthead menu modal nav navbar navigation newsletter notice notices notification alert overlay pager pagination popup "
    "promo promoted promotion recommended related share sharing sidebar social sponsor sponsored subscribe subscription toolbar "
    "topbar widget widgets login signup search complementary contentinfo copyright legal disclaimer skip tags toc".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist disqus replies reply respond discussion".split())
CONTENT_WORDS = frozenset("article body content entry main post story text".split())

#: Weights of the logistic score, in log odds for content.
BASE, IN_MAIN, IN_BOILER, NAMED_CONTENT = -1.0, 6.0, -9.0, 2.0
#: A name that speaks for boilerplate inside the main part takes its bonus away; the other weights and the cut decide.
NAMED_IN_MAIN = -6.0
PER_TEN_WORDS, MOST_WORDS, LINKS, PARAGRAPH, SENTENCE = 0.8, 40, -4.0, 0.8, 0.8
#: Capacities of ties between neighbours and between the blocks of a parent.
NEXT, SIBLING = 1.5, 0.75


class Block:
    __slots__ = ("parts", "chars", "linked", "element", "text")

    def __init__(self, element: int):
        self.parts: list[str] = []
        self.chars = self.linked = 0
        self.element = element
        self.text = ""


class Page:
    """A page's elements (tag, parent, depth, marks) and its blocks of text."""

    def __init__(self, html: str):
        self.tags, self.parent, self.depth, self.boiler, self.content, self.wraps = ["#"], [-1], [0], [0], [False], [False]
        self.hidden = [False]
        self.blocks: list[Block] = []
        self._stack = [0]
        # places on the stack: of each tag, of elements that are not inline, of those that end a search upwards
        self._at: dict[str, list[int]] = {}
        self._solid, self._scopes = [0], [0]
        self._block: Block | None = None
        self._ends: dict[int, int] | None = None
        self._endless: dict[str, int] = {}  # no end tag from this place on
        self._read(html)
        self._inherit()

    def _read(self, html: str) -> None:
        at, n = 0, len(html)
        while at < n:
            m = TAG.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            if m.start() > at:
                self._text(html[at:m.start()])
            at = m.end()
            name = m.group(2) or m.group(5)
            if name is None:
                continue
            name = name.lower()
            closing = bool(m.group(1) or m.group(4))
            if name in RAW and not closing:
                at = self._raw_end(html, name, at, (m.group(3) if m.group(2) else m.group(6)).endswith("/"))
                self._space(name)
            elif closing:
                self._close(name)
            else:
                self._open(name, m.group(3) if m.group(2) else m.group(6))
        self._end_block()

    def _raw_end(self, html: str, name: str, at: int, closed: bool) -> int:
        """Where a raw element ends whose start tag ends at ``at``."""
        if name in PLAIN:
            if at < self._endless.get(name, len(html) + 1):
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>", re.I).search(html, at)
                if end is not None:
                    return end.end()
                self._endless[name] = at
            return len(html) if name in CODE else at
        if closed:
            return at
        if self._ends is None:
            self._ends = self._match(html, at, name)
        return self._ends.get(at, at)

    def _match(self, html: str, at: int, name: str) -> dict[int, int]:
        """Ends of all raw elements that can hold markup, by the ends of their start tags; the first tag ends at ``at``."""
        out: dict[int, int] = {}
        opened: dict[str, list[int]] = {name: [at]}
        while (m := TAG.search(html, at)) is not None:
            at = m.end()
            name = (m.group(2) or m.group(5) or "").lower()
            if name not in RAW:
                continue
            if m.group(1) or m.group(4):
                if opened.get(name):
                    out[opened[name].pop()] = at
            elif name in PLAIN:
                at = self._raw_end(html, name, at, False)
            elif not (m.group(3) if m.group(2) else m.group(6)).endswith("/"):
                opened.setdefault(name, []).append(at)
        return out

    def _space(self, name: str) -> None:
        if self._block is not None and name in ("br", "hr", "img", "svg", "video", "audio", "canvas", "iframe", "object"):
            self._block.parts.append(" ")

    def _text(self, raw: str) -> None:
        block = self._block
        if block is None:
            if raw.isspace():
                return
            self._end_head()
            block = self._block = Block(self._stack[self._solid[-1]])
        block.parts.append(raw)
        block.chars += len(raw)
        if self._at.get("a"):
            block.linked += len(raw)

    def _end_block(self) -> None:
        block, self._block = self._block, None
        if block is not None:
            raw = "".join(block.parts)
            block.text = " ".join((unescape(raw) if "&" in raw else raw).split())
            if block.text:
                self.blocks.append(block)

    def _open(self, name: str, attributes: str) -> None:
        if name not in HEAD_VOIDS:
            self._end_head()
        if name in VOID:
            self._space(name)
            return
        if name not in INLINE:
            self._end_block()
            # a block element ends an open paragraph, an item the one before, up to the nearest scope
            open_at = max((at[-1] for tag in ("p", *ENDS.get(name, ())) if (at := self._at.get(tag))), default=0)
            if open_at > self._scopes[-1]:
                self._pop(open_at)
        hidden = False
        words: set[str] = set()
        if attributes and "=" in attributes or "hidden" in attributes:
            for key, *values in NAMED.findall(attributes):
                value, key = "".join(values).lower(), key.lower()
                if key == "hidden" or key == "aria-hidden" and value == "true":
                    hidden = True
                elif key == "style":
                    hidden |= "display:none" in value.replace(" ", "")
                else:
                    words.update(re.split(r"[^a-z0-9]+", value))
        top = self._stack[-1]
        boiler = 0
        if name in BOILER_TAGS or hidden:
            boiler = 2
        elif words & (BOILER_WORDS | COMMENT_WORDS) and self._inside_main():
            boiler = 3  # by its name alone
        elif words & COMMENT_WORDS:
            boiler = 2
        elif name not in ("body", "html") and words & BOILER_WORDS or name == "header" and not self._inside_main():
            boiler = 1
        if name in MAIN_TAGS and name != "body":
            for e in reversed(self._stack):
                if self.wraps[e]:
                    break  # and so do all above it
                self.wraps[e] = True
        self.tags.append(name)
        self.parent.append(top)
        self.depth.append(self.depth[top] + 1)
        self.boiler.append(boiler)
        self.content.append(bool(words & CONTENT_WORDS))
        self.wraps.append(False)
        self.hidden.append(hidden or bool(words & COMMENT_WORDS))
        place = len(self._stack)
        self._stack.append(len(self.tags) - 1)
        self._at.setdefault(name, []).append(place)
        if name not in INLINE:
            self._solid.append(place)
        if name in SCOPES:
            self._scopes.append(place)

    def _inside_main(self) -> bool:
        return any(self._at.get(tag) for tag in MAIN_TAGS)

    def _end_head(self) -> None:
        if self._at.get("head"):
            self._pop(self._at["head"][-1])

    def _pop(self, to: int) -> None:
        for e in self._stack[to:]:
            self._at[self.tags[e]].pop()
        del self._stack[to:]
        for places in (self._solid, self._scopes):
            while places[-1] >= to:
                places.pop()

    def _close(self, name: str) -> None:
        if name not in INLINE:
            self._end_block()
        # an inline element is looked for inside the nearest block only
        if (at := self._at.get(name)) and not (name in INLINE and at[-1] < self._solid[-1]):
            self._pop(at[-1])

    def _inherit(self) -> None:
        """What each element has from itself and all around it; parents stand before their children."""
        n = len(self.tags)
        chars = [0] * n  # of text in an element
        for block in self.blocks:
            chars[block.element] += len(block.text)
        for e in range(n - 1, 0, -1):
            chars[self.parent[e]] += chars[e]
        self.in_boiler, self.in_main, self.in_name, self.in_content = ([False] * n for _ in range(4))
        for e in range(1, n):
            up, kind = self.parent[e], self.boiler[e]
            # a name, or a form, means nothing around the main part of the page
            around = self.tags[e] in WRAPPERS and not self.hidden[e] and (self.wraps[e] or 2 * chars[e] > chars[0])
            own = kind == 2 and not around or kind == 1 and not self.wraps[e]
            self.in_boiler[e] = self.in_boiler[up] or own
            self.in_main[e] = self.in_main[up] or self.tags[e] in MAIN_TAGS
            self.in_name[e] = self.in_name[up] or kind == 3
            self.in_content[e] = self.in_content[up] or self.content[e]


def score(page: Page, block: Block) -> float:
    """Log odds that the block is content."""
    at = block.element
    words = block.text.count(" ") + 1
    out = BASE + PER_TEN_WORDS * min(words, MOST_WORDS) / 10 + LINKS * block.linked / block.chars
    out += PARAGRAPH * (page.tags[block.element] in ("p", "blockquote", "pre")) + SENTENCE * (block.text[-1] in ".!?…。")
    if page.in_boiler[at]:
        return out + IN_BOILER
    if page.in_main[at]:
        return out + IN_MAIN + NAMED_IN_MAIN * page.in_name[at]
    return out + NAMED_CONTENT * page.in_content[at]


def ties(page: Page) -> list[tuple[int, int, float]]:
    """Smoothness edges between blocks: neighbours, by their distance in the tree, and siblings."""
    out = []
    last: dict[int, int] = {}
    for i, block in enumerate(page.blocks):
        if i:
            a, b, steps = page.blocks[i - 1].element, block.element, 0
            while a != b:
                if page.depth[a] >= page.depth[b]:
                    a = page.parent[a]
                else:
                    b = page.parent[b]
                steps += 1
            out.append((i - 1, i, NEXT / (1 + steps)))
        up = page.parent[block.element]
        if up in last:
            out.append((last[up], i, SIBLING))
        last[up] = i
    return out


def min_cut(scores: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: content) of least total cost, by augmenting along shortest paths level by level."""
    n = len(scores)
    if all(s >= 0 for s in scores) or all(s <= 0 for s in scores):
        return [s > 0 for s in scores]  # no flow can pass
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def link(a: int, b: int, ahead: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(ahead)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, s in enumerate(scores):
        if s > 0:
            link(source, i, s, 0.0)
        elif s < 0:
            link(i, sink, -s, 0.0)
    for a, b, w in edges:
        link(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        todo = deque([source])
        while todo:
            v = todo.popleft()
            for e in out[v]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[v] + 1
                    todo.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        v = source
        while True:  # a blocking flow, without recursion
            if v == sink:
                least = min(room[e] for e in path)
                for e in path:
                    room[e] -= least
                    room[e ^ 1] += least
                first = next(i for i, e in enumerate(path) if room[e] <= 1e-9)
                v = to[path[first] ^ 1]
                del path[first:]
                continue
            while at[v] < len(out[v]):
                e = out[v][at[v]]
                if room[e] > 1e-9 and level[to[e]] == level[v] + 1:
                    break
                at[v] += 1
            else:
                if v == source:
                    break
                v = to[path.pop() ^ 1]
                at[v] += 1
                continue
            path.append(e)
            v = to[e]


def main_text(html: str | None) -> str:
    page = Page(html or "")
    labels = min_cut([score(page, b) for b in page.blocks], ties(page))
    return " ".join(b.text for b, keep in zip(page.blocks, labels) if keep)


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` for each row of ``pages(page_id, url, html)``."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(x) for x in batch.column(2).to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
            ["page_id", "url", "text", "n_chars"],
        )

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(
        batches(work), "page_id long, url string, text string, n_chars long"
    )
