"""Main text of web pages: parser events, text-to-tag ratios, smoothing, region selection."""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pairgrammar.llm.common import map_texts

# fixed values: element names
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
SILENT = {"script", "style", "head", "title", "noscript", "template", "iframe", "object", "svg", "canvas", "audio", "video", "nav", "footer", "aside", "button", "select", "option", "textarea", "fieldset", "dialog", "menu"}
ROOMS = {"article", "main"}
BODY = {"body", "article", "main", "div", "p", "section", "header", "nav"}
# fixed values: words of class, id and role that mark what is not the article; STRONG ones do so as any part of a name
STRONG = {
    "ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "cookie", "cookies", "gdpr", "popup", "newsletter",
    "sidebar", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "complementary", "contentinfo", "comments", "commentlist", "disqus", "replies",
}
# fixed values: words that do so only where the rest of the name tells nothing else, and that text of an article may bear
WEAK = {
    "promotion", "banner", "consent", "notice", "notices", "notification", "alert", "modal", "overlay", "subscribe", "subscription", "signup", "login",
    "aside", "menu", "nav", "toolbar", "footer", "header", "masthead", "search", "comment", "reply", "respond", "share", "sharing", "social", "related", "recommended", "widget",
}
TALK = {"comment", "comments", "commentlist", "reply", "replies", "disqus", "respond"}
OTHERS = TALK | {"related", "recommended"}  # what holds articles of other people or pages
# fixed values: words of a name that tell nothing, that speak of an article's own parts, and that say how a page is laid out
PLAIN = {
    "area", "bar", "block", "body", "bottom", "box", "btn", "button", "buttons", "center", "col", "column", "container", "content", "fixed", "form", "global", "group", "holder", "icons", "inner",
    "item", "items", "left", "link", "links", "list", "main", "outer", "panel", "right", "row", "section", "site", "slot", "sticky", "text", "thread", "top", "tools", "unit", "wrap", "wrapper",
}
OWN = {"article", "blog", "entry", "news", "page", "pages", "post", "posts", "stories", "story", "title"}
LAYOUT = {"closed", "has", "layout", "no", "open", "with", "without"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CONTROLS = {"button", "input", "nav", "select", "textarea"}
MENU = 3  # so many blocks of links in a row are a menu
RADIUS, SIGMA, SHARE = 2, 1.0, 1.0
KERNEL = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(RADIUS + 1)]
_PART = re.compile(r"[a-z]+")
_TAG = re.compile(r"<[A-Za-z/!?]")


@lru_cache(maxsize=65536)
def judged(name: str) -> tuple[bool, bool, bool]:
    """Whether one whole name of a class, id or role is a strong mark, a weak one, and which of ``OTHERS`` it speaks of."""
    parts = set(_PART.findall(name))
    for part in list(parts):
        # two words written as one
        cut = next((i for i in range(2, len(part) - 1) if part[:i] in STRONG | WEAK and part[i:] in PLAIN | STRONG | WEAK or part[:i] in PLAIN and part[i:] in STRONG | WEAK), 0)
        if cut and part not in STRONG | WEAK:
            parts = parts - {part} | {part[:cut], part[cut:]}
    if parts & LAYOUT:
        return False, False, False
    strong = bool(parts & STRONG)
    weak = not strong and bool(parts & WEAK) and parts <= WEAK | PLAIN | OWN and not ("header" in parts and parts & OWN - {"page", "pages"})
    return strong, weak, (strong or weak) and bool(parts & OTHERS)


@dataclass(slots=True)
class _Doubt:
    """An element that only its name, or being a form or a page's head, speaks against."""

    around: int = 0
    others: bool = False
    room: bool = False  # holds an article or main
    weak: bool = False  # its name alone is not enough inside a room
    head: bool = False
    inside: int = 0  # the room it lies in
    controls: bool = False


class _Blocks(HTMLParser):
    """Blocks of text in page order: text, tag count, room, whether it may be content, inmost doubtful element, characters in links, heading.

    Whether a doubtful element is silent depends on what it holds, so the whole page decides (``muted``).
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, int, bool, int, int, str]] = []
        self.open: list[tuple[str, bool, int, int]] = []  # tag, silent from here, room, inmost doubtful element
        self.words: list[str] = []
        self.tags = self.links = self.anchors = 0
        self.heading = ""
        self.rooms = [0]  # inmost doubtful element around each room; room 0 is none
        self.doubt = [_Doubt()]  # element 0 is none

    def _state(self) -> tuple[bool, int, int]:
        return self.open[-1][1:] if self.open else (False, 0, 0)

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not used

    def flush(self) -> None:
        if not self.words:
            return
        text = " ".join("".join(self.words).split())
        if text:
            silent, room, doubt = self._state()
            self.blocks.append((text, self.tags, room, not silent, doubt, min(self.links, len(text)), self.heading))
            self.tags = 0
        self.words, self.links = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.words.append(" ")
        if tag not in INLINE:
            self.flush()
        self.tags += 1
        if tag == "input":
            self.doubt[self._state()[2]].controls = True
        if tag in VOID:
            return
        given = dict(attrs)
        names = [judged(name) for key in ("class", "id", "role") for name in (given.get(key) or "").lower().split()] if given else []
        while self.open and tag in BODY and self.open[-1][0] in ("head", "title"):
            self.open.pop()  # a head that nobody closed
        silent, room, doubt = self._state()
        if tag in CONTROLS:
            self.doubt[doubt].controls = True
        if tag in HEADINGS:
            self.heading = tag
        self.anchors += tag == "a"
        quiet = tag in SILENT
        is_room = tag in ROOMS or bool(given) and (given.get("role") in ("main", "article") or given.get("itemprop") == "articleBody")
        head = tag == "header" and not room
        strong, weak, others = tag == "form", False, False
        if given and not quiet:
            quiet = "hidden" in given or given.get("aria-hidden") == "true" or "display:none" in (given.get("style") or "").replace(" ", "").lower()
            if tag not in ("html", "body") and not (tag == "header" and room):
                others = any(o for _, _, o in names)
                strong = strong or (others if is_room else any(s for s, _, _ in names))
                weak = not is_room and any(w for _, w, _ in names)
        named = strong or weak or head
        if (quiet or named) and not silent and tag in INLINE:
            self.flush()
        if named and not quiet and not silent:
            self.doubt.append(_Doubt(doubt, others, is_room, weak and not strong, head and not strong, room))
            doubt = len(self.doubt) - 1
        if is_room and not silent and not quiet:
            if not named:
                at = doubt
                while at and not self.doubt[at].room:
                    self.doubt[at].room = True
                    at = self.doubt[at].around
            if not room or named or doubt != self.rooms[room]:
                self.rooms.append(doubt)
                room = len(self.rooms) - 1
        self.open.append((tag, silent or quiet, room, doubt))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == tag), None)
        before = self.open[at - 1] if at else ("", False, 0, 0)
        if tag not in INLINE or at is not None and (self.open[at][1] and not before[1] or self.open[at][3] != before[3]):
            self.flush()
        self.tags += 1
        if tag in HEADINGS:
            self.heading = ""
        if at is not None:
            self.anchors -= sum(o[0] == "a" for o in self.open[at:])
            del self.open[at:]

    def handle_data(self, data: str) -> None:
        self.words.append(data)
        if self.anchors:
            self.links += len(data.strip())


def pardoned(parser: _Blocks, dense: list[int]) -> list[bool]:
    """Whether what a doubtful element holds speaks for it although its name does not.

    It must hold no menu or control and be text outside links for at least half. Then a weak name inside a
    room is pardoned where the room's own dense text goes on behind it, or where it is a heading ahead of that text; and a head of
    the page, if it has the page's only heading of the highest rank and no link.
    """
    doubt, blocks = parser.doubt, parser.blocks
    chars, links, least = [0] * len(doubt), [0] * len(doubt), ["h9"] * len(doubt)
    first, last = [len(blocks)] * len(doubt), [-1] * len(doubt)
    for i, (text, _, _, may, e, linked, heading) in enumerate(blocks):
        if may:
            chars[e] += len(text)
            links[e] += linked
            least[e] = min(least[e], heading or "h9")
            first[e], last[e] = min(first[e], i), max(last[e], i)
    own = {}  # room and doubtful element: first and last dense block
    for i in dense:
        at = blocks[i][2], blocks[i][4]
        own[at] = own.get(at, (i, i))[0], i
    controls = [d.controls for d in doubt]
    plain = least[0]
    for e in range(len(doubt) - 1, 0, -1):
        at = doubt[e].around
        chars[at] += chars[e]
        links[at] += links[e]
        controls[at] = controls[at] or controls[e]
        least[at] = min(least[at], least[e])
        first[at], last[at] = min(first[at], first[e]), max(last[at], last[e])
        if not doubt[e].head:
            plain = min(plain, least[e])
    heads = [least[e] for e in range(1, len(doubt)) if doubt[e].head]
    out = [False] * len(doubt)
    for e in range(1, len(doubt)):
        d = doubt[e]
        if controls[e] or 2 * links[e] > chars[e]:
            continue
        if d.head:
            out[e] = not links[e] and least[e] < plain and heads.count(least[e]) == 1
        elif d.weak and d.inside:
            begin, end = own.get((d.inside, d.around), (len(blocks), -1))
            out[e] = last[e] < end and (first[e] > begin or least[e] < "h9")
    return out


def muted(parser: _Blocks, dense: list[int]) -> list[bool]:
    """Whether each doubtful element is silent, by itself or by one around it.

    It is not, if it is ``pardoned``, holds most of the dense text, or an article or main (where no room is free of
    doubt, one with at least half of the dense text that would then be heard). Comments, related pages
    and articles named like an aside count only where nothing dense would be heard otherwise.
    """
    doubt, blocks = parser.doubt, parser.blocks
    chars = [0] * len(doubt)
    for i in dense:
        chars[blocks[i][4]] += len(blocks[i][0])
    for e in range(len(doubt) - 1, 0, -1):
        chars[doubt[e].around] += chars[e]
    most = [2 * c > chars[0] for c in chars]
    spared = pardoned(parser, dense)

    def spread(free: list[bool]) -> list[bool]:
        out = [False] * len(doubt)
        for e in range(1, len(doubt)):
            out[e] = out[doubt[e].around] or not (free[e] or spared[e])
        return out

    plain = spread([m and not d.others for m, d in zip(most, doubt)])
    out = spread([(m or d.room) and not d.others for m, d in zip(most, doubt)])
    if all(plain[e] for e in parser.rooms[1:]):
        heard = [(blocks[i][2], len(blocks[i][0])) for i in dense if not out[blocks[i][4]]]
        if 2 * sum(n for room, n in heard if room) < sum(n for _, n in heard):
            out = plain
    if all(out[blocks[i][4]] for i in dense):
        out = spread([m or d.room for m, d in zip(most, doubt)])
    return out


def smoothed(values: list[float]) -> list[float]:
    """Gaussian mean of each value and its neighbours."""
    given = np.array(values, float)
    if len(given) <= 2 * RADIUS:
        return [sum(v * KERNEL[abs(i - j)] for j, v in enumerate(values) if abs(i - j) <= RADIUS) / sum(KERNEL[abs(i - j)] for j in range(len(values)) if abs(i - j) <= RADIUS) for i in range(len(values))]
    kernel = np.array(KERNEL[:0:-1] + KERNEL)
    return (np.convolve(given, kernel, "same") / np.convolve(np.ones_like(given), kernel, "same")).tolist()


def menus(linked: list[bool]) -> list[bool]:
    """Which of the blocks in a row are of ``MENU`` or more in succession that are mostly links."""
    out = [False] * len(linked)
    begin = 0
    for i in range(len(linked) + 1):
        if i == len(linked) or not linked[i]:
            if i - begin >= MENU:
                out[begin:i] = [True] * (i - begin)
            begin = i + 1
    return out


def main_text(html: str | None) -> str:
    """The article of a page, one block a line.

    Blocks whose smoothed ratio of text outside links to tags reaches the ratios' deviation are dense. Where the page
    has articles or mains, the rooms with a dense block are its content (all rooms, if none has one);
    elsewhere it is the run from the first dense block (headings right ahead included) to the last, without
    ``menus``. Inside, every block stays but those of silent elements (``muted`` judges those that
    only their name speaks against). Equal ratios are judged alike: a page of one kind of block is dense throughout, unless it is all links.
    """
    if not html:
        return ""
    parser = _Blocks()
    last = html.rfind("<")
    if last >= 0 and _TAG.match(html, last) and ">" not in html[last:]:
        html = html[:last]  # a tag that the page breaks off in
    parser.feed(html)
    parser.close()
    parser.flush()
    blocks = parser.blocks
    own = [len(text) - links for text, _, _, _, _, links, _ in blocks]
    ratio = smoothed([n / max(1, b[1]) for n, b in zip(own, blocks)])
    mean = sum(ratio) / max(1, len(ratio))
    limit = SHARE * math.sqrt(sum((r - mean) ** 2 for r in ratio) / max(1, len(ratio)))
    linked = [2 * b[5] > len(b[0]) for b in blocks]
    dense = [i for i, b in enumerate(blocks) if b[3] and ratio[i] >= limit and not linked[i]]
    quiet = muted(parser, dense)
    dense = [i for i in dense if not quiet[blocks[i][4]]]
    heard = [b[3] and not quiet[b[4]] for b in blocks]
    free = {r for r in range(1, len(parser.rooms)) if not quiet[parser.rooms[r]]}
    if free:
        rooms = {blocks[i][2] for i in dense} - {0} or free
        return "\n".join(b[0] for b, may in zip(blocks, heard) if may and b[2] in rooms)
    spoken = [i for i, may in enumerate(heard) if may]
    if dense:
        begin = bisect_left(spoken, dense[0])
        while begin and (blocks[spoken[begin - 1]][6] or parser.doubt[blocks[spoken[begin - 1]][4]].head) and not linked[spoken[begin - 1]]:
            begin -= 1
        spoken = [i for i in spoken[begin:] if i <= dense[-1]]
    listed = menus([linked[i] for i in spoken])
    return "\n".join(blocks[i][0] for i, menu in zip(spoken, listed) if not menu)


def extract(pages: DataFrame, keep: list[str], html: str = "html") -> DataFrame:
    """``row`` (the kept columns), ``text`` and ``n_chars`` (code points) of every page.

    Null and empty pages, and pages without an article, give an empty text. White space in a block is
    one blank, blocks are joined by line feeds, nothing is cut, however long a page is; repeated rows are
    extracted alike, an empty table gives no rows, and further columns of any name do not matter.
    """
    def make():
        def work(pages_):
            texts = [main_text(p.decode("utf-8", "replace")) if p else "" for p in pages_]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        return work

    return map_texts(pages, html, keep, [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())], make)
