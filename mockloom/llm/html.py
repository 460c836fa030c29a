"""Main text of web pages: flat text blocks, classified by a small decision tree."""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Elements whose content is raw, or hidden whatever follows: without an end tag they reach to the end of the page.
RAW = frozenset("script style iframe textarea title template".split())
#: Elements whose content is no text of the page if they have an end tag.
EMBEDDED = frozenset("noscript svg math object audio video canvas select".split())
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>|<(/?)([a-z][a-z0-9:-]*+)((?:[^'\">]|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-z][a-z0-9:-]*+)([^>]*+)>",
    re.S | re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*+(?:>|\Z)", re.I) for name in RAW}
_NAMES = re.compile(r"(?<![^\s\"'/])(class|id|role|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_UNFINISHED = re.compile(r"<[a-z/!?]", re.I)
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none", re.I)
#: Elements inside a line of text; all others begin and end a block.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q s samp small span strike strong sub sup time tt u var wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold other blocks and are followed on a stack.
HOLDERS = frozenset("html head body article main section div nav aside header footer form menu dialog ul ol dl table figure details fieldset button".split())
_SIDE = frozenset("head nav aside footer form menu dialog button fieldset".split())
_MAIN_WORDS = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-?body|main|content|post|post-?body|entry|entry-?content|story|body-?text)(?:$|[\s_-])", re.I)
#: Words of names that say side matter wherever they stand.
_STRONG = frozenset(
    "nav navbar navigation sidebar footer masthead cookie cookies consent ad ads advert adverts advertisement promo promotion sponsor sponsored share sharing "
    "comment comments commentlist disqus newsletter subscribe popup breadcrumb breadcrumbs related recommended pagination pager gdpr".split())
#: Words that also occur in names of a text's own sections (side-effects, search-methods).
_WEAK = frozenset("menu side aside foot header notice alert banner social reply replies respond signup login search modal overlay widget toolbar tags copyright legal".split())
_SIDE_WORDS = _STRONG | _WEAK
#: Words that win over main words in another name of the same element.
_OVER_MAIN = frozenset(
    "nav navbar navigation sidebar footer ad ads advert adverts advertisement promo promotion sponsored comment comments commentlist related newsletter breadcrumb breadcrumbs pagination".split())
#: Words that name a place in table cells, where others name what a column holds.
_CELL_WORDS = frozenset("nav navbar navigation menu sidebar footer ad ads advert adverts advertisement promo promotion sponsor sponsored newsletter breadcrumb breadcrumbs pagination pager".split())
#: Words beside which a side word still stands for the whole name.
_BOX_WORDS = frozenset("section list box container wrapper wrap area block button buttons link links post posts article articles bar form item items body inner content title site page top bottom left right main".split())
_OWN_HEADER = frozenset("article post entry story".split())
_NEGATION = re.compile(r"(?:^|(?<=[_-]))(?:no|not|has|with|without|hide)[_-]+[a-z0-9]+", re.I)
_WRAP = re.compile(r"(?:content|main|post|article)[_-]sidebar[_-]?(?:wrap|wrapper|layout)", re.I)
_MIXED = re.compile(r"comment|sidebar|footer|related|promo|advert", re.I)
#: Elements that any next block ends; and table cells with what holds them.
_LINES = frozenset("p h1 h2 h3 h4 h5 h6".split())
_CELLS = frozenset("td th tr thead tbody tfoot caption".split())
#: Open elements that a start tag ends, and the holders beyond which it and an end tag do not reach.
_ENDS_OPEN = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr", "caption"},
    **dict.fromkeys(("thead", "tbody", "tfoot"), {"td", "th", "tr", "thead", "tbody", "tfoot", "caption"}),
}
_SCOPE = {"li": {"ul", "ol", "menu", "table"}, "dt": {"dl", "table"}, "dd": {"dl", "table"}, **dict.fromkeys(_CELLS, {"table"})}
_ANY_SCOPE = {"table", "td", "th"}
#: What the tree sees of a block. ``main_share`` is the part of the page's words without links, outside side matter, that stands in main elements.
FEATURES = ["in_side", "in_main", "main_share", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after"]
#: Labelled blocks the tree is fitted on: FEATURES, then 1 for main text. Of a missing neighbour both are 0.
LABELLED = """
1 0 0.9 0   5 1.0   4 1.0   6 1.0  0
1 0 0.9 0  40 0.1   6 1.0  60 0.0  0
1 1 0.9 0  30 0.0  80 0.0  20 0.0  0
1 1 1.0 0   4 0.5  70 0.0   9 0.0  0
1 1 1.0 1   2 0.0  50 0.0  15 0.0  0
1 0 0.0 0  12 0.0   3 1.0  55 0.0  0
1 0 0.0 0   3 1.0   0 0.0   4 1.0  0
1 0 0.0 1   2 0.0   9 0.4  14 0.3  0
1 0 0.0 0  25 0.0  44 0.0   0 0.0  0
1 0 1.0 0  90 0.0  70 0.0   0 0.0  0
1 0 0.0 0  16 0.0  40 0.0  30 0.0  0
1 1 0.6 0   8 0.0   9 0.0   7 0.0  0
0 1 1.0 1   6 0.0   0 0.0  70 0.0  1
0 1 1.0 1   3 0.0  60 0.0  80 0.0  1
0 1 0.9 0   1 0.0  30 0.0  25 0.0  1
0 1 0.9 0   2 0.0   5 0.0   3 0.0  1
0 1 0.4 0  80 0.0   8 0.0  60 0.0  1
0 1 0.8 0  60 0.1  80 0.0   7 0.6  1
0 1 1.0 0  15 0.4  50 0.0  40 0.0  1
0 1 1.0 0   9 0.0   4 1.0   9 1.0  1
0 1 0.7 0   4 1.0  30 0.1  30 0.0  1
0 1 1.0 0   7 1.0  12 0.0   0 0.0  1
0 1 1.0 0   5 1.0   9 0.0   6 1.0  1
0 1 0.9 0   6 1.0   5 1.0  40 0.0  1
0 1 1.0 0   4 1.0   5 1.0   3 1.0  1
0 1 0.9 0   6 1.0   6 1.0   7 1.0  1
0 1 0.8 0   9 0.9   3 1.0   8 0.9  1
0 1 1.0 0  12 0.8   7 0.9  10 1.0  1
0 1 1.0 0 200 0.0   0 0.0   0 0.0  1
0 1 0.3 0   5 0.0  20 0.0   9 0.2  1
0 1 0.9 1   2 0.0   5 1.0  40 0.0  1
0 1 1.0 0   6 0.0   4 1.0  12 0.0  1
0 1 0.8 0   3 0.0   4 1.0   5 0.9  1
0 1 1.0 0  20 0.0   6 1.0   0 0.0  1
0 1 0.9 0   1 0.0   5 1.0   0 0.0  1
0 1 0.9 0   4 0.1   9 0.8   8 1.0  1
0 1 1.0 1   2 0.0   6 1.0   7 0.2  1
0 1 0.5 0   8 0.0   3 1.0   3 1.0  1
0 0 1.0 0   5 0.0   3 1.0  60 0.0  0
0 0 0.9 0  14 0.0  90 0.0   4 1.0  0
0 0 0.8 0  45 0.0  70 0.0   6 0.5  0
0 0 0.9 1   4 0.0   5 1.0  50 0.0  0
0 0 1.0 0   6 1.0   6 1.0   6 1.0  0
0 0 0.7 0  30 0.6  10 1.0  10 1.0  0
0 0 0.5 0  40 0.0  30 0.0  35 0.0  0
0 0 0.4 0  80 0.0  10 0.0  60 0.0  0
0 0 0.3 0  12 0.0   5 0.0   0 0.0  0
0 0 0.2 0  20 0.1  25 0.0  15 0.0  0
0 0 0.2 1   3 0.0  20 0.0  40 0.0  0
0 0 0.9 0   7 0.0   8 0.0   6 0.0  0
0 0 0.0 0  80 0.0  60 0.0  70 0.0  1
0 0 0.0 0  60 0.1   3 1.0  80 0.0  1
0 0 0.0 0  40 0.0  50 0.0   5 1.0  1
0 0 0.0 0  25 0.2  30 0.0  35 0.0  1
0 0 0.0 0  20 0.0   0 0.0   0 0.0  1
0 0 0.1 0   4 0.0  60 0.0  55 0.0  1
0 0 0.0 0   7 0.0  45 0.0  30 0.0  1
0 0 0.0 1   5 0.0   4 1.0  60 0.0  1
0 0 0.0 1   3 0.0  50 0.0  45 0.0  1
0 0 0.0 0   2 0.0   0 0.0  14 0.0  1
0 0 0.0 0   2 0.0   3 0.0   3 0.0  1
0 0 0.0 0   3 0.0   2 0.0   2 0.0  1
0 0 0.0 0   1 0.0   4 0.0  12 0.0  1
0 0 0.0 0   2 0.0  11 0.0   0 0.0  1
0 0 0.0 0   2 0.0  16 0.0   5 1.0  1
0 0 0.0 0   3 0.0   4 1.0   2 0.0  1
0 0 0.0 1   2 0.0   6 1.0   9 0.0  1
0 0 0.0 0   6 0.3   5 0.0  30 0.0  1
0 0 0.0 0   4 0.5  20 0.0  12 0.0  1
0 0 0.0 0   8 0.4  12 0.0   0 0.0  1
0 0 0.0 0   6 0.5   9 1.0  18 0.0  1
0 0 0.1 0   5 0.6  33 0.1   7 0.0  1
0 0 0.0 0  12 0.6   8 0.1   9 0.1  1
0 0 0.0 0   5 1.0   4 1.0   6 1.0  0
0 0 0.0 0   9 0.8   5 1.0   7 0.9  0
0 0 0.0 0  16 0.7  12 0.6  14 0.8  0
0 0 0.1 0   3 1.0   0 0.0   4 1.0  0
0 0 0.0 0   4 1.0   6 1.0   0 0.0  0
0 0 0.0 0   3 0.0   2 1.0   4 1.0  0
0 0 0.0 0   6 0.0   3 1.0   9 1.0  0
0 0 0.0 1   2 0.0   5 0.9   6 1.0  0
0 0 0.0 0  12 0.0   4 1.0   3 0.9  0
0 0 0.0 0   9 0.3   6 1.0   5 1.0  0
0 0 0.0 0  25 0.2   7 0.9   8 1.0  0
0 0 0.0 0   5 0.0   5 0.8   0 0.0  0
0 0 0.0 0   6 0.0   7 1.0   0 0.0  0
0 0 0.0 0   4 0.1   3 0.9   0 0.0  0
0 0 0.0 0  40 0.8  30 0.9  20 0.9  0
0 0 0.0 0  35 0.9  40 0.0  60 0.0  0
0 0 0.0 0  30 1.0  50 0.0  40 0.0  0
0 0 0.1 0   8 0.9  60 0.0  80 0.0  0
0 0 0.0 0   6 1.0  80 0.0  60 0.0  0
0 0 0.0 0   7 1.0   9 0.0   6 0.0  0
0 0 0.0 0  12 0.0   0 0.0   0 0.0  1
0 0 0.0 0  12 0.0  40 0.0  30 0.0  1
0 0 0.0 0  15 0.0  22 0.0   0 0.0  1
0 0 0.0 0  90 0.0  95 0.0  85 0.0  1
0 0 0.0 0   8 0.1 150 0.0 200 0.1  1
0 0 0.0 0 200 0.0   4 1.0   6 1.0  1
0 0 0.0 0 120 0.1 200 0.0   5 1.0  1
0 0 0.0 0 150 0.0   5 1.0   0 0.0  1
0 0 0.0 0  60 0.0   6 1.0   9 1.0  1
0 0 0.0 0  45 0.1   3 0.9   4 1.0  1
0 0 0.0 0   3 0.0  20 1.0  25 1.0  0
0 0 0.0 0   6 0.0  15 0.9  40 1.0  0
0 0 0.0 0   1 0.0   5 1.0  14 0.9  0
0 0 0.1 0   9 0.1  30 1.0   9 1.0  0
0 0 0.0 0   2 0.0   5 1.0   3 0.0  1
0 0 0.0 0   4 0.0   9 1.0   1 0.0  1
0 0 0.0 0   3 0.0   4 1.0   6 0.1  1
0 0 0.1 0   1 0.0  12 1.0   2 0.0  1
0 0 0.0 0   7 0.2  25 0.9   5 0.2  1
0 0 0.0 0  40 0.0   4 1.0   4 0.0  1
0 0 0.0 0   4 0.0   6 0.0  12 1.0  1
0 0 0.0 0   2 0.0   3 0.1   5 1.0  1
0 0 0.0 0   2 0.0   5 1.0   0 0.0  0
0 0 0.0 0   9 0.0  12 0.9   0 0.0  0
0 1 0.0 0   3 0.0  60 0.0  50 0.0  1
0 1 0.1 0  20 0.0   4 1.0  90 0.0  1
0 1 0.0 0   6 0.0   5 1.0  70 0.0  1
"""


class Block(NamedTuple):
    text: str
    words: int
    links: float
    side: bool
    main: bool
    heading: bool


def _words(name: str) -> set[str]:
    return set(re.split(r"[\s_-]+", _NEGATION.sub("", name.lower())))


@lru_cache(maxsize=65536)
def _reads(name: str) -> tuple[frozenset[str], bool, bool]:
    """Side words of a name, whether it consists of such, and whether it names main text; side words win."""
    words = _words(name) - {""}
    main = bool(_MAIN_WORDS.search(name))
    side = words & _SIDE_WORDS
    if words & _OWN_HEADER:
        side -= {"header"}
    if main:
        side -= {"widget"}
        if _WRAP.search(name):
            return frozenset(), False, False
        if not side and (found := _MIXED.search(_NEGATION.sub("", name))):
            side = {found[0].lower()}
    whole = bool(side) and all(w in _SIDE_WORDS or w in _BOX_WORDS or w.isdigit() for w in words)
    return frozenset(side), whole, main and not side


def _places(name: str, attributes: str, inside: bool) -> tuple[bool, bool]:
    """Whether the names of an element say side matter, and main text. ``inside`` main text, names have to say more.

    Ids are often the anchors of a text's own sections: there, only a whole name
    of side words counts, as do weak words of a class. On elements that hold no
    blocks only whole names count, and ids only where they name adverts and the like.
    """
    found = [(kind.lower(), *_reads(token)) for kind, value in _NAMES.findall(attributes) for token in value.strip("\"'").split()]
    if not found:
        return False, False
    main = any(f[3] for f in found)
    if name not in HOLDERS:
        taken = _CELL_WORDS if name in _CELLS else _SIDE_WORDS - {"header", "notice", "alert"}
        anchor = name in _LINES and name != "p" or name == "dt"
        return any(whole and words & (taken if kind != "id" else taken & _STRONG) and not (kind == "id" and anchor) for kind, words, whole, _ in found), False
    if name in ("html", "body", "main"):
        return False, main
    if main or name == "article":
        over = _OVER_MAIN | {"menu"} if name in ("ul", "ol") else _OVER_MAIN
        return any(whole and words & over for _, words, whole, _ in found), main
    return any(
        words and (whole or not (kind == "id" and (inside or name == "section") or inside and not words & _STRONG)) for kind, words, whole, _ in found), False


class Token(NamedTuple):
    start: int
    end: int
    #: Lower-case name of a tag, "" for what has no text, "[" for a CDATA section.
    name: str
    closing: bool = False
    attributes: str = ""


def tokens(page: str) -> list[Token]:
    """Tags and CDATA sections in order; an element without text of the page is one token without name.

    An end tag closes the last open element of its name, so nested elements end
    where they should. Of an EMBEDDED element without end tag, and of an empty
    <svg/> or <math/>, only the tag is dropped.
    """
    out: list[Token] = []
    opened: list[tuple[str, int]] = []
    count: Counter[str] = Counter()
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        name, attributes = (m[2] or m[5] or "").lower(), m[3] or m[6] or ""
        closing = bool(m[1] or m[4])
        whole = not attributes or attributes[0] == "/" or attributes[0].isspace()
        if not name:
            out.append(Token(m.start(), at, "[" if m[0].startswith("<![CDATA[") else ""))
        elif whole and name in RAW and not closing:
            if not (attributes.endswith("/") and (count["svg"] or count["math"])):
                end = _ENDS[name].search(page, at)
                at = end.end() if end else len(page)
            out.append(Token(m.start(), at, ""))
        elif whole and name in EMBEDDED and not closing:
            if not (name in ("svg", "math") and attributes.endswith("/")):
                opened.append((name, len(out)))
                count[name] += 1
            out.append(Token(m.start(), at, ""))
        elif whole and count[name]:
            last, first = opened.pop()
            count[last] -= 1
            while last != name:
                last, first = opened.pop()
                count[last] -= 1
            start = out[first].start
            del out[first:]
            out.append(Token(start, at, ""))
        else:
            out.append(Token(m.start(), at, name, closing, attributes))
    return out


def blocks(page: str) -> list[Block]:
    """Text blocks of a page in order: text between the tags that end a line, with what encloses it.

    A link goes on through the blocks that stand inside it; elements that say they are not shown have no text.
    """
    out: list[Block] = []
    stack: list[tuple[str, bool, bool]] = []
    count: Counter[str] = Counter()
    parts: list[str] = []
    side = main = heading = False
    link, open_ended, linked, at = False, False, 0, 0
    veil = ["", 0]  # an inline element that is not shown, and how deep it is nested in itself

    def shut() -> str:
        name = stack.pop()[0]
        count[name] -= 1
        return name

    def reach(name: str, ends: set[str]) -> bool:
        """Close the last open element of ``ends`` with all in it, if none that bounds ``name`` lies between."""
        limit = set() if name in HOLDERS else _SCOPE.get(name, _ANY_SCOPE)
        if not any(count[e] for e in ends):
            return False
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ends:
                while len(stack) > k:
                    shut()
                return True
            if stack[k][0] in limit:
                return False
        return False

    def flush() -> None:
        nonlocal linked
        tokens = "".join(parts).split()
        parts.clear()
        if tokens:
            out.append(Block(" ".join(tokens), len(tokens), min(1.0, linked / len(tokens)), side, main, heading))
        linked = 0

    def add(text: str) -> None:
        nonlocal linked
        if text and not veil[1]:
            text = html.unescape(text)
            parts.append(text)
            if link:
                linked += len(text.split())

    found = tokens(page)
    closed = _closed_links(found)
    for k, (start, end, name, closing, attributes) in enumerate(found):
        add(page[at:start])
        at = end
        if not name:
            continue
        if name == "[":
            add(page[start + 9:end - 3])
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                link, open_ended = not closing, k not in closed
            if closing:
                veil[1] -= name == veil[0] and veil[1] > 0
            elif veil[1]:
                veil[1] += name == veil[0]
            elif name not in VOID and _UNSEEN.search(attributes):
                veil = [name, 1]
            continue
        flush()
        veil[1] = 0
        link = link and not open_ended
        if name in ("h1", "h2", "h3", "h4", "h5", "h6"):
            heading = not closing
        elif name not in INLINE:
            heading = False
        if name in VOID and name != "hr":
            continue
        while stack and stack[-1][0] in _LINES and not (closing and stack[-1][0] == name):
            shut()
        if closing:
            if count[name]:
                reach(name, {name})
        elif name != "hr" and not attributes.endswith("/"):
            if name in _ENDS_OPEN:
                while reach(name, _ENDS_OPEN[name]):
                    pass
            _, around, into = stack[-1] if stack else ("", False, False)
            named_side, named_main = _places(name, attributes, into)
            aside = named_side or name in _SIDE or name == "header" and not into or bool((_HIDDEN if name in HOLDERS else _UNSEEN).search(attributes))
            stack.append((name, around or aside, into or name in ("article", "main") or named_main))
            count[name] += 1
        _, side, main = stack[-1] if stack else ("", False, False)
    rest = page[at:]
    unfinished = _UNFINISHED.search(rest)
    add(rest[:unfinished.start()] if unfinished else rest)
    flush()
    return out


def _closed_links(found: list[Token]) -> set[int]:
    """Places of start tags of links whose end tag comes before the next link: such a link goes on through blocks."""
    out, last = set(), None
    for k, t in enumerate(found):
        if t.name == "a":
            if t.closing and last is not None:
                out.add(last)
            last = None if t.closing else k
    return out


def table_of(page: list[Block]) -> np.ndarray:
    """FEATURES of every block; neighbours beyond the ends have no words.

    A small box named like main text has a small share of the page's words, so
    the tree can tell it from an element that holds the article.
    """
    words = np.array([0, *[b.words for b in page], 0], float)
    links = np.array([0, *[b.links for b in page], 0], float)
    plain = [(b.words * (1 - b.links), b.main) for b in page if not b.side]
    share = sum(w for w, main in plain if main) / max(sum(w for w, _ in plain), 1e-9)
    own = np.array([[b.side, b.main, share, b.heading] for b in page], float).reshape(-1, 4)
    return np.column_stack([own, words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | bool:
    """Decision tree by Gini gain: (feature, threshold, low branch, high branch), or the class."""
    if depth == 0 or y.min() == y.max():
        return bool(y.mean() >= 0.5)
    best, parent = (1e-9, 0, 0.0), len(y) * y.mean() * (1 - y.mean())
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = y[x[:, f] <= t]
            high = y[x[:, f] > t]
            gain = parent - sum(len(p) * p.mean() * (1 - p.mean()) for p in (low, high))
            if gain > best[0] + 1e-12:
                best = (gain, f, t)
    if not best[2] and best[0] <= 1e-9:
        return bool(y.mean() >= 0.5)
    _, f, t = best
    goes = x[:, f] > t
    return f, t, grow(x[~goes], y[~goes], depth - 1), grow(x[goes], y[goes], depth - 1)


@lru_cache(maxsize=1)
def tree() -> tuple | bool:
    rows = np.array([line.split() for line in LABELLED.strip().splitlines()], float)
    return grow(rows[:, :-1], rows[:, -1])


def decide(node: tuple | bool, row: np.ndarray) -> bool:
    while not isinstance(node, bool):
        node = node[3] if row[node[0]] > node[1] else node[2]
    return node


def main_text(page: str) -> str:
    """The blocks of a page that are main text, one to a line."""
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, table_of(found), strict=True) if decide(tree(), row))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page.

    Pages are cut in flat text blocks with word count, link density and those of
    the two neighbours, and what encloses them (article, or menu, header, form
    and the like). A decision tree fitted on LABELLED says which are main text. One pass, no shuffle.

    Null and empty pages give an empty text. Broken markup is read as far as it
    goes: closing tags without an opening one are ignored, open elements end with
    what encloses them. Repeated pages and null ids are kept as rows; an empty table gives no rows. No
    page is cut short, but what follows a RAW element without end tag belongs to it, and a tag that the page's end leaves unfinished is none of its text, as in browsers.
    """
    source = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].alias("url"), pages[html_col].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py() or "") for page in batch.column(2)]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "url", "text", "n_chars"])

    return source.mapInArrow(run, "page_id long, url string, text string, n_chars long")
