"""HTML extraction: flat text blocks, described by word counts and link densities of themselves and their neighbours and
by the containers they stand in, classified by a decision tree that is trained on a small labelled table.

A class or id that names boilerplate counts wherever there is text outside of the container, however long what stands in it
is. Only where there is none is one container the text's wrapper, named after something beside the text: that with the
article, the first heading or the most text. An article element, too, counts only if it holds the page's text, and not
teasers beside it; without one the text is the run of blocks, in the container that holds most of it, from its heading on."""

from __future__ import annotations

import functools
import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._work import P, others, table

# Elements by how they bound and hold text.
BLOCKS = frozenset(
    (
        "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
        "form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section select summary "
        "table tbody td tfoot th thead title tr ul"
    ).split()
)
CONTAINERS = frozenset(
    (
        "article aside blockquote body button details dialog div dl fieldset figure footer form header html iframe main "
        "menu nav noscript object ol section select table template ul"
    ).split()
)
SILENT = frozenset("script style title textarea xmp noembed noframes iframe svg canvas audio video".split())
BOILER_TAGS = frozenset("nav header footer aside form button select noscript template dialog menu object fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Default names of boilerplate in a class, id or role.
BOILER_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner breadcrumb breadcrumbs byline-share comment comments commentlist consent contentinfo cookie cookies copyright discussion disqus dialog footer form gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pager pagination popup popups promo promoted promotion recommended related replies reply responses search share sharing sidebar sidenav signin signup skip skyscraper social sponsor sponsored sponsors subscribe subscription tagcloud toolbar topbar widget widgets complementary alert".split()
)
# Words of a name after which, or before which, a word says what a container has beside it, not what it is.
HAS = frozenset("with has have no without".split())
STATES = frozenset("open opened closed enabled disabled".split())
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*(?:>|\Z))""", re.S)
_NAMES = re.compile(r"""(?:^|[\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_PART = re.compile(r"[a-z]+")
_HIDDEN = re.compile(r"""(?:^|[\s"'/])(?:hidden(?=[\s/>=]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.I)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


#: Words of a block that alone shows that there is text.
PROSE = 10


@dataclass
class Block:
    """heading: its level, 0 for none; named: numbers of the containers around it whose names are of boilerplate, outermost first;
    article: how many article elements it is in; box: number of the innermost container around it."""

    text: str
    words: int
    link_density: float
    heading: int
    boiler: bool
    named: tuple[int, ...]
    article: int
    main: bool
    box: int

    @property
    def plain(self) -> float:
        return self.words * (1 - self.link_density)

    @property
    def linked(self) -> bool:
        return self.link_density >= 0.5

    @property
    def prose(self) -> bool:
        return self.words >= PROSE and not self.linked and not self.heading


def _hidden(attributes: str) -> bool:
    return len(attributes) > 5 and bool(_HIDDEN.search(attributes))


def _boilerplate(tag: str, attributes: str, known: frozenset[str]) -> bool:
    """Whether an element's class, id or role names boilerplate."""
    if len(attributes) < 3 or tag in ("html", "body", "main"):
        return False
    names = " ".join(a or b or c for a, b, c in _NAMES.findall(attributes))
    return any(_named(n, known) for n in names.split())


def _named(name: str, known: frozenset[str]) -> bool:
    """Whether a class, id or role names boilerplate: comments, post-comments, but not comments-open, with-sidebar, noHeader."""
    parts = _PART.findall(_CAMEL.sub(" ", name).lower())
    for k, part in enumerate(parts):
        if part in HAS:
            return False
        if part in known and not (k + 1 < len(parts) and parts[k + 1] in STATES):
            return True
    return False


@dataclass
class Page:
    """blocks in page order; above: by number of a container, that of the one around it (-1: none)."""

    blocks: list[Block]
    above: list[int]


def blocks(page: str, known: frozenset[str] = BOILER_WORDS) -> Page:
    """The page's text in blocks. Unclosed elements, stray end tags and a page cut anywhere are taken as they come."""
    found: list[Block] = []
    above: list[int] = []
    stack: list[tuple[str, bool, bool, int]] = []
    boiler = article = main = names = heading = 0
    named: tuple[int, ...] = ()
    own: tuple[int, ...] = ()
    parts: list[tuple[str, bool]] = []
    in_link = False

    def flush() -> None:
        nonlocal own
        if parts:
            joined = "".join(p for p, _ in parts)
            if "&" in joined:
                joined = html.unescape(joined)
            words = joined.split()
            if words:
                linked = sum(len(p.split()) for p, a in parts if a)
                box = stack[-1][3] if stack else -1
                found.append(Block(" ".join(words), len(words), min(1.0, linked / len(words)), heading, boiler > 0, named + own, article, main > 0, box))
            parts.clear()
        own = ()

    def close(n: int) -> None:
        nonlocal boiler, article, main, named
        for tag, bad, name, _ in stack[n:]:
            boiler -= bad
            article -= tag == "article"
            main -= tag == "main"
            named = named[: len(named) - name]
        del stack[n:]

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        if m is None:
            parts.append((page[at:], in_link))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], in_link))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in BLOCKS:
                flush()
                if tag in HEADINGS:
                    heading = 0
            if tag == "a":
                in_link = False
            elif tag in CONTAINERS:
                for n in range(len(stack) - 1, -1, -1):
                    if stack[n][0] == tag:
                        flush()
                        in_link = False
                        close(n)
                        break
            continue
        if tag in SILENT:
            if not m[3].endswith("/>"):
                stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else end
            if tag in BLOCKS:
                flush()
            continue
        if tag in BLOCKS or tag in CONTAINERS:
            flush()
            heading = int(tag[1]) if tag in HEADINGS else 0
        if tag == "br":
            parts.append((" ", in_link))
        elif tag == "a":
            in_link = True
        elif tag in CONTAINERS and not m[3].endswith("/>"):
            bad = tag in BOILER_TAGS or _hidden(m[3])
            name = _boilerplate(tag, m[3], known)
            if name:
                names += 1
                named = (*named, names)
            above.append(stack[-1][3] if stack else -1)
            stack.append((tag, bad, name, len(above) - 1))
            boiler += bad
            article += tag == "article"
            main += tag == "main"
        elif tag in ("p", "li", "td") and (_hidden(m[3]) or _boilerplate(tag, m[3], known)):
            names += 1
            own = (names,)
    flush()
    return Page(found, above)


FEATURES = (
    "boilerplate element", "boilerplate by name", "in the text", "page has an element for it",
    "words", "link density", "words before", "link density before", "words after", "link density after", "heading",
)


def _beside(page: Page) -> list[bool]:
    """Of each block, whether it is in a container whose name tells what stands beside the text."""
    beside = [False] * len(page.blocks)
    inside = [k for k, b in enumerate(page.blocks) if not b.boiler]
    depth = 0
    while inside:
        held: dict[int, list[int]] = {}
        free = []
        for k in inside:
            if len(page.blocks[k].named) > depth:
                held.setdefault(page.blocks[k].named[depth], []).append(k)
            else:
                free.append(page.blocks[k])
        if not held:
            break
        wrapper = None
        if not any(b.prose or b.plain and (b.article or b.main) for b in free):
            rank = lambda ks: (any(page.blocks[k].article or page.blocks[k].main for k in ks), any(page.blocks[k].heading == 1 for k in ks), sum(page.blocks[k].plain for k in ks))
            wrapper = max(held, key=lambda name: rank(held[name]))
        for name, ks in held.items():
            for k in ks if name != wrapper else ():
                beside[k] = True
        inside, depth = held.get(wrapper, []), depth + 1
    for k, b in enumerate(page.blocks):
        # names inside elements that are no text anyway
        beside[k] = beside[k] or (b.boiler and len(b.named) > 0)
    return beside


def _runs(found: list[Block], inside: list[bool]) -> float:
    """The most words in a run of prose of which every block is `inside`, short blocks that are no links between it not counted."""
    best = run = 0.0
    for b, within in zip(found, inside, strict=True):
        run = run + b.plain * b.prose if within and not b.linked else run if not within and not b.prose else 0.0
        best = max(best, run)
    return best


def _element(found: list[Block], text: list[bool], within: list[bool]) -> bool:
    """Whether blocks `within` some element are the page's text: they have its first heading, or no run outside has three times their words."""
    words = sum(b.plain for b, t, w in zip(found, text, within, strict=True) if t and w)
    if not words:
        return False
    if any(t and w and b.heading == 1 for b, t, w in zip(found, text, within, strict=True)):
        return True
    return 3 * words >= _runs(found, [t and not w for t, w in zip(text, within, strict=True)])


def _region(page: Page, text: list[bool]) -> list[bool]:
    """The text of a page without an element for it: in the innermost container that holds most prose, from the first to the last
    of it; headings right before; and short blocks right after, in the container of the last."""
    found, above = page.blocks, page.above
    prose = [k for k, b in enumerate(found) if text[k] and b.prose]
    inside = [False] * len(found)
    if not prose:
        return inside
    mass = [0.0] * (len(above) + 1)
    for k in prose:
        mass[found[k].box] += found[k].plain  # the last one is for blocks in no container
    total = sum(mass)
    for box in range(len(above) - 1, -1, -1):
        mass[above[box]] += mass[box]
    box = next((b for b in range(len(above) - 1, -1, -1) if mass[b] >= 0.7 * total), -1)
    held = [box < 0 or b == box for b in range(len(above))] + [box < 0]
    for b in range(len(above)):
        held[b] = held[b] or (above[b] >= 0 and held[above[b]])
    here = [k for k in prose if held[found[k].box]]
    first, last = here[0], here[-1]
    for k in range(first, last + 1):
        inside[k] = text[k] and held[found[k].box] and not found[k].linked
    start = first
    for k in range(first - 1, -1, -1):
        if found[k].linked and text[k]:
            break
        if text[k] and found[k].heading:
            start = k
    for k in range(start, first):
        inside[k] = text[k] and not found[k].linked
    for k in range(last + 1, len(found)):
        if not text[k] or found[k].linked or not _in_or_below(above, found[k].box, found[last].box):
            break
        inside[k] = True
    return inside


def _in_or_below(above: list[int], box: int, outer: int) -> bool:
    """Whether a container is `outer` or stands right in it."""
    return box == outer or (box >= 0 and above[box] == outer and outer >= 0)


def describe(page: Page) -> list[list[float]]:
    """FEATURES of each block."""
    found = page.blocks
    beside = _beside(page)
    text = [not b.boiler and not n for b, n in zip(found, beside, strict=True)]
    if any(b.article == 1 and t and b.plain for b, t in zip(found, text, strict=True)):  # an article in an article is a reader's
        beside = [n or b.article > 1 for b, n in zip(found, beside, strict=True)]
        text = [not b.boiler and not n for b, n in zip(found, beside, strict=True)]
    element = next((e for e in ([b.article > 0 for b in found], [b.main for b in found]) if _element(found, text, e)), None)
    inside = element or _region(page, text)
    if element is None and any(inside):  # articles that are not the text are teasers
        beside = [n or (b.article > 0 and not within) for b, n, within in zip(found, beside, inside, strict=True)]
    ends = [0.0, 0.0]
    own = [[float(b.words), b.link_density] for b in found]
    rows = []
    for k, b in enumerate(found):
        near = [*(own[k - 1] if k else ends), *(own[k + 1] if k + 1 < len(found) else ends)]
        rows.append([float(b.boiler), float(beside[k]), float(inside[k]), float(element is not None or inside[k]), *own[k], *near, float(b.heading > 0)])
    return rows


# Fixed values, the labelled table: FEATURES of blocks as pages have them, and whether they are main text.
LABELLED = (
    # of containers without such a name
    ((1, 0, 0, 1, 1, 1, 0, 0, 1, 1, 0), 0), ((1, 0, 0, 1, 60, 0, 1, 1, 9, 0, 0), 0), ((1, 0, 0, 0, 40, 0.1, 12, 0, 80, 0, 0), 0), ((1, 0, 1, 1, 45, 0, 90, 0, 70, 0, 0), 0),
    ((1, 0, 1, 1, 6, 1, 90, 0, 0, 0, 0), 0), ((1, 0, 1, 1, 3, 0, 0, 0, 60, 0, 1), 0), ((1, 0, 0, 0, 7, 0, 120, 0, 0, 0, 0), 0), ((1, 0, 0, 1, 12, 0.3, 200, 0, 0, 0, 1), 0),
    ((1, 0, 0, 0, 150, 0, 70, 0, 30, 0, 0), 0), ((1, 0, 1, 1, 2, 0, 2, 0, 2, 0, 0), 0), ((0, 0, 1, 1, 8, 0, 12, 0, 60, 0, 1), 1), ((0, 0, 1, 1, 120, 0, 8, 0, 90, 0, 0), 1),
    ((0, 0, 1, 1, 2, 0, 120, 0, 90, 0, 0), 1), ((0, 0, 1, 1, 1, 0, 1, 1, 0, 0, 0), 1), ((0, 0, 1, 1, 25, 0.4, 60, 0, 60, 0.1, 0), 1), ((0, 0, 1, 1, 4, 1, 60, 0, 60, 0, 0), 1),
    ((0, 0, 1, 1, 300, 0.05, 10, 1, 14, 1, 0), 1), ((0, 0, 1, 1, 9, 0, 0, 0, 0, 0, 0), 1), ((0, 0, 1, 1, 5, 1, 4, 1, 80, 0, 0), 1), ((0, 0, 1, 1, 1, 0, 1, 0, 1, 0, 0), 1),
    ((0, 0, 0, 1, 50, 0, 30, 0, 100, 0, 0), 0), ((0, 0, 0, 1, 4, 1, 4, 1, 4, 1, 0), 0), ((0, 0, 0, 1, 8, 0, 60, 0, 0, 0, 0), 0), ((0, 0, 0, 1, 5, 0, 0, 0, 60, 0, 1), 0),
    ((0, 0, 0, 1, 200, 0, 20, 0, 20, 0, 0), 0), ((0, 0, 0, 0, 40, 0, 30, 0, 50, 0, 0), 1), ((0, 0, 0, 0, 120, 0.1, 4, 1, 60, 0, 0), 1), ((0, 0, 0, 0, 80, 0.2, 60, 0, 3, 1, 0), 1),
    ((0, 0, 0, 0, 18, 0, 4, 1, 90, 0, 0), 1), ((0, 0, 0, 0, 6, 0, 4, 1, 90, 0, 1), 1), ((0, 0, 0, 0, 5, 0, 70, 0, 80, 0, 1), 1), ((0, 0, 0, 0, 5, 0, 70, 0, 80, 0, 0), 1),
    ((0, 0, 0, 0, 4, 0, 60, 0, 40, 0, 0), 1), ((0, 0, 0, 0, 30, 0, 0, 0, 0, 0, 0), 1), ((0, 0, 0, 0, 20, 0.1, 5, 1, 0, 0, 0), 1), ((0, 0, 0, 0, 3, 1, 2, 1, 2, 1, 0), 0),
    ((0, 0, 0, 0, 2, 1, 0, 0, 2, 1, 0), 0), ((0, 0, 0, 0, 15, 0.9, 60, 0, 8, 1, 0), 0), ((0, 0, 0, 0, 40, 0.8, 3, 1, 60, 0, 0), 0), ((0, 0, 0, 0, 7, 0.6, 20, 0.9, 4, 1, 0), 0),
    ((0, 0, 0, 0, 5, 0, 3, 1, 4, 1, 0), 0), ((0, 0, 0, 0, 3, 0, 0, 0, 3, 1, 1), 0), ((0, 0, 0, 0, 4, 0, 3, 1, 3, 1, 1), 0), ((0, 0, 0, 0, 8, 0, 5, 0.2, 0, 0, 0), 0),
    ((0, 0, 0, 0, 6, 0.3, 8, 0, 4, 1, 0), 0),
    # of long blocks, and of blocks beside long ones or beside lists of links
    ((0, 0, 1, 1, 500, 0, 300, 0, 400, 0, 0), 1), ((0, 0, 1, 1, 100000, 0, 0, 0, 0, 0, 0), 1), ((0, 0, 1, 1, 30, 0, 60, 0, 4, 1, 0), 1), ((0, 0, 1, 1, 3, 0, 200, 0, 4, 1, 0), 1),
    ((0, 0, 1, 1, 4, 1, 200, 0, 300, 0, 0), 1), ((0, 0, 1, 1, 12, 0.2, 4, 1, 4, 1, 0), 1), ((0, 0, 1, 1, 60, 0, 300, 0, 150, 0, 0), 1), ((0, 0, 1, 1, 200, 0, 120, 0, 220, 0, 0), 1),
    ((0, 0, 1, 1, 3, 0, 0, 0, 300, 0, 1), 1), ((0, 0, 1, 1, 80, 0, 1, 1, 1, 1, 0), 1), ((0, 0, 1, 1, 6, 0, 150, 0, 0, 0, 0), 1), ((0, 0, 1, 1, 2, 1, 2, 1, 2, 1, 0), 1),
    ((0, 0, 1, 1, 300, 0, 200, 0, 4, 1, 0), 1), ((0, 0, 1, 1, 5, 0, 0, 0, 200, 0, 1), 1), ((0, 0, 1, 1, 150, 0, 4, 1, 180, 0, 0), 1), ((0, 0, 1, 1, 4, 1, 90, 0, 120, 0, 0), 1),
    ((0, 0, 0, 0, 400, 0, 200, 0, 300, 0, 0), 1), ((0, 0, 0, 0, 100000, 0, 0, 0, 0, 0, 0), 1), ((0, 0, 0, 0, 90, 0, 120, 0, 4, 1, 0), 1), ((0, 0, 0, 0, 5, 0, 90, 0, 300, 0, 1), 1),
    ((0, 0, 0, 0, 400, 0, 200, 0, 300, 0, 0), 1), ((0, 0, 0, 0, 50, 0, 120, 0, 4, 1, 0), 1), ((0, 0, 0, 0, 5, 0, 3, 1, 60, 0, 1), 1), ((0, 0, 0, 0, 12, 0, 150, 0, 200, 0, 0), 1),
    ((0, 0, 0, 1, 500, 0, 20, 0, 300, 0, 0), 0), ((0, 0, 0, 1, 60, 0, 300, 0, 4, 1, 0), 0), ((0, 0, 0, 1, 15, 0, 2, 1, 120, 0, 0), 0), ((0, 0, 0, 1, 90, 0, 60, 0, 200, 0, 0), 0),
    ((1, 0, 1, 1, 200, 0, 60, 0, 300, 0, 0), 0), ((1, 0, 0, 0, 500, 0, 300, 0, 400, 0, 0), 0), ((1, 0, 1, 1, 20, 0, 120, 0, 200, 0, 0), 0), ((1, 0, 0, 0, 60, 0, 200, 0, 4, 1, 0), 0),
    ((1, 1, 0, 0, 80, 0, 30, 0, 200, 0, 0), 0), ((1, 1, 1, 1, 300, 0, 30, 0, 40, 0, 0), 0), ((1, 0, 1, 1, 40, 0, 60, 0, 80, 0, 0), 0), ((1, 0, 0, 0, 20, 0, 60, 0, 80, 0, 0), 0),
    ((0, 1, 1, 1, 300, 0, 200, 0, 250, 0, 0), 0), ((0, 1, 0, 0, 400, 0, 200, 0, 300, 0, 0), 0), ((0, 1, 1, 1, 40, 0, 300, 0, 4, 1, 0), 0), ((0, 1, 0, 0, 20, 0, 150, 0, 200, 0, 0), 0),
    # of boilerplate so named: notices, comments, related links, newsletters, side bars
    ((0, 1, 0, 1, 14, 0, 1, 1, 9, 0, 0), 0), ((0, 1, 0, 1, 60, 0, 6, 1, 9, 0, 0), 0), ((0, 1, 0, 0, 40, 0.1, 12, 0, 80, 0, 0), 0), ((0, 1, 1, 1, 45, 0, 90, 0, 70, 0, 0), 0),
    ((0, 1, 1, 1, 6, 1, 90, 0, 0, 0, 0), 0), ((0, 1, 1, 1, 3, 0, 0, 0, 60, 0, 1), 0), ((0, 1, 0, 0, 7, 0, 120, 0, 0, 0, 0), 0), ((0, 1, 0, 0, 12, 0.3, 200, 0, 0, 0, 1), 0),
    ((0, 1, 0, 0, 150, 0, 70, 0, 30, 0, 0), 0), ((0, 1, 1, 1, 2, 0, 2, 0, 2, 0, 0), 0), ((0, 1, 1, 1, 80, 0, 40, 0, 30, 0, 0), 0), ((0, 1, 1, 1, 25, 0, 30, 0, 35, 0, 0), 0),
    ((0, 1, 1, 1, 9, 0.5, 60, 0, 60, 0, 0), 0), ((0, 1, 0, 1, 30, 0, 20, 0, 20, 0, 0), 0), ((0, 1, 0, 0, 25, 0, 4, 1, 70, 0, 0), 0), ((0, 1, 0, 0, 90, 0, 60, 0, 2, 1, 0), 0),
    ((0, 1, 1, 1, 1, 0, 1, 0, 1, 0, 0), 0), ((0, 1, 0, 0, 20, 0.1, 25, 0, 30, 0, 0), 0),
    # of texts in wrappers that are named after what stands beside them
    ((0, 0, 1, 1, 8, 0, 12, 0, 60, 0, 1), 1), ((0, 0, 1, 1, 120, 0, 8, 0, 90, 0, 0), 1), ((0, 0, 0, 0, 60, 0, 4, 1, 50, 0, 0), 1), ((0, 0, 0, 0, 120, 0, 60, 0, 80, 0, 0), 1),
    ((0, 0, 0, 0, 6, 0, 4, 1, 90, 0, 1), 1), ((0, 0, 0, 0, 5, 0, 70, 0, 80, 0, 0), 1), ((0, 0, 0, 0, 40, 0.1, 30, 0, 0, 0, 0), 1), ((0, 0, 1, 1, 2, 0, 120, 0, 90, 0, 0), 1),
    ((0, 0, 0, 0, 30, 0, 0, 0, 0, 0, 0), 1), ((0, 0, 0, 0, 30, 0, 0, 0, 0, 0, 0), 1), ((0, 0, 0, 0, 18, 0, 5, 1, 0, 0, 0), 1), ((0, 0, 0, 0, 70, 0, 40, 0, 40, 0, 0), 1),
    # of link lists and remarks in such wrappers
    ((0, 0, 0, 0, 3, 1, 2, 1, 2, 1, 0), 0), ((0, 0, 0, 0, 7, 0.8, 20, 0.9, 4, 1, 0), 0), ((0, 0, 0, 1, 4, 1, 4, 1, 4, 1, 0), 0), ((0, 0, 0, 0, 5, 0, 3, 1, 4, 1, 0), 0),
    ((0, 0, 0, 1, 40, 0, 30, 0, 50, 0, 0), 0),
)


@functools.cache
def decision_tree(depth: int = 8) -> tuple:
    """A tree of (feature, threshold, yes, no) and leaves, grown on LABELLED by Gini impurity; ties take the first feature."""
    x = np.array([r[0] for r in LABELLED], dtype=float)
    y = np.array([r[1] for r in LABELLED], dtype=float)

    def impurity(v: np.ndarray) -> float:
        p = v.mean()
        return len(v) * 2 * p * (1 - p)

    def grow(rows: np.ndarray, level: int):
        v = y[rows]
        if level == depth or v.min() == v.max():
            return bool(v.mean() >= 0.5)
        best = (impurity(v) - 1e-9, -1, 0.0)
        for j in range(x.shape[1]):
            values = np.unique(x[rows, j])
            for t in (values[:-1] + values[1:]) / 2:
                low = x[rows, j] <= t
                if (i := impurity(v[low]) + impurity(v[~low])) < best[0] - 1e-9:
                    best = (i, j, float(t))
        if best[1] < 0:
            return bool(v.mean() >= 0.5)
        low = x[rows, best[1]] <= best[2]
        return best[1], best[2], grow(rows[low], level + 1), grow(rows[~low], level + 1)

    return grow(np.arange(len(y)), 0)


def is_main(features: list[float]) -> bool:
    node = decision_tree()
    while node is not True and node is not False:
        node = node[2] if features[node[0]] <= node[1] else node[3]
    return node


def main_text(page: str | None, known: frozenset[str] = BOILER_WORDS) -> str:
    """The main blocks in page order, joined by newlines; null, empty and text-less pages give an empty text."""
    found = blocks(page or "", known)
    return "\n".join(b.text for b, f in zip(found.blocks, describe(found), strict=True) if is_main(f))


def extract(page: Column | str, known: frozenset[str] = BOILER_WORDS) -> Column:
    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([main_text(t.as_py(), known) for t in batch], pa.string())

    return run(page)


def extract_text(pages: DataFrame, html_col: str = "html", known: frozenset[str] = BOILER_WORDS) -> DataFrame:
    """known: words that name boilerplate in a class, id or role. pages with text and n_chars (its code points) in place of the html column; columns with those names are replaced.

    Rows are read one by one, whole: repeated rows, nulls elsewhere and empty tables need no rule."""
    rest = [F.col(f"`{c}`") for c in others(pages, [html_col, "text", "n_chars"])]
    done = pages.select(*rest, extract(F.coalesce(F.col(f"`{html_col}`"), F.lit("")), known).alias(P + "text"))
    return done.select(*rest, F.col(P + "text").alias("text"), F.length(P + "text").cast("long").alias("n_chars"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
