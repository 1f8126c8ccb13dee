"""HTML extraction by minimum-cut labelling.

A page is read into text blocks, and into regions: elements whose tag, role or names say something about what they hold,
nested in one another.  Both are nodes.  A linear classifier gives each block, from its text alone, the cost of calling
it content or boilerplate, and each region the cost of going against its marks, times its blocks; these are the
capacities of their edges to the two terminals.  A block is tied to its region, and a region to the one around it, as
strongly as that is marked (proximity in the document tree); neighbouring blocks, and blocks of one parent element, are
tied by edges that weaken with their distance in the tree.  A maximum flow then separates content from boilerplate at
the least total cost.
"""

from __future__ import annotations

import functools
import html
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from evenkeel.llm.common import annotate, fresh, ship

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?", re.S)
_NAME = re.compile(r"[a-z]+|[0-9]+")

# Kinds of elements in HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template annotation annotation-xml desc metadata".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var br wbr img input nobr rp rt ruby".split()) | frozenset(
    "object math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot mstyle merror mpadded mphantom mfenced menclose msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd svg g text tspan textpath path rect circle ellipse line polygon polyline use".split()
)
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "option": frozenset(["option", "optgroup"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]), "td": frozenset(["td", "th", "tr", "tbody"]), "th": frozenset(["td", "th", "tr", "tbody"]), "head": frozenset(["body"]),
}
#: An end tag or a start tag does not close elements beyond these.
FENCE = frozenset("html body article section div table td th ul ol dl main aside nav footer header form blockquote button figure".split())
DROPPED = frozenset("nav footer aside form button select fieldset dialog menu head".split())
DROPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form status".split())

# Words that make up class and id names, and what a name adds to the evidence for content if all its words are known.
HINTS = {
    -9.0: "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup paywall share sharing social sidebar widget menu nav navbar navigation breadcrumb breadcrumbs footer copyright legal comment comments commentlist disqus discussion respond replies reply feedback related recommended recommendations trending pagination pager toolbar masthead skip login search form sidenav topbar".split(),
    3.0: "article post entry content main story body text prose".split(),
}
_HINT = {w: v for v, ws in HINTS.items() for w in ws}
#: Words that say nothing by themselves, but leave a name what its other words make it.
PLAIN = frozenset("a all area bar bars block blocks body box boxes btn button buttons by col column container content count cta desktop first footer form forms group head header icon icons inner item items js label last left link links list lists main mobile module more most new of on open out outer page panel panes posts read right row section sections site slot small stories story tab tabs tag tags text the thread title to tool tools top us view wide wrap wrapper you your".split())
#: What a name with other words in it counts: it may as well be what the text is about.
DOUBT = 1.0

#: Evidence that the cut should not go against.
HARD = 60.0
#: Evidence for content that nested elements add up to at most.
MOST = 12.0
#: Steps in the tree beyond which blocks are not tied.
FAR = 12
#: Tags that a start tag may close.
CLOSES = {t: [k for k, v in CLOSED_BY.items() if t in v] for t in frozenset().union(*CLOSED_BY.values())}


@dataclass
class Block:
    text: str
    at: _Element  # the block element it stands in
    linked: float  # share of characters within links


class _Element:
    """An open element.  `block` is the nearest element that is not inline, `region` the number of its region."""

    __slots__ = ("tag", "depth", "parent", "block", "region", "within")

    def __init__(self, tag: str, parent: _Element | None, region: int, within: bool, inline: bool):
        self.tag, self.parent, self.region, self.within = tag, parent, region, within
        self.depth = parent.block.depth + 1 if parent else 0
        self.block = parent.block if parent and inline else self


@dataclass
class Region:
    parent: int
    own: float  # what its element says about the blocks in it
    evidence: float  # that and what the regions around it say
    blocks: int = 0  # in it and in the regions within


@functools.lru_cache(1 << 14)
def _hint(name: str) -> float:
    """What one class or id says.  Its words must all be known; else it weighs no more than DOUBT either way."""
    words = _NAME.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
    hints = [_HINT[w] for w in words if w in _HINT]
    if not hints:
        return 0.0
    value = min(hints) if min(hints) < 0 else max(hints)
    known = all(w in _HINT or w in PLAIN or w.isdigit() or len(w) == 1 for w in words)
    return value if known else math.copysign(DOUBT, value)


def _evidence(tag: str, attributes: str) -> float:
    """What an element says about the blocks in it; -HARD and beyond settles it."""
    if tag in DROPPED:
        return -HARD
    total = 8.0 if tag in ("article", "main") else 0.0
    if attributes:
        found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in _ATTRIBUTE.finditer(attributes)}
        role = found.get("role", "").lower()
        if role in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            return -HARD
        total += 8.0 * (role in ("main", "article")) + 4.0 * ("articlebody" in found.get("itemprop", "").lower())
        hints = [h for n in (found.get("class", "") + " " + found.get("id", "")).split() if (h := _hint(n))]
        if hints:
            total += min(hints) if tag not in ("html", "body") and min(hints) < 0 else max(0.0, max(hints))
    return total


def blocks(page: str) -> tuple[list[Block], list[Region]]:
    """The text blocks in page order, white space turned into single spaces, references decoded, none empty; and the
    regions, of which the first is the page and others come after those around them."""
    out: list[Block] = []
    regions = [Region(-1, 0.0, 0.0)]
    stack = [_Element("", None, 0, False, False)]
    opened: Counter[str] = Counter()
    at = 0
    parts: list[str] = []
    links = 0

    def flush() -> None:
        nonlocal links
        text = " ".join("".join(parts).split())
        if text:
            out.append(Block(text, stack[-1].block, min(1.0, links / len(text))))
        parts.clear()
        links = 0

    def close(k: int) -> None:
        for e in stack[k:]:
            opened[e.tag] -= 1
        del stack[k:]

    def text_of(raw: str) -> None:
        nonlocal links
        if raw:
            raw = html.unescape(raw) if "&" in raw else raw
            parts.append(raw)
            if opened["a"] > 0:
                links += len(raw.strip())

    while True:
        m = _TOKEN.search(page, at)
        if m is None:
            text_of(page[at:])
            break
        text_of(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag in INLINE:
                for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                    if stack[k].tag == tag:
                        close(k)
                        break
                    if stack[k].tag not in INLINE:
                        break
                if tag == "br":
                    parts.append(" ")
                continue
            flush()
            for k in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if tag not in FENCE and stack[k].tag in FENCE:
                    break
            continue
        if tag in RAW and not m[3].endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}\s*(?:[\s/][^>]*)?>", re.I).search(page, at)
            at = end.end() if end else len(page)
            if tag not in ("title", "noscript", "template"):
                parts.append(" ")
            continue
        if tag in INLINE:
            if tag in VOID:
                parts.append(" " if tag in ("br", "input", "img") else "")
            else:
                opened[tag] += 1
                stack.append(_Element(tag, stack[-1], stack[-1].region, stack[-1].within, True))
            continue
        flush()
        for k in range(len(stack) - 1, 0, -1) if any(opened[t] for t in CLOSES.get(tag, ())) else ():
            if tag in CLOSED_BY.get(stack[k].tag, ()):
                close(k)
                break
            if stack[k].tag in FENCE and stack[k].tag not in CLOSED_BY:
                break
        if tag in VOID:
            continue
        while len(stack) > 1 and stack[-1].tag in INLINE and tag not in ("li", "td", "th"):
            close(len(stack) - 1)  # an unclosed inline element ends at the next block
        top = stack[-1]
        own = -HARD if tag == "header" and not top.within else _evidence(tag, m[3])
        region, around = top.region, regions[top.region].evidence
        if own and around > -HARD:
            evidence = -HARD if own <= -HARD else max(-HARD + 1, min(around + own, own if own < -4 else MOST))
            if evidence != around:  # one that adds nothing to those around it is no region of its own
                regions.append(Region(region, max(own, -HARD), evidence))
                region = len(regions) - 1
        opened[tag] += 1
        stack.append(_Element(tag, top, region, top.within or tag in ("article", "main") or own >= 8.0, False))
    flush()
    for b in out:
        regions[b.at.region].blocks += 1
    for r in reversed(regions[1:]):
        regions[r.parent].blocks += r.blocks
    return out, regions


def cost(b: Block) -> float:
    """Log-odds that a block is content, from its text, its links and its own tag."""
    words = b.text.count(" ") + 1
    z = -1.5 + 0.9 * math.log(words) + 0.6 * min(3, sum(map(b.text.count, ".!?,;:")))
    z -= 6.0 * b.linked * (words < 60)
    return z + {"p": 1.0, "h1": 1.5, "h2": 1.0, "h3": 1.0, "blockquote": 1.0, "pre": 1.0, "figcaption": 0.5, "li": -0.3, "td": -0.3}.get(b.at.tag, 0.0)


def closeness(a: Block, b: Block) -> float:
    """Smoothness of two blocks: halves with each step of their distance in the tree; none beyond FAR steps."""
    x, y, steps = a.at, b.at, 0
    while x is not y:
        if steps >= FAR:
            return 0.0
        if x.depth >= y.depth:
            x = x.parent.block
        else:
            y = y.parent.block
        steps += 1
    return 2.0 * 0.5 ** max(0, steps - 2)


def min_cut(gain: list[float], edges: list[tuple]) -> list[bool]:
    """Labels (True: content) that maximise the sum of gains of content less the weights of cut edges.

    An edge (a, b, w, v) costs w where a is content and b is not, and v (w if left out) the other way round.  Dinic's algorithm; a node's
    positive gain is its edge from the source, a negative one its edge to the sink.
    """
    n = len(gain)
    if not n:
        return []
    s, t = n, n + 1
    to: list[int] = []
    cap: list[float] = []
    adj: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float) -> None:
        adj[a].append(len(to))
        to.append(b)
        cap.append(forth)
        adj[b].append(len(to))
        to.append(a)
        cap.append(back)

    for i, g in enumerate(gain):
        if g > 0:
            add(s, i, g, 0.0)
        elif g < 0:
            add(i, t, -g, 0.0)
    for a, b, forth, *back in edges:
        add(a, b, forth, back[0] if back else forth)
    tiny = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = [s]
        for x in queue:
            for e in adj[x]:
                if cap[e] > tiny and level[to[e]] < 0:
                    level[to[e]] = level[x] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        nxt = [0] * (n + 2)
        path: list[int] = []
        x = s
        while True:
            if x == t:
                flow = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= flow
                    cap[e ^ 1] += flow
                k = next(i for i, e in enumerate(path) if cap[e] <= tiny)
                del path[k:]
                x = to[path[-1]] if path else s
                continue
            while nxt[x] < len(adj[x]):
                e = adj[x][nxt[x]]
                if cap[e] > tiny and level[to[e]] == level[x] + 1:
                    break
                nxt[x] += 1
            if nxt[x] < len(adj[x]):
                path.append(adj[x][nxt[x]])
                x = to[path[-1]]
            elif path:
                x = to[path.pop() ^ 1]
                nxt[x] += 1
            else:
                break


def graph(found: list[Block], regions: list[Region]) -> tuple[list[float], list[tuple[int, int, float, float]]]:
    """Gains and edges: the blocks' nodes come first, then the regions'."""
    n = len(found)
    gain = [cost(b) for b in found] + [r.own * r.blocks for r in regions]
    edges = [(n + b.at.region, i, max(0.0, e), max(0.0, -e)) for i, b in enumerate(found) if (e := regions[b.at.region].evidence)]
    for k, r in enumerate(regions[1:], 1):
        e = regions[r.parent].evidence
        if e and r.blocks:  # what is marked against its surroundings is expected to differ from them
            edges.append((n + r.parent, n + k, 0.0 if r.own < 0 else max(0.0, e) * r.blocks, max(0.0, -e) * r.blocks))
    last: dict[int, int] = {}
    for i, b in enumerate(found):
        if i and (w := closeness(found[i - 1], b)):
            edges.append((i - 1, i, w, w))
        parent = id(b.at.parent)
        if parent in last and last[parent] < i - 1:
            edges.append((last[parent], i, 1.0, 1.0))  # kin that others stand between
        last[parent] = i
    return gain, edges


def labelled(page: str | None) -> list[tuple[Block, bool]]:
    found, regions = blocks(page or "")
    return list(zip(found, min_cut(*graph(found, regions)), strict=False))


def extract(page: str | None) -> str:
    return "\n\n".join(b.text for b, content in labelled(page) if content)


FIELDS = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def main_text(spark: SparkSession, pages: DataFrame, html_col: str = "html", keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """pages' columns (`keep`, all by default) and a struct FIELDS with the main text; and that column's name.

    Null, empty and text-less pages have an empty text.  Markup that is cut short or badly nested is read as far as it
    goes.  Each page is handled on its own; repeated rows stay; an empty table gives no rows.
    """
    ship(spark)

    def make():
        def kernel(pages):
            texts = [extract(p) for p in pages]
            return {"text": texts, "n_chars": [len(t) for t in texts]}

        return kernel

    name = fresh(pages, "main")
    return annotate(pages, html_col, make, FIELDS, name, keep), name
