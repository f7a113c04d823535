"""Main text of web pages by minimum-cut labelling of their blocks.

A page is cut into blocks of text by its block-level elements. A logistic classifier, fitted on made-up
pages (``html_training``), gives each block log-odds from its length, links and the elements around it;
they become the capacity to one terminal (content) or the other (boilerplate). Smoothness edges join
blocks that follow one another and blocks that share a parent, with capacities that fall with the
distance in the element tree. The minimum cut labels the blocks: maximum flow runs on those that their
own capacity doesn't settle (a block whose terminal outweighs all its edges keeps its side in every
minimum cut).

Character references are decoded, white space inside a block (line breaks included) becomes one
space, blocks are trimmed and joined by line feeds in page order.

Edge cases: null html is empty; a page without blocks or with boilerplate only gives the empty text;
unclosed elements, comments, scripts and tags end with the page (a button, list of choices, picture or
embedded object that is never closed or closes itself holds nothing); repeated rows and null ids are
kept; a very long page is parsed whole, in linear time; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from collections.abc import Iterator
from html import unescape
from math import exp, log

import pyarrow as pa
from pyspark.sql import DataFrame

from . import common, html_training

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)"
    r"|<(/?)([A-Za-z][A-Za-z0-9:-]*+)([^>]*+)(?:>|\Z)"
    r"|<[!?/][^>]*+(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
NAMES = frozenset("class id role itemprop".split())
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
WORDS = re.compile(r"[a-z]+", re.I)

BLOCK = frozenset(
    "address article aside blockquote body button canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html iframe legend li main menu nav noscript object ol optgroup option p pre search section select summary "
    "table tbody td template tfoot th thead title tr ul video audio".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold characters, not markup, up to their end tag; none of it is text of the page.
RAW = frozenset("script style title textarea iframe noembed noframes xmp".split())
#: Elements whose text counts as set apart.
SILENT = frozenset("template noscript select button svg object canvas audio video datalist".split())
#: Elements, and words in class, id and role, that speak against the text inside.
APART = frozenset("nav footer aside form menu dialog search".split())
APART_WORDS = frozenset(
    "nav navbar navigation menu sidebar footer header masthead ad ads adv advert advertisement adsense banner promo promoted promotion sponsor sponsored "
    "cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup signin login share sharing social comment "
    "comments commentlist disqus reply replies respond discussion related recommended recommendations breadcrumb breadcrumbs pagination pager widget "
    "search toolbar topbar skip skiplink copyright legal disclaimer complementary contentinfo feedback rating toc tags tagcloud trending popular".split()
)
#: Those among them that don't count where words for the article stand beside them.
WEAK_WORDS = frozenset("header masthead popular trending legal rating feedback tags toc search overlay notice".split())
#: Words of no weight that names of page parts are made with. A name with any other word, as "social-history", tells little.
PART_WORDS = frozenset(
    "site page box block list section container wrapper wrap inner outer top bottom left right col column row area panel bar item items links link group "
    "module body text title head heading articles posts stories entries form button buttons primary secondary global local mobile desktop fixed sticky thread user users reader readers".split()
)
#: The same for the article itself.
MAIN = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article content main post entry story maincontent articlebody".split())
SLIGHT_WORDS = frozenset("byline meta author date dateline timestamp caption credit".split())
KNOWN_WORDS = APART_WORDS | PART_WORDS | MAIN_WORDS | SLIGHT_WORDS
#: Opening one of these closes an open element of the listed kinds.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "optgroup": ("optgroup", "option")}
FENCE = frozenset("ul ol dl table select body html div article section main aside nav footer header form".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Smoothness of neighbours and of siblings.
NEAR, SIBLING = 1.5, 0.75


class Element:
    __slots__ = ("tag", "parent", "depth", "home", "apart", "worded", "loose", "main", "slight")

    def __init__(self, tag: str, attributes: str, parent: Element | None) -> None:
        self.tag, self.parent = tag, parent
        self.depth = parent.depth + 1 if parent else 0
        self.home: Element = self if parent is None or tag in BLOCK else parent.home  # the innermost block element
        inside = parent.main if parent else False
        apart, slight = parent.apart if parent else False, parent.slight if parent else False
        worded, loose = parent.worded if parent else False, False
        main = inside
        if tag in APART or tag in SILENT or (tag == "header" and not inside):
            apart = True
        elif tag in MAIN:
            main = True
        for name, a, b, c in ATTRIBUTE.findall(attributes) if attributes and tag not in ("html", "body") else ():
            name, value = name.lower(), a or b or c
            if name in NAMES:
                tokens = [{w.lower() for w in WORDS.findall(token)} for token in value.split()]
                # Words of a name that only page parts have count; in other names they are a hint.
                words = set().union(*(t for t in tokens if t <= KNOWN_WORDS))
                loose = loose or any(t & APART_WORDS for t in tokens if not t <= KNOWN_WORDS)
                against = words & APART_WORDS
                if against - WEAK_WORDS or (against and not words & MAIN_WORDS and not (inside and "header" in against)):
                    worded = True
                elif words & SLIGHT_WORDS:
                    slight = True
                elif words & MAIN_WORDS:
                    main = True
                apart = apart or name == "class" and {"hidden"} in tokens
            elif name == "hidden" or name == "aria-hidden":
                apart = apart or value.lower() == "true" or name == "hidden" and value.lower() != "false"
            elif name == "style":
                apart = apart or bool(UNSEEN.search(value))
        self.apart, self.worded, self.loose, self.main, self.slight = apart, worded, loose or (parent is not None and parent.loose and tag not in MAIN), main, slight


def blocks_of(html: str) -> list[tuple[str, Element, float]]:
    """(text, innermost block element, share of its characters in links) in page order."""
    found: list[tuple[str, Element, float]] = []
    root = Element("", "", None)
    stack = [root]
    parts: list[str] = []
    linked: list[str] = []
    links = at = 0
    opened: Counter[str] = Counter()
    last_end: dict[str, int] = {}

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = "".join(parts)
            if "&" in text:
                text = unescape(text)
            text = " ".join(text.split())
            if text:
                inside = " ".join(unescape("".join(linked)).split()) if linked else ""
                found.append((text, stack[-1].home, min(1.0, len(inside) / len(text))))
            parts, linked = [], []

    def cut(i: int) -> None:
        nonlocal links
        for e in stack[i:]:
            opened[e.tag] -= 1
            links -= e.tag == "a"
        del stack[i:]

    def close(kinds: tuple[str, ...], fence: frozenset) -> None:
        if not any(opened[k] for k in kinds):
            return
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in kinds:
                cut(i)
                return
            if stack[i].tag in fence:
                return

    def never_closed(tag: str) -> bool:
        if tag not in last_end:
            last_end[tag] = max((m.start() for m in re.finditer(f"</{tag}\\b", html, re.I)), default=-1)
        return last_end[tag] < at

    while m := TAG.search(html, at):
        if m.start() > at:
            piece = html[at : m.start()]
            parts.append(piece)
            if links:
                linked.append(piece)
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if tag in BLOCK:
                flush()
            if tag == "br":
                parts.append(" ")
            for i in range(len(stack) - 1, 0, -1) if opened[tag] else ():
                if stack[i].tag == tag:
                    cut(i)
                    break
                if tag not in BLOCK and stack[i].tag in BLOCK:
                    break
            continue
        attributes = m[3] if m[2] else m[6]
        if tag in RAW:
            if tag in BLOCK:
                flush()
            end = re.compile(f"</{tag}\\b[^>]*+(?:>|\\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if tag in SILENT:
            flush()
            if attributes.endswith("/") or never_closed(tag):
                continue
        if tag in BLOCK:
            flush()
            close(("p",), FENCE)
            if tag in CLOSES:
                close(CLOSES[tag], FENCE)
        elif tag in VOID:
            parts.append(" " if tag == "br" else "")
            continue
        if tag in VOID:
            continue
        if tag == "a":
            close(("a",), BLOCK)
            links += 1
        opened[tag] += 1
        stack.append(Element(tag, attributes, stack[-1]))
    if at < len(html):
        parts.append(html[at:])
    flush()
    return found


FEATURES = (
    "bias", "length", "one_word", "sentence", "linked", "all_linked", "heading", "item", "main", "apart", "worded", "slight", "rights", "plain_sentence", "linked_outside", "apart_inside", "rights_inside", "loose",
)


def features(text: str, home: Element, links: float) -> tuple[float, ...]:
    """Numbers of ``FEATURES`` for a block."""
    words = text.count(" ") + 1
    sentence = text[-1] in ".!?…。»\"”" or ". " in text
    away = home.apart or home.worded
    rights = "©" in text or (words < 30 and "rights reserved" in text.lower())
    return (
        1.0, log(words), words == 1, sentence, links, links > 0.9, home.tag in HEADINGS, home.tag in ("li", "dd", "dt", "td", "th"), home.main, home.apart, home.worded, home.slight, rights,
        sentence and not home.main and not away, links * (not home.main), home.main and away, rights and home.main, home.loose,
    )


def score(text: str, home: Element, links: float, weights: tuple[float, ...]) -> float:
    """Log-odds that a block is content."""
    return sum(w * x for w, x in zip(weights, features(text, home, links), strict=True))


def distance(a: Element, b: Element) -> int:
    """Steps between two elements in the tree, 20 at most."""
    n = 0
    while a is not b and n < 20:
        n += 1
        if a.depth >= b.depth:
            a = a.parent
        else:
            b = b.parent
    return n


def edges_of(homes: list[Element]) -> dict[tuple[int, int], float]:
    """Smoothness capacities between block numbers."""
    edges: dict[tuple[int, int], float] = {}
    last: dict[int, int] = {}
    for i, home in enumerate(homes):
        if i:
            edges[i - 1, i] = NEAR * exp(-0.5 * distance(homes[i - 1], home))
        up = id(home.parent or home)
        j = last.get(up)
        if j is not None:
            edges[j, i] = edges.get((j, i), 0.0) + SIBLING
        last[up] = i
    return edges


def minimum_cut(scores: list[float], edges: dict[tuple[int, int], float]) -> list[bool]:
    """Whether each node is on the content side of a minimum cut.

    A node with a score s has capacity s from the source if s > 0, else -s to the sink.
    """
    n = len(scores)
    around: list[dict[int, float]] = [{} for _ in range(n)]
    for (a, b), c in edges.items():
        if c > 0 and a != b:
            around[a][b] = around[a].get(b, 0.0) + c
            around[b][a] = around[b].get(a, 0.0) + c
    side: list[bool | None] = [None] * n
    need = list(scores)
    # Nodes that outweigh their edges keep their side in every minimum cut: they pull their neighbours with fixed force.
    firm = [i for i in range(n) if abs(scores[i]) >= sum(around[i].values())]
    for i in firm:
        side[i] = scores[i] > 0
    for i in firm:
        for j, c in around[i].items():
            if side[j] is None:
                need[j] += c if side[i] else -c
                del around[j][i]
    free = [i for i in range(n) if side[i] is None]
    if free:
        kept = max_flow(free, need, around)
        for i in free:
            side[i] = i in kept
    return [bool(x) for x in side]


def max_flow(nodes: list[int], need: list[float], around: list[dict[int, float]]) -> set[int]:
    """Nodes that the source still reaches after maximum flow (Dinic's phases)."""
    source, sink = -1, -2
    room: dict[int, dict[int, float]] = {i: dict(around[i]) for i in nodes}
    room[source], room[sink] = {}, {}
    for i in nodes:
        if need[i] > 0:
            room[source][i] = need[i]
            room[i][source] = 0.0
        elif need[i] < 0:
            room[i][sink] = -need[i]
            room[sink][i] = 0.0
    tiny = 1e-12
    while True:
        level, queue = {source: 0}, deque([source])
        while queue:
            u = queue.popleft()
            for v, c in room[u].items():
                if c > tiny and v not in level:
                    level[v] = level[u] + 1
                    queue.append(v)
        if sink not in level:
            return {i for i in nodes if i in level}
        turn = {u: iter(list(room[u])) for u in level}
        path = [source]
        while path:
            u = path[-1]
            if u == sink:
                push = min(room[a][b] for a, b in zip(path, path[1:], strict=False))
                for k in range(len(path) - 1):
                    a, b = path[k], path[k + 1]
                    room[a][b] -= push
                    room[b][a] += push
                k = next(k for k in range(len(path) - 1) if room[path[k]][path[k + 1]] <= tiny)
                del path[k + 1 :]
                continue
            for v in turn[u]:
                if room[u][v] > tiny and level.get(v) == level[u] + 1:
                    path.append(v)
                    break
            else:
                path.pop()
                if path:
                    level[u] = -1


def main_text(html: str | None, weights: tuple[float, ...] | None = None) -> tuple[str, int]:
    """The main text of one page and how many blocks it came from."""
    weights = weights or html_training.weights()
    found = blocks_of(html) if html else []
    if not found:
        return "", 0
    kept = minimum_cut([score(*b, weights) for b in found], edges_of([b[1] for b in found]))
    texts = [b[0] for b, k in zip(found, kept, strict=True) if k]
    return "\n".join(texts), len(texts)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks per row of (page_id, url, html). No exchange."""
    weights = html_training.weights()  # fitted here, so that tasks only carry the numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts = [], []
            for value in batch.column(2):
                text, n = main_text(value.as_py(), weights)
                texts.append(text)
                counts.append(n)
            size = [len(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(size, pa.int64()), pa.array(counts, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    return pages.selectExpr("cast(page_id as long) page_id", "cast(url as string) url", "cast(html as string) html").mapInArrow(common.frugal(run), "page_id long, url string, text string, n_chars long, n_blocks long")
