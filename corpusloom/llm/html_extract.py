"""Main-text extraction by a minimum cut over a page's blocks and elements.

Nodes are the text blocks of a page and the block elements around them. A classifier gives each block a cost for
either label by its words, links and marks; elements get costs by their tags and names. These become capacities to
the two terminals. Smoothness edges join blocks that follow each other, a block and its element, and an element and
the one around it: firm below an element whose tag or name tells something, weak above it and where nothing is known. Every
cost and edge is finite but those of hidden elements, and what a bad tag or name weighs depends on how much of the page's prose is elsewhere.
The minimum cut, found by max-flow, is the cheapest labelling into content and boilerplate. So a long paragraph in a
sidebar beside an article goes, a short one between long ones stays, and an article that is all of a page's prose stays whatever its
elements are called.
"""

from __future__ import annotations

import html as html_entities
import math
import re
from collections import Counter, deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_slices

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>""", re.S)
_RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "iframe", "object", "select", "button", "xmp", "noembed", "noframes"}
_RAW_END = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in _RAW}
_BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Without an end tag, what follows these is code; what follows others is text of the page.
_CODE = {"script", "style"}
_VOID = {"hr"}
#: Opening one of these ends an open one of the same kind that nothing but text stands between.
_IMPLIED = {"p": {"p"}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}}
_BAD_TAGS = {"nav", "footer", "aside", "menu", "dialog", "head"}
_GOOD_TAGS = {"article", "main"}
_ATTR = re.compile(r"""\b(class|id|role|aria-label|itemprop|hidden|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: Names of what surrounds an article, and names that an article may also have.
_STRONG = r"ads?|adverts?|advertisements?|advertising|adv|sponsor(?:ed|s)?|sponsorships?|nav|navs|navbar|navmenu|navigation|breadcrumbs?|sidebar\w*|side|footer\w*|masthead|comments?|commentlist|respond|responses?|replies|reply|disqus|cookies?|consent|gdpr|popup|modal|subscribe|signup|login|share|shares|sharing|sharebar|pagination|pager|copyright|complementary|contentinfo"
_WEAK = r"menus?|menubar|promos?|promotions?|banner|header|discussion|notice|notification|alert|overlay|newsletter|related|recommend(?:ed|ations?)?|social|widgets?|toolbar|legal|search"
_BAD_NAME = re.compile(rf"(?:{_STRONG}|{_WEAK})\d*", re.I)
_WEAK_NAME = re.compile(rf"(?:{_WEAK})\d*", re.I)
#: Bad names that make a longer name bad wherever it begins with them.
_BAD_FIRST = re.compile(r"(?:ads?|adverts?|advertisements?|sponsor(?:ed|s)?|promos?|nav|navbar|navigation|menu|breadcrumbs?|sidebar\w*|footer\w*|masthead|comments?|commentlist|disqus|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscribe|signup|related|recommend(?:ed|ations?)?|share|sharing|social|widgets?|toolbar|pagination|pager)\d*", re.I)
_GOOD_NAME = re.compile(r"(?:article\w*|main|content|post|entry|story)\d*", re.I)
#: Parts of a name that tell of an element's shape or place, and beginnings of names that tell how a page is laid out.
_SHAPES = set("area bar block body bottom box button buttons card col column container first form global group head holder icon icons inner item items last left lg link links list md module outer panel primary right row secondary section sm strip text title top unit wrap wrapper".split())
_LAYOUT = {"has", "no", "with", "without", "is"}
_STATES = {"open", "closed", "enabled", "disabled", "on", "off", "count"}
_SPACE = re.compile(r"\s+")
_SCALE = 1000
#: The classifier's weights before any page is seen, by feature as ``features`` lists them; and the most a block's text may count.
WEIGHTS = (-1.6, 0.75, -4.0, 0.8, 0.4, 0.3, -0.5)
MOST = 3.0
#: What is hidden cannot be content.
_PLAIN = 1e6
#: Evidence of an element by its kind: a base, and how often it counts its own prose times the share of the page's prose that is elsewhere.
_AGAINST = {"tag": (6.0, 8.0), "strong": (2.5, 6.0), "weak": (2.5, 6.0), "doubt": (1.0, 0.0)}
#: Evidence for content: of a good name, of an article in a badly named element, and for each block of an article or main part with and without prose.
_GOOD_HINT, _INNER, _MAIN, _BARE = 3.0, 2.0, 3.5, 1.0
#: A block of this score is prose.
_PROSE = 0.5
#: Edges: above an element with evidence of its own, for each block below an element that follows such a one, below a hint, from containers and from
#: other elements where nothing is known, between next blocks.
_ABOVE, _FIRM, _HINTED, _CONTAINER, _LOOSE, _NEXT = 0.25, 3.5, 1.5, 1.0, 1.5, 1.0
#: The first weights, those of words, links and marks, are fitted; the tags of blocks follow a site's template too closely to learn them from it.
FITTED = 4
#: Pages that the classifier is fitted on at most, about, and how firmly it keeps to ``WEIGHTS``.
TRAIN_PAGES, FIRMNESS = 2_000, 300.0


@dataclass
class Block:
    text: str
    tag: str
    element: int
    linked: int


@dataclass(slots=True)
class Element:
    """``place``: 1 in a good element, -1 in a bad one, 2 and -2 where that is a hint, 0 elsewhere; ``kind``: its own evidence, if any."""

    tag: str
    outer: int
    kind: str
    place: int
    hidden: bool  # itself or an element around it
    under: bool  # an element around it, or itself, has a bad tag


def _name_cues(value: str, in_article: bool) -> tuple[bool, str, bool]:
    """Whether a class or id has a good name, the kind of a plain bad one, and whether it has a doubtful bad one."""
    good = doubtful = False
    plain = ""
    for token in value.lower().split():
        parts = re.split(r"[-_]+", token)
        if parts[0] in _LAYOUT or parts[-1] in _STATES:
            continue
        bad = [p for p in parts if _BAD_NAME.fullmatch(p) and not (p == "header" and in_article)]
        if not bad:
            good |= any(_GOOD_NAME.fullmatch(p) for p in parts)
            continue
        telling = [p for p in parts if p not in _SHAPES and not p.isdigit()]
        if parts[0] in ("content", "main") and bad == ["sidebar"]:
            doubtful = True  # a part with both
        elif not telling or telling[-1] in bad or _BAD_FIRST.fullmatch(parts[0]):
            weak = all(_WEAK_NAME.fullmatch(p) for p in bad) or telling and telling[-1] not in bad
            plain = plain if plain == "strong" else "weak" if weak else "strong"
        else:
            doubtful = True
    return good, plain, doubtful


def _element(tag: str, attrs: str, outer: int, of: Element | None) -> Element:
    place, hidden, under = (of.place, of.hidden, of.under) if of else (0, False, False)
    in_article = place == 1
    good = doubtful = False
    plain = ""
    main, gone = tag in _GOOD_TAGS, tag in _BAD_TAGS or tag == "header" and not in_article
    hidden |= tag == "head"
    for name, value in _ATTR.findall(attrs) if attrs else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            hidden = True
        elif name != "aria-hidden" and tag not in ("html", "body"):
            main |= name == "role" and value.lower() == "main" or name == "itemprop" and value.lower() == "articlebody"
            cues = _name_cues(value, in_article)
            good, doubtful = good | cues[0], doubtful | cues[2]
            plain = cues[1] if plain != "strong" and cues[1] else plain
    if hidden:
        return Element(tag, outer, "hidden", -1, True, True)
    if gone:
        return Element(tag, outer, "tag", -1, False, True)
    if under:  # nothing in there speaks for itself but what is bad on its own
        return Element(tag, outer, plain if plain and not good else "", -1, False, True)
    if plain and not good:
        return Element(tag, outer, plain, -1, False, False)
    if main and not (plain or doubtful):
        return Element(tag, outer, "inner" if place < 0 else "main", 1, False, False)
    if (doubtful or plain) and place not in (1, -1):
        return Element(tag, outer, "doubt", -2, False, False)
    if good and place not in (1, -1):
        return Element(tag, outer, "good", 2, False, False)
    return Element(tag, outer, "", place, False, False)


def blocks(page: str) -> tuple[list[Block], list[Element]]:
    """The text blocks of a page in order, and its block elements in the order of their start tags."""
    found: list[Block] = []
    elements: list[Element] = []
    stack: list[int] = []
    opened: Counter[str] = Counter()
    text: list[str] = []
    linked = depth = at = 0
    open_ended: set[str] = set()

    def flush() -> None:
        nonlocal linked
        joined = _SPACE.sub(" ", "".join(text)).strip()
        if joined:
            top = stack[-1] if stack else -1
            found.append(Block(joined, elements[top].tag if stack else "", top, min(linked, len(joined))))
        text.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            piece = html_entities.unescape(raw) if "&" in raw else raw
            text.append(piece)
            if depth:
                linked += len(piece)

    def close() -> str:
        tag = elements[stack.pop()].tag
        opened[tag] -= 1
        return tag

    end = len(page)
    while at < end:
        m = _TAG.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attrs = m[1] or m[4], m[3] or m[6] or ""
        if tag in _RAW:
            if not closing and not attrs.endswith("/") and tag not in open_ended:
                over = _RAW_END[tag].search(page, at)
                if over:
                    at = over.end()
                elif tag in _CODE:
                    at = end
                else:
                    open_ended.add(tag)
        elif tag == "a":
            depth = max(0, depth + (-1 if closing else 1))
        elif tag == "br":
            text.append(" ")
        elif tag in _BLOCKS:
            flush()
            if closing:
                while opened[tag] and close() != tag:
                    pass
                depth = 0
            elif tag not in _VOID:
                ends = _IMPLIED.get(tag, {"p"})
                while stack and elements[stack[-1]].tag in ends:
                    close()
                top = stack[-1] if stack else -1
                stack.append(len(elements))
                opened[tag] += 1
                elements.append(_element(tag, attrs, top, elements[top] if top >= 0 else None))
    flush()
    return found, elements


def features(b: Block) -> tuple[float, ...]:
    """What the classifier sees of a block: its words, links, last mark and kind."""
    n = b.text.count(" ") + 1
    density = b.linked / len(b.text)
    return (
        1.0,
        min(4.2, math.log1p(n)),
        density if n > 3 or density > 0.9 else 0.5 * density,
        float(b.text[-1] in ".!?\u2026\"\u201d\u00bb:"),
        float(b.tag in ("p", "pre", "blockquote")),
        4.0 if b.tag == "h1" else float(b.tag in ("h2", "h3", "h4", "h5", "h6")),  # the first kind is a page's title
        float(b.tag in ("li", "td", "th", "dt", "dd")),
    )


def score(b: Block, weights: tuple[float, ...] = WEIGHTS) -> float:
    """The classifier: log-odds that a block is content."""
    return max(-MOST, min(MOST, sum(w * x for w, x in zip(weights, features(b), strict=True))))


def min_cut(source: list[int], sink: list[int], edges: list[tuple[int, int, int]]) -> list[bool]:
    """Which nodes stay with the source in a minimum cut. Dinic's max-flow over integers; edges go both ways.

    The smallest source side is taken, so a node that could be on either side is boilerplate.
    """
    n = len(source)
    s, t = n, n + 1
    graph: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    cap: list[int] = []

    def join(u: int, v: int, c: int, back: int) -> None:
        graph[u].append(len(to))
        to.append(v)
        cap.append(c)
        graph[v].append(len(to))
        to.append(u)
        cap.append(back)

    for i in range(n):  # what flows straight through a node needs no search
        if (d := source[i] - sink[i]) > 0:
            join(s, i, d, 0)
        elif d < 0:
            join(i, t, -d, 0)
    for u, v, c in edges:
        join(u, v, c, c)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            u = queue.popleft()
            for e in graph[u]:
                if cap[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [level[i] >= 0 for i in range(n)]
        turn = [0] * (n + 2)
        path: list[int] = []
        u = s
        while True:
            if u == t:
                push = min(cap[e] for e in path)
                for e in path:
                    cap[e] -= push
                    cap[e ^ 1] += push
                k = next(k for k, e in enumerate(path) if cap[e] == 0)
                u = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[u] < len(graph[u]):
                e = graph[u][turn[u]]
                if cap[e] > 0 and level[to[e]] == level[u] + 1:
                    break
                turn[u] += 1
            else:
                if not path:
                    break
                turn[to[path[-1] ^ 1]] += 1
                u = to[path.pop() ^ 1]
                continue
            path.append(e)
            u = to[e]


def _forms(elements: list[Element]) -> None:
    """Makes forms to fill in bad elements: those with no article, main part, good name or heading of a page in them."""
    wide = [e.tag in ("article", "main", "h1") or e.kind in ("main", "inner", "good") for e in elements]
    for k in range(len(elements) - 1, -1, -1):
        if wide[k] and elements[k].outer >= 0:
            wide[elements[k].outer] = True
    inside = [False] * len(elements)
    for k, e in enumerate(elements):  # outer ones come first
        own = e.tag in ("form", "fieldset") and not wide[k]
        inside[k] = own or e.outer >= 0 and inside[e.outer]
        if inside[k] and e.place != -1:
            e.place, e.kind = -1, "tag" if own else ""


def _apart(elements: list[Element], a: int, b: int, most: int = 12) -> int:
    """Steps between two elements along the tree, ``most`` at most."""
    steps = 0
    while a != b and steps < most:  # an outer element comes before what it holds
        if a > b:
            a = elements[a].outer
        else:
            b = elements[b].outer
        steps += 1
    return steps


def evidence(found: list[Block], elements: list[Element], scores: list[float]) -> list[float]:
    """What each element's tag or name adds to its cost, above 0 for content; 0 for those without evidence of their own.

    A bad name counts against the prose in its element as much as the page has prose elsewhere: where an article is all there is, no name
    outweighs it, and beside an article a name outweighs any amount of comments. What may itself be an article in a weakly bad element counts as such
    prose for strongly bad ones, and not the other way.
    """
    region = []
    for k, e in enumerate(elements):  # outer ones come first
        region.append(k if e.kind else region[e.outer] if e.outer >= 0 else -1)
    prose, n, has = [0.0] * (len(elements) + 1), [0] * (len(elements) + 1), [False] * (len(elements) + 1)
    for b, score in zip(found, scores, strict=True):
        r = region[b.element] if b.element >= 0 else -1
        prose[r] += max(0.0, score)
        n[r] += 1
        has[r] |= score > _PROSE
    kind_of = lambda r: elements[r].kind if r >= 0 else ""
    rank = {"hidden": 3, "tag": 2, "strong": 2, "weak": 1}
    total = [0.0] * 4
    for r in range(-1, len(elements)):
        if r < 0 or region[r] == r:
            total[rank.get(kind_of(r), 0)] += prose[r]
    out = []
    for k, e in enumerate(elements):
        if e.kind == "hidden":
            out.append(-_PLAIN)
        elif e.kind in _AGAINST:
            base, times = _AGAINST[e.kind]
            elsewhere = sum(total[: rank.get(e.kind, 0)])
            out.append(-base - times * prose[k] * elsewhere / max(1e-9, prose[k] + elsewhere))
        else:
            out.append({"good": _GOOD_HINT, "inner": _INNER, "main": (_MAIN if has[k] else _BARE) * n[k]}.get(e.kind, 0.0))
    return out


def graph(found: list[Block], elements: list[Element], weights: tuple[float, ...] = WEIGHTS) -> tuple[list[int], list[float], dict[tuple[int, int], float]]:
    """Of each block its node, the nodes' costs (above 0: of being boilerplate), and the edges between nodes.

    Each block is a node, and so is each element with a block in it; all costs are finite but those of hidden elements.
    """
    scores = [score(b, weights) for b in found]
    own_cost = evidence(found, elements, scores)
    below = [0] * len(elements)
    for b in found:
        if b.element >= 0:
            below[b.element] += 1
    for k in range(len(elements) - 1, -1, -1):
        if elements[k].outer >= 0:
            below[elements[k].outer] += below[k]
    group: dict[int, int] = {}
    costs: list[float] = []
    edges: dict[tuple[int, int], float] = {}

    def join(a: int, b: int, weight: float) -> None:
        edges[min(a, b), max(a, b)] = edges.get((min(a, b), max(a, b)), 0.0) + weight

    def node(k: int) -> int:
        """The node of an element."""
        path = []
        while k >= 0 and k not in group:
            path.append(k)
            k = elements[k].outer
        above = group[k] if k >= 0 else -1
        for k in reversed(path):
            e = elements[k]
            around = elements[e.outer].place if e.outer >= 0 else 0
            group[k] = len(costs)
            costs.append(own_cost[k])
            if above >= 0:
                loose = _LOOSE if e.tag in ("p", "li", "td", "dd", "dt", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6") else _CONTAINER
                follows = abs(e.place) == 1 and e.place == around
                join(above, group[k], _PLAIN if e.hidden and elements[e.outer].hidden else _ABOVE if e.kind else _FIRM * below[k] if follows else _HINTED if abs(around) == 2 else loose)
            above = group[k]
        return above

    nodes: list[int] = []
    for i, b in enumerate(found):
        own = node(b.element)
        place = elements[b.element].place if b.element >= 0 else 0
        costs.append(scores[i])
        nodes.append(len(costs) - 1)
        if own >= 0:
            join(own, nodes[-1], _PLAIN if elements[b.element].hidden else _FIRM if abs(place) == 1 else _HINTED if abs(place) == 2 else _LOOSE)
        if i:
            join(nodes[-2], nodes[-1], _NEXT * math.exp(-_apart(elements, found[i - 1].element, b.element) / 2))
    return nodes, costs, edges


def label(found: list[Block], elements: list[Element], weights: tuple[float, ...] = WEIGHTS) -> list[bool]:
    """Which blocks are content."""
    nodes, costs, edges = graph(found, elements, weights)
    whole = [round(_SCALE * c) for c in costs]
    kept = min_cut([max(0, c) for c in whole], [max(0, -c) for c in whole], [(a, b, c) for (a, b), w in edges.items() if (c := round(_SCALE * w))])
    return [kept[n] for n in nodes]


def extract(page: str | None, weights: tuple[float, ...] = WEIGHTS) -> str:
    """The main text of a page: its content blocks in order, one a line; empty for a null or empty page."""
    found, elements = blocks(page) if page else ([], [])
    if not found:
        return ""
    _forms(elements)
    return "\n".join(b.text for b, keep in zip(found, label(found, elements, weights), strict=True) if keep)


def _plain_examples(page: str) -> list[tuple[float, ...]]:
    """Features of the blocks whose label their elements tell plainly, and that label."""
    found, elements = blocks(page)
    _forms(elements)
    return [(*features(b), float(elements[b.element].place > 0)) for b in found if b.element >= 0 and abs(elements[b.element].place) == 1]


def train(pages: DataFrame, train_pages: int = TRAIN_PAGES, firmness: float = FIRMNESS) -> tuple[float, ...]:
    """The classifier's weights, fitted on about ``train_pages`` pages at most, the same in each run (a hash picks them).

    Blocks in elements of a plain tag or name are the examples, each page counting as one. The weights are those of a
    logistic regression that is drawn to ``WEIGHTS``; without examples they are ``WEIGHTS``.
    """
    share = min(1.0, train_pages / max(1, pages.count()))
    chosen = pages.where(F.col("html").isNotNull()).where(F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20)) < F.lit(math.ceil(share * (1 << 20)))).select("html")
    width = len(WEIGHTS)

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, "html"):
                sums: dict[tuple[float, ...], float] = {}
                for page in piece.column("html"):
                    rows = _plain_examples(page.as_py())
                    for r in rows:
                        key = tuple(round(x, 1) for x in r)
                        sums[key] = sums.get(key, 0.0) + 1 / len(rows)
                yield pa.RecordBatch.from_arrays([pa.array(list(map(list, sums)), pa.list_(pa.float64())), pa.array(list(sums.values()), pa.float64())], names=["x", "n"])

    got = chosen.mapInArrow(run, "x array<double>, n double").groupBy("x").agg(F.sum("n").alias("n")).collect()  # features are rounded to tenths, so few rows
    if not got:
        return WEIGHTS
    got.sort(key=lambda r: r["x"])
    rows = np.array([r["x"] for r in got])
    x, y, n = rows[:, :FITTED], rows[:, width], np.array([r["n"] for r in got])
    fixed = rows[:, FITTED:width] @ np.array(WEIGHTS[FITTED:])
    prior = np.array(WEIGHTS[:FITTED])
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w + fixed, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + firmness * np.eye(FITTED), x.T @ (n * (y - p)) - firmness * (w - prior))
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return (*(round(float(v), 6) for v in w), *WEIGHTS[FITTED:])


def extract_pages(pages: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(page_id, url, html, ...) -> page_id, url, text, n_chars, a row for each row.

    A null or empty html gives an empty text. Ids and urls pass through, null or repeated as they are; other
    columns are not looked at; an empty table gives an empty result. A page is held whole, pages one at a time.
    ``weights`` are the classifier's, as ``train`` fits them.
    """

    def run(batches):
        for batch in batches:
            for piece in text_slices(batch, "html"):
                texts = [extract(x.as_py(), weights) for x in piece.column("html")]
                yield pa.RecordBatch.from_arrays([piece.column("page_id"), piece.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    kinds = dict(pages.dtypes)
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extract_pages(pages, train(pages))
