"""HTML as a tree whose elements know their place in the source, and the main one of a page."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

_VOID = {"br", "img", "meta", "link", "input", "hr", "source", "wbr", "area", "base", "col", "embed", "track", "param"}


@dataclass
class Node:
    """An element with its place in the source."""

    tag: str
    attrs: dict[str, str]
    start: int
    inner: int
    outer: Node | None
    end: int = 0
    inner_end: int = 0
    parts: list = field(default_factory=list)

    @property
    def children(self) -> list[Node]:
        return [p for p in self.parts if isinstance(p, Node)]

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()

    def walk(self):
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def text(self) -> str:
        """The text, with a line for each break and table row."""
        out, todo = [], [self]
        while todo:
            p = todo.pop()
            if isinstance(p, str):
                out.append(p)
                continue
            out.append("\n" if p.tag in ("br", "tr", "div", "p") else "")
            todo.extend(reversed(p.parts))
        return "".join(out)


class Tree(HTMLParser):
    def __init__(self, source: str) -> None:
        super().__init__(convert_charrefs=True)
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.source, self.root = source, Node("", {}, 0, 0, None)
        self.at = self.root
        self.feed(source)
        self.close()
        while self.at is not None:
            self.at.inner_end = self.at.end = len(source)
            self.at = self.at.outer

    def _offset(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def handle_starttag(self, tag, attrs):
        start = self._offset()
        node = Node(tag, {k: v or "" for k, v in attrs}, start, start + len(self.get_starttag_text() or ""), self.at)
        self.at.parts.append(node)
        if tag in _VOID:
            node.end = node.inner_end = node.inner
        else:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self.at.end = self.at.inner_end = self.at.inner
            self.at = self.at.outer

    def handle_endtag(self, tag):
        node = self.at
        while node is not None and node.tag != tag:
            node = node.outer
        if node is None or node is self.root:
            return
        start = self._offset()
        end = self.source.find(">", start) + 1 or len(self.source)
        while self.at is not node:
            self.at.inner_end = self.at.end = start
            self.at = self.at.outer
        node.inner_end, node.end, self.at = start, end, node.outer

    def handle_data(self, data):
        self.at.parts.append(data)


_UNREAD = {"script", "style", "noscript", "template", "svg", "head", "title", "nav", "footer", "header", "aside", "form", "menu", "button", "select", "textarea", "iframe"}
_PARAGRAPHS = {"p", "pre", "td", "li", "blockquote", "section", "h2", "h3", "h4"}
_BLOCKS = _PARAGRAPHS | {"div", "article", "main", "ul", "ol", "table", "tr", "body", "h1", "h5", "h6", "dl", "figure"}
_BAD = re.compile(r"(?i)comment|sidebar|widget|related|share|social|promo|sponsor|advert|footer|menu|cookie|popup|subscribe|\bads?\b")
_GOOD = re.compile(r"(?i)article|content|entry|post|story|main|body|text")
#: Characters of the least paragraph that counts.
LEAST_PARAGRAPH = 25


#: Of the best element's value, what a sibling needs to be part of the same text, and the length of a paragraph that is.
SIBLING_SHARE, SIBLING_PARAGRAPH = 0.2, 80


def main_elements(source: str) -> list[Node]:
    """The elements that hold a page's main text, in order: the best one of ``main_element`` and those beside it that go on with it.

    A sibling goes on with it if its value is a share of the best one's, or if it is a paragraph of some length with few links. Of an
    element that has no text of its own, children of a bad name and lists or boxes of links stay out.
    """
    best, values = _valued(source)
    if best is None:
        return []
    least = SIBLING_SHARE * values[id(best)]
    goes_on = lambda n: values.get(id(n), 0.0) >= least or n.tag == "p" and len(read_text(n)) >= SIBLING_PARAGRAPH and _link_share(n) < 0.25
    beside = best.outer.children if best.outer is not None else [best]
    return [part for n in beside if n is best or n.tag not in _UNREAD and goes_on(n) for part in _good_parts(n)]


def _good_parts(node: Node) -> list[Node]:
    named = lambda n: f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"
    bad = lambda n: bool(_BAD.search(named(n))) or n.tag in ("ul", "ol", "dl", "table", "div", "section") and _link_share(n) > 0.5
    if any(isinstance(p, str) and p.strip() for p in node.parts) or not any(map(bad, node.children)):
        return [node]
    return [n for n in node.children if n.tag not in _UNREAD and not bad(n)]


def main_element(source: str) -> Node | None:
    """The best element of ``_valued``: the one that holds most of a page's prose."""
    return _valued(source)[0]


def _link_share(node: Node) -> float:
    """The share of an element's text that is in links."""
    all_, links = 0, 0
    for part in _read(node):
        size = sum(len(" ".join(p.split())) for p in part.parts if isinstance(p, str))
        all_ += size
        links += size if any(a.tag == "a" for a in _around(part, node)) else 0
    return links / max(1, all_)


def _valued(source: str) -> tuple[Node | None, dict[int, float]]:
    """The element that holds most of a page's prose: paragraphs count for the element around them and half for the next one.

    A paragraph counts by its length and commas; an element by its names and less the more of its text is links. None where
    there is no paragraph to speak of. With the values of all elements, by identity.
    """
    scores: dict[int, float] = {}
    nodes: dict[int, Node] = {}
    for node in _read(Tree(source).root):
        own = "".join(p if isinstance(p, str) else p.text() if p.tag not in _BLOCKS and p.tag not in _UNREAD else " " for p in node.parts)
        flat = " ".join(own.split())
        if node.tag not in _PARAGRAPHS | {"div", "article", "main"} or len(flat) < LEAST_PARAGRAPH:
            continue
        worth = 1 + flat.count(",") + min(3.0, len(flat) / 100)
        holder = node.outer if node.tag in _PARAGRAPHS and node.outer is not None and node.outer.tag else node
        for at, share in ((holder, 1.0), (holder.outer, 0.5)):
            if at is not None and at.tag not in ("", "html"):
                nodes[id(at)] = at
                scores[id(at)] = scores.get(id(at), 0.0) + share * worth
    best, values = None, {}
    for key, node in nodes.items():
        name = f"{node.attrs.get('class', '')} {node.attrs.get('id', '')}"
        bonus = 5.0 * (node.tag in ("article", "main") or bool(_GOOD.search(name))) - 8.0 * bool(_BAD.search(name))
        value = values[key] = (scores[key] + bonus) * (1 - _link_share(node))
        if value > 0 and (best is None or value > best[0]):
            best = (value, node)
    return best[1] if best else None, values


def _around(node: Node, top: Node):
    while True:
        yield node
        if node is top or node.outer is None:
            return
        node = node.outer


def _read(top: Node):
    """The elements from ``top`` on whose text is read."""
    todo = [top]
    while todo:
        node = todo.pop()
        if node is top or node.tag not in _UNREAD:
            yield node
            todo.extend(reversed(node.children))


def read_text(node: Node) -> str:
    """The text of an element without what is not read, white space joined, a space between blocks."""
    out: list[str] = []
    todo: list = [node]
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            out.append(p)
        elif p is node or p.tag not in _UNREAD:
            block = p.tag in _BLOCKS or p.tag == "br"
            out.append(" " if block else "")
            todo.extend([" "] if block else [])
            todo.extend(reversed(p.parts))
    return " ".join("".join(out).split())
