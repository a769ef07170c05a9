"""A forgiving HTML tree builder on the standard library alone.

It knows void elements, implied end tags, raw-text elements and unclosed formatting elements (which are opened again
in the next block), so that malformed pages give the tree a browser would show in all but rare corners.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes".split())
RCDATA = frozenset(("textarea", "title"))
FORMATTING = frozenset("a b big code em font i nobr s small strike strong tt u".split())
#: A start tag of a key closes an open element of its values.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "thead": {"tr", "td", "th", "tbody", "tfoot"},
    "tbody": {"tr", "td", "th", "thead", "tfoot"}, "tfoot": {"tr", "td", "th", "thead", "tbody"},
}
#: What such an implied end does not look beyond.
SCOPE = {
    "li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select", "datalist"}, "optgroup": {"select"},
    "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "thead": {"table"}, "tbody": {"table"}, "tfoot": {"table"},
}
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
P_SCOPE = frozenset("html body table td th caption button object template article section div main aside nav footer header form".split())
HEAD_ONLY = frozenset("base link meta title style script noscript template".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=/>\"'][^\s=/>]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")


class Node:
    """An element: tag, attrs, children (nodes and strings), parent."""

    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None, parent: Node | None = None):
        self.tag, self.attrs, self.children, self.parent = tag, attrs or {}, [], parent

    def add(self, tag: str, attrs: dict[str, str] | None = None) -> Node:
        node = Node(tag, attrs, self)
        self.children.append(node)
        return node

    def walk(self) -> Iterator[Node]:
        """This element and all below it, in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            if node.children:
                stack += [c for c in node.children[::-1] if isinstance(c, Node)]

    def elements(self) -> list[Node]:
        return [c for c in self.children if isinstance(c, Node)]

    def text(self) -> str:
        """All text below, as textContent gives it."""
        if len(self.children) == 1 and isinstance(self.children[0], str):
            return self.children[0]
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(reversed(node.children))
        return "".join(out)

    def own_text(self) -> str:
        return "".join(c for c in self.children if isinstance(c, str))

    def __repr__(self):
        return f"<{self.tag} {self.attrs}>"


def attributes(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _ATTR.finditer(source):
        name = m[1].lower()
        if name not in out:
            value = m[2] if m[2] is not None else m[3] if m[3] is not None else m[4] or ""
            out[name] = unescape(value) if "&" in value else value
    return out


class _Builder:
    def __init__(self):
        self.root = Node("#document")
        self.open = [self.root]
        self.again: list[Node] = []

    def pop_to(self, index: int) -> None:
        """Close open elements from index on; formatting elements among them, but for the first, will open again."""
        self.again.extend(n for n in self.open[index + 1 :] if n.tag in FORMATTING)
        del self.open[index:]

    def find(self, tags, scope) -> int:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                return k
            if self.open[k].tag in scope:
                return 0
        return 0

    def reopen(self) -> None:
        for n in self.again:
            self.open.append(self.open[-1].add(n.tag, dict(n.attrs)))
        self.again = []

    def text(self, data: str) -> None:
        if not data:
            return
        if self.again and not data.isspace():
            self.reopen()
        self.open[-1].children.append(data)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in ("html", "body"):
            k = self.find((tag,), ())
            if k:
                for name, value in attrs.items():
                    self.open[k].attrs.setdefault(name, value)
                return
        if tag == "body" or (tag not in HEAD_ONLY and tag not in ("html", "head")):
            k = self.find(("head",), ())
            if k:
                self.pop_to(k)
        if tag in CLOSES_P and (k := self.find(("p",), P_SCOPE)):
            self.pop_to(k)
        if tag in CLOSES:
            while k := self.find(CLOSES[tag], SCOPE[tag]):
                self.pop_to(k)
        if tag == "a" and (k := self.find(("a",), P_SCOPE)):
            self.pop_to(k)
        if self.again and tag not in CLOSES_P and tag not in CLOSES and tag not in HEAD_ONLY:
            self.reopen()
        node = self.open[-1].add(tag, attrs)
        if tag not in VOID:
            self.open.append(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].add("br")
            return
        if tag == "p" and not self.find(("p",), P_SCOPE):
            self.open[-1].add("p")
            return
        for k in range(len(self.again) - 1, -1, -1):
            if self.again[k].tag == tag:
                del self.again[k]
                return
        scope = () if tag not in FORMATTING and tag != "span" else P_SCOPE
        if k := self.find((tag,), scope):
            self.pop_to(k)


def parse(html: str | None) -> Node:
    """The document's root, a node with the tag #document; a null page is an empty one."""
    b = _Builder()
    html = html or ""
    at, size = 0, len(html)
    last = html.rfind(">")
    while at < size:
        m = _TOKEN.search(html, at) if at <= last or html.find("<!", at) >= 0 else None
        if m is None:
            b.text(unescape(html[at:]))
            break
        if m.start() > at:
            piece = html[at : m.start()]
            b.text(unescape(piece) if "&" in piece else piece)
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            b.end(tag)
            continue
        rest = m[3]
        b.start(tag, attributes(rest) if rest else {})
        if tag in RAW or tag in RCDATA:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            stop = close.start() if close else size
            if stop > at:
                b.open[-1].children.append(unescape(html[at:stop]) if tag in RCDATA else html[at:stop])
            b.open.pop()
            at = close.end() if close else size
    return b.root
