"""CSS selectors and an XPath subset over parsed pages."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from rowloom.html.tree import Node

Test = Callable[[Node, Node], bool]


class SelectorError(ValueError):
    """The selector cannot be read."""


_NAME = r"(?:\\.|[\w-]|[^\x00-\x7f])+"
_PART = re.compile(
    rf"(?P<tag>\*|{_NAME})|#(?P<id>{_NAME})|\.(?P<cls>{_NAME})|:(?P<pseudo>:?[a-zA-Z-]+)(?P<open>\()?"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<raw>[^\s\]]+))\s*(?P<flag>[iIsS])?\s*)?\]"
)
_NTH = re.compile(r"\s*(?:(odd)|(even)|([+-]?\d*)n\s*(?:([+-])\s*(\d+))?|([+-]?\d+))\s*\Z", re.I)


def classes(node: Node) -> list[str]:
    return node.attrs.get("class", "").split()


def _unescape(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _nth(text: str) -> Callable[[int], bool]:
    m = _NTH.match(text)
    if not m:
        raise SelectorError(f"not a position: {text}")
    if m[1] or m[2]:
        return lambda k: k % 2 == bool(m[1])
    if m[6]:
        n = int(m[6])
        return lambda k: k == n
    a = int(m[3] + "1") if m[3] in ("", "+", "-") else int(m[3])
    b = int(f"{m[4] or '+'}{m[5] or 0}")
    return lambda k: k == b if a == 0 else (k - b) % a == 0 and (k - b) // a >= 0


def _siblings(node: Node, same_tag: bool) -> list[Node]:
    around = node.parent.elements() if node.parent else [node]
    return [n for n in around if n.tag == node.tag] if same_tag else around


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    want = value.lower() if fold else value

    def test(node: Node, _: Node) -> bool:
        have = node.attrs.get(name)
        if have is None or op is None:
            return have is not None
        have = have.lower() if fold else have
        if op == "=":
            return have == want
        if op == "~=":
            return want in have.split()
        if op == "|=":
            return have == want or have.startswith(want + "-")
        return bool(want) and (have.startswith(want) if op == "^=" else have.endswith(want) if op == "$=" else want in have)

    return test


def _pseudo(name: str, argument: str | None) -> Test:
    simple: dict[str, Test] = {
        "scope": lambda n, s: n is s, "root": lambda n, s: n.parent is not None and n.parent.tag == "#document",
        "empty": lambda n, s: not any(isinstance(c, Node) or c for c in n.children),
        "checked": lambda n, s: "checked" in n.attrs or "selected" in n.attrs, "disabled": lambda n, s: "disabled" in n.attrs, "enabled": lambda n, s: "disabled" not in n.attrs,
        "first-child": lambda n, s: _siblings(n, False)[0] is n, "last-child": lambda n, s: _siblings(n, False)[-1] is n, "only-child": lambda n, s: len(_siblings(n, False)) == 1,
        "first-of-type": lambda n, s: _siblings(n, True)[0] is n, "last-of-type": lambda n, s: _siblings(n, True)[-1] is n, "only-of-type": lambda n, s: len(_siblings(n, True)) == 1,
    }
    if argument is None:
        if name not in simple:
            raise SelectorError(f"unknown pseudo-class :{name}")
        return simple[name]
    if name in ("not", "is", "where"):
        inner = compile_css(argument)
        return (lambda n, s: not inner.matches(n, s)) if name == "not" else inner.matches
    if name == "has":
        parts = [p.strip() for p in _split(argument)]
        relative = [compile_css(":scope " + p) for p in parts]
        deep = [not re.match(r"[>+~]", p) or p.startswith(">") for p in parts]

        def has(n: Node, _: Node) -> bool:
            for sel, below in zip(relative, deep, strict=True):
                pool = n.walk() if below else (x for x in _siblings(n, False))
                if any(x is not n and sel.matches(x, n) for x in pool):
                    return True
            return False

        return has
    if name in ("nth-child", "nth-last-child", "nth-of-type", "nth-last-of-type"):
        want, typed, last = _nth(argument), name.endswith("type"), "last" in name

        def nth(n: Node, _: Node) -> bool:
            around = _siblings(n, typed)
            k = next(i for i, x in enumerate(around) if x is n)
            return want(len(around) - k if last else k + 1)

        return nth
    raise SelectorError(f"unknown pseudo-class :{name}()")


def _split(text: str) -> list[str]:
    """Parts between top-level commas."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(text):
        if quote:
            quote = "" if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif c == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    if depth or quote:
        raise SelectorError(f"unbalanced selector: {text}")
    return [*out, text[start:]]


def _closing(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    raise SelectorError(f"unbalanced selector: {text}")


class Complex:
    """Compound tests from left to right with the combinators between them."""

    def __init__(self, text: str):
        self.compounds: list[list[Test]] = []
        self.combinators: list[str] = []
        at, tests = 0, []
        text = text.strip()
        if not text:
            raise SelectorError("empty selector")
        while at < len(text):
            gap = re.compile(r"\s*([>+~])\s*|\s+").match(text, at)
            if gap and gap.end() > at:
                if not tests:
                    raise SelectorError(f"nothing before the combinator in {text}")
                self.compounds.append(tests)
                self.combinators.append(gap[1] or " ")
                tests, at = [], gap.end()
                continue
            m = _PART.match(text, at)
            if not m or (m["tag"] and tests):
                raise SelectorError(f"cannot read {text[at:]!r}")
            at = m.end()
            tests.append(self._test(m, text))
            if m["open"]:
                at = _closing(text, m.end() - 1) + 1
        if not tests:
            raise SelectorError(f"nothing after the combinator in {text}")
        self.compounds.append(tests)

    @staticmethod
    def _test(m: re.Match, text: str) -> Test:
        if m["tag"]:
            tag = _unescape(m["tag"]).lower()
            return (lambda n, s: True) if tag == "*" else (lambda n, s: n.tag == tag)
        if m["id"]:
            wanted = _unescape(m["id"])
            return lambda n, s: n.attrs.get("id") == wanted
        if m["cls"]:
            name = _unescape(m["cls"])
            return lambda n, s: "class" in n.attrs and name in classes(n)
        if m["attr"]:
            value = next((m[g] for g in ("dq", "sq", "raw") if m[g] is not None), "")
            return _attribute(m["attr"].lower(), m["op"], value, (m["flag"] or "").lower() == "i")
        if m["pseudo"].startswith(":"):
            raise SelectorError(f"pseudo-elements select nothing: {text}")
        return _pseudo(m["pseudo"].lower(), text[m.end() : _closing(text, m.end() - 1)] if m["open"] else None)

    def matches(self, node: Node, scope: Node, k: int = -1) -> bool:
        k = len(self.compounds) - 1 if k < 0 else k
        if node.tag == "#document":
            return False
        for test in self.compounds[k]:
            if not test(node, scope):
                return False
        if k == 0:
            return True
        how = self.combinators[k - 1]
        if how == ">":
            return node.parent is not None and self.matches(node.parent, scope, k - 1)
        if how == " ":
            up = node.parent
            while up is not None:
                if self.matches(up, scope, k - 1):
                    return True
                up = up.parent
            return False
        around = _siblings(node, False)
        at = next(i for i, x in enumerate(around) if x is node)
        before = around[at - 1 : at] if how == "+" and at else around[:at] if how == "~" else []
        return any(self.matches(x, scope, k - 1) for x in before)


class SelectorList:
    def __init__(self, text: str):
        self.parts = [Complex(p) for p in _split(text)]

    def matches(self, node: Node, scope: Node) -> bool:
        for part in self.parts:
            if part.matches(node, scope):
                return True
        return False


@lru_cache(maxsize=1024)
def compile_css(text: str) -> SelectorList:
    return SelectorList(text)


# ---- XPath ----------------------------------------------------------------------------------------------------------

_XTOKEN = re.compile(r"\s*(?:(//|/|\.\.|\.|\[|\]|\(|\)|@|\||::|!=|<=|>=|=|<|>|,|\*)|(\"[^\"]*\"|'[^']*')|(\d+(?:\.\d+)?)|([A-Za-z_][\w.-]*))")


class _XPath:
    """A recursive-descent reader that compiles a path to a function from a node to nodes."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        text = text.strip()
        while at < len(text):
            m = _XTOKEN.match(text, at)
            if not m:
                raise SelectorError(f"cannot read XPath {text[at:]!r}")
            self.tokens.append(next((kind, m[g]) for g, kind in ((1, "op"), (2, "str"), (3, "num"), (4, "name")) if m[g] is not None))
            at = m.end()
        self.at = 0

    def peek(self, k: int = 0):
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None):
        kind, got = self.peek()
        if value is not None and got != value:
            raise SelectorError(f"expected {value}, got {got or 'the end'}")
        self.at += 1
        return kind, got

    def union(self):
        paths = [self.path()]
        while self.peek()[1] == "|" and self.peek()[0] == "op":
            self.take()
            paths.append(self.path())
        return lambda n: list({id(x): x for p in paths for x in p(n)}.values())

    def path(self):
        steps = []
        if self.peek() == ("op", "("):
            self.take()
            inner = self.union()
            self.take(")")
            tests = self.predicates()
            steps.append(lambda ns, inner=inner, tests=tests: self.filtered([x for n in ns for x in inner(n)], tests))
        elif self.peek()[1] in ("/", "//"):
            steps.append(lambda ns: [_top(n) for n in ns])
        elif self.peek()[1] == "." and self.peek(1)[1] in ("/", "//"):
            self.take()
        else:
            steps.append(self.step())
        while self.peek() in (("op", "/"), ("op", "//")):
            deep = self.take()[1] == "//"
            if deep:
                steps.append(lambda ns: list({id(x): x for n in ns for x in n.walk()}.values()))
            steps.append(self.step())

        def run(node: Node) -> list[Node]:
            found = [node]
            for s in steps:
                found = s(found)
            return found

        return run

    @staticmethod
    def filtered(nodes: list[Node], tests) -> list[Node]:
        for t in tests:
            size = len(nodes)
            nodes = [n for i, n in enumerate(nodes) if t(n, i + 1, size)]
        return nodes

    def predicates(self):
        out = []
        while self.peek() == ("op", "["):
            self.take()
            value = self.either()
            self.take("]")
            out.append(lambda n, i, size, value=value: i == v if isinstance(v := value(n, i, size), float) else bool(v))
        return out

    def step(self):
        kind, got = self.take()
        axis = "child"
        if self.peek() == ("op", "::"):
            axis = got
            self.take()
            kind, got = self.take()
        if (kind, got) == ("op", "."):
            axis, got = "self", "*"
        elif (kind, got) == ("op", ".."):
            axis, got = "parent", "*"
        elif kind != "name" and got != "*":
            raise SelectorError(f"unexpected {got!r} in an XPath")
        if self.peek() == ("op", "(") and got in ("node",):
            self.take("(")
            self.take(")")
            got = "*"
        axes = {
            "child": lambda n: n.elements(), "self": lambda n: [n], "parent": lambda n: [n.parent] if n.parent else [], "descendant": lambda n: [x for x in n.walk() if x is not n], "descendant-or-self": lambda n: list(n.walk()),
            "ancestor": _ancestors, "ancestor-or-self": lambda n: [n, *_ancestors(n)], "following-sibling": lambda n: _around(n, True), "preceding-sibling": lambda n: _around(n, False),
        }
        if axis not in axes:
            raise SelectorError(f"unknown axis {axis}")
        tests, tag, walk = self.predicates(), got.lower(), axes[axis]

        def run(nodes: list[Node]) -> list[Node]:
            out: dict[int, Node] = {}
            for n in nodes:
                for x in self.filtered([x for x in walk(n) if (tag == "*" and (x.tag != "#document" or axis in ("self", "parent"))) or x.tag == tag], tests):
                    out[id(x)] = x
            return list(out.values())

        return run

    def either(self):
        parts = [self.both()]
        while self.peek() == ("name", "or"):
            self.take()
            parts.append(self.both())
        return parts[0] if len(parts) == 1 else lambda *a: any(p(*a) for p in parts)

    def both(self):
        parts = [self.comparison()]
        while self.peek() == ("name", "and"):
            self.take()
            parts.append(self.comparison())
        return parts[0] if len(parts) == 1 else lambda *a: all(p(*a) for p in parts)

    def comparison(self):
        left = self.value()
        op = self.peek()[1]
        if op not in ("=", "!=", "<", ">", "<=", ">="):
            return left
        self.take()
        right = self.value()

        def compare(*a):
            x, y = left(*a), right(*a)
            xs, ys = (v if isinstance(v, list) else [v] for v in (x, y))
            return any(_compare(p, q, op) for p in xs for q in ys)

        return compare

    def value(self):
        kind, got = self.peek()
        if kind == "str":
            self.take()
            return lambda *_: got[1:-1]
        if kind == "num":
            self.take()
            return lambda *_: float(got)
        if (kind, got) == ("op", "@"):
            self.take()
            name = self.take()[1]
            return lambda n, *_: [n.attrs[name.lower()]] if name.lower() in n.attrs else []
        if kind == "name" and self.peek(1) == ("op", "("):
            self.take()
            self.take("(")
            args = []
            while self.peek() != ("op", ")"):
                args.append(self.either())
                if self.peek() == ("op", ","):
                    self.take()
            self.take(")")
            return _function(got, args)
        if (kind, got) == ("op", ".") and self.peek(1)[1] not in ("/", "//"):
            self.take()
            return lambda n, *_: n.text()
        path = self.union()
        return lambda n, *_: [x.text() for x in path(n)]


def _top(node: Node) -> Node:
    while node.parent is not None:
        node = node.parent
    return node


def _ancestors(node: Node) -> list[Node]:
    out = []
    while (node := node.parent) is not None and node.tag != "#document":
        out.append(node)
    return out


def _around(node: Node, after: bool) -> list[Node]:
    around = _siblings(node, False)
    k = next(i for i, x in enumerate(around) if x is node)
    return around[k + 1 :] if after else around[:k][::-1]


def _string(v) -> str:
    v = (v[0] if v else "") if isinstance(v, list) else v
    return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)


def _compare(x, y, op: str) -> bool:
    if isinstance(x, float) or isinstance(y, float) or op not in ("=", "!="):
        try:
            x, y = float(x), float(y)
        except (TypeError, ValueError):
            return op == "!="
    return {"=": x == y, "!=": x != y, "<": x < y, ">": x > y, "<=": x <= y, ">=": x >= y}[op] if not isinstance(x, str) or op in ("=", "!=") else False


def _function(name: str, args):
    s = lambda k, a: _string(args[k](*a)) if k < len(args) else a[0].text()
    table = {
        "contains": lambda *a: s(1, a) in s(0, a), "starts-with": lambda *a: s(0, a).startswith(s(1, a)), "not": lambda *a: not args[0](*a), "position": lambda n, i, size: float(i), "last": lambda n, i, size: float(size),
        "text": lambda n, *_: [c for c in n.children if isinstance(c, str)], "normalize-space": lambda *a: " ".join(s(0, a).split()), "string": lambda *a: s(0, a), "string-length": lambda *a: float(len(s(0, a))),
        "count": lambda *a: float(len(args[0](*a))), "concat": lambda *a: "".join(_string(x(*a)) for x in args), "name": lambda n, *_: n.tag, "local-name": lambda n, *_: n.tag, "true": lambda *_: True, "false": lambda *_: False,
        "translate": lambda *a: s(0, a).translate({ord(c): (s(2, a)[k] if k < len(s(2, a)) else None) for k, c in reversed(list(enumerate(s(1, a))))}),
    }
    if name not in table:
        raise SelectorError(f"unknown XPath function {name}()")
    return table[name]


@lru_cache(maxsize=512)
def compile_xpath(text: str):
    reader = _XPath(text)
    found = reader.union()
    if reader.at < len(reader.tokens):
        raise SelectorError(f"cannot read all of {text!r}")
    return found


# ---- selecting ------------------------------------------------------------------------------------------------------

PIERCE = ">>>"


def is_xpath(selector: str) -> bool:
    return re.match(r"\s*(xpath=|//|\(//|\.//)", selector) is not None


def _shadow(node: Node) -> Node | None:
    return next((c for c in node.elements() if c.tag == "template" and c.attrs.get("shadowrootmode")), None)


def select(root: Node, selector: str) -> list[Node]:
    """Elements below root in document order; an unreadable selector finds nothing, as on a page.

    Declarative shadow roots are searched after `>>>`, and where the light tree has no match.
    """
    try:
        if is_xpath(selector):
            found = {id(n) for n in compile_xpath(re.sub(r"^\s*xpath=", "", selector).strip())(root)}
            return [n for n in _top(root).walk() if id(n) in found and n.tag != "#document"]
        if PIERCE in selector:
            scopes = [root]
            parts = [p.strip() for p in selector.split(PIERCE)]
            for i, part in enumerate(parts):
                css = compile_css(part)
                hits = list({id(n): n for s in scopes for n in s.walk() if n is not s and css.matches(n, s) and _light(n, s)}.values())
                scopes = hits if i == len(parts) - 1 else [x for n in hits if (x := _shadow(n)) is not None]
            return scopes
        css = compile_css(selector)
    except SelectorError:
        return []
    found = [n for n in root.walk() if n is not root and css.matches(n, root)]
    return [n for n in found if _light(n, root)] or found


def _light(node: Node, root: Node) -> bool:
    """Whether no shadow root lies between a node and the root searched."""
    up = node.parent
    while up is not None and up is not root:
        if up.tag == "template":
            return False
        up = up.parent
    return True


def scoped(document: Node, selector: object, record: Node | None = None) -> list[Node]:
    """A selector within a loop's record, and in the document where the record has no match (unless it starts with :scope)."""
    text = "" if selector is None or isinstance(selector, dict | list) else str(selector).strip()
    if re.fullmatch(r"\d+", text):
        text = f":scope > *:nth-child({int(text)})"
    if record is None:
        return select(document, text) if text else []
    if not text:
        return [record]
    found = select(record, text)
    return found if found or text.startswith(":scope") else select(document, text)
