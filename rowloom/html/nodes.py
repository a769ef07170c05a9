"""Selectors over node arrays: one parse a page serves any number of selectors, and nothing is shuffled.

A page's elements are an array in document order (sources.pages.with_nodes). A selector becomes arrays of truth values
over it, one for each of its parts, built from left to right with higher-order functions: a part holds for an element if
its own tests do and the part before holds for its parent, for one of its ancestors (the path an element carries), or for
siblings before it. Subtrees are the intervals from pre to post, so the upward axes look at a slice of the array.

What needs the texts of whole subtrees, counts, or positions among filtered elements has no such form and is refused by
SelectorError; html.select reads those from the tree.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.html.select import _NTH, _PART, _XTOKEN, SelectorError, _closing, _split, _unescape, is_xpath

#: The type of an element in a node array. kids: its element children; path: its ancestors; nth and of: its number among its
#: siblings and theirs, and the same among those of its tag; inside: whether it stands in a template's tree.
NODE = (
    "struct<pre:int,post:int,parent:int,depth:int,tag:string,id:string,classes:array<string>,attrs:map<string,string>,own_text:string,texts:array<string>,"
    "path:array<int>,kids:array<int>,nth:int,of:int,nth_type:int,of_type:int,empty:boolean,inside:boolean>"
)

Flags = Column
Test = Callable[[Column], Column]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is evaluated once a row however often body names it."""
    return F.transform(F.array(value), body)[0]


def _each(nodes: Column, test: Test) -> Flags:
    return F.transform(nodes, lambda n: F.coalesce(test(n), F.lit(False)))


def _at(flags: Flags, i: Column) -> Column:
    return F.coalesce(F.get(flags, i), F.lit(False))


def _any(flags: Flags, numbers: Column) -> Column:
    return F.exists(numbers, lambda i: _at(flags, i))


def _below(flags: Flags, n: Column) -> Column:
    return F.exists(F.slice(flags, n["pre"] + 2, n["post"] - n["pre"]), lambda x: x)


def _siblings(nodes: Column, flags: Flags, n: Column, after: bool) -> Column:
    """Whether flags hold for a sibling before (or after) an element: of the root's children, those without a parent."""
    kids = F.coalesce(F.get(nodes, n["parent"])["kids"], F.transform(F.filter(nodes, lambda x: x["parent"].isNull()), lambda x: x["pre"]))
    return _any(flags, F.slice(kids, n["nth"] + 1, n["of"] - n["nth"]) if after else F.slice(kids, F.lit(1), n["nth"] - 1))


def _position(text: str) -> Callable[[Column], Column]:
    m = _NTH.match(text)
    if not m:
        raise SelectorError(f"not a position: {text}")
    if m[1] or m[2]:
        return lambda k: k % 2 == int(bool(m[1]))
    if m[6]:
        return lambda k: k == int(m[6])
    a = int(m[3] + "1") if m[3] in ("", "+", "-") else int(m[3])
    b = int(f"{m[4] or '+'}{m[5] or 0}")
    return (lambda k: k == b) if a == 0 else lambda k: ((k - b) % a == 0) & ((k - b) / a >= 0)


def _attribute(name: str, op: str | None, value: str, fold: bool) -> Test:
    def test(n: Column) -> Column:
        have = F.try_element_at(n["attrs"], F.lit(name))
        have, want = (F.lower(have), value.lower()) if fold else (have, value)
        if op is None:
            return have.isNotNull()
        if op == "=":
            return have == want
        if op == "~=":
            return F.array_contains(F.split(have, r"\s+"), want) if want else F.lit(False)
        if op == "|=":
            return (have == want) | F.startswith(have, F.lit(want + "-"))
        how = {"^=": F.startswith, "$=": F.endswith, "*=": F.contains}[op]
        return how(have, F.lit(want)) if want else F.lit(False)

    return test


_SIMPLE: dict[str, Test] = {
    "root": lambda n: n["parent"].isNull(), "empty": lambda n: n["empty"], "scope": lambda n: F.lit(False), "enabled": lambda n: ~F.map_contains_key(n["attrs"], "disabled"),
    "checked": lambda n: F.map_contains_key(n["attrs"], "checked") | F.map_contains_key(n["attrs"], "selected"), "disabled": lambda n: F.map_contains_key(n["attrs"], "disabled"),
    "first-child": lambda n: n["nth"] == 1, "last-child": lambda n: n["nth"] == n["of"], "only-child": lambda n: n["of"] == 1,
    "first-of-type": lambda n: n["nth_type"] == 1, "last-of-type": lambda n: n["nth_type"] == n["of_type"], "only-of-type": lambda n: n["of_type"] == 1,
}


class _Css:
    """A selector list as a function from a node array to truth values."""

    def __init__(self, text: str):
        self.parts = [self._complex(p.strip()) for p in _split(text)]

    def flags(self, nodes: Column) -> Flags:
        out = self.parts[0](nodes)
        for part in self.parts[1:]:
            out = F.zip_with(out, part(nodes), lambda a, b: a | b)
        return out

    def _complex(self, text: str) -> Callable[[Column], Flags]:
        compounds, combinators, tests, at = [], [], [], 0
        if not text:
            raise SelectorError("empty selector")
        while at < len(text):
            gap = re.compile(r"\s*([>+~])\s*|\s+").match(text, at)
            if gap and gap.end() > at:
                if not tests:
                    raise SelectorError(f"nothing before the combinator in {text}")
                compounds.append(tests)
                combinators.append(gap[1] or " ")
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
        compounds.append(tests)

        def run(nodes: Column) -> Flags:
            def onward(how: str, tests: list) -> Callable[[Column], Flags]:
                return lambda before: _all(nodes, tests, lambda n: _combined(nodes, before, n, how))

            flags = _all(nodes, compounds[0], None)
            for how, tests in zip(combinators, compounds[1:], strict=True):
                flags = _let(flags, onward(how, tests))
            return flags

        return run

    def _test(self, m: re.Match, text: str) -> tuple[str, object]:
        """("own", a test of an element) or ("inner", a selector that it must or must not match, or have below it)."""
        if m["tag"]:
            tag = _unescape(m["tag"]).lower()
            return "own", lambda n: F.lit(True) if tag == "*" else n["tag"] == tag
        if m["id"]:
            return "own", lambda n, wanted=_unescape(m["id"]): n["id"] == wanted
        if m["cls"]:
            return "own", lambda n, name=_unescape(m["cls"]): F.array_contains(n["classes"], name)
        if m["attr"]:
            value = next((m[g] for g in ("dq", "sq", "raw") if m[g] is not None), "")
            return "own", _attribute(m["attr"].lower(), m["op"], value, (m["flag"] or "").lower() == "i")
        name = m["pseudo"].lower()
        if name.startswith(":"):
            raise SelectorError(f"pseudo-elements select nothing: {text}")
        if not m["open"]:
            if name not in _SIMPLE:
                raise SelectorError(f"unknown pseudo-class :{name}")
            return "own", _SIMPLE[name]
        argument = text[m.end() : _closing(text, m.end() - 1)]
        if name in ("not", "is", "where"):
            return name, _Css(argument)
        if name == "has":
            if re.search(r"[\s>+~]", argument.strip().removeprefix(">").strip()):
                raise SelectorError(f":has({argument}) has more than one part")
            return "child" if argument.strip().startswith(">") else "has", _Css(argument.strip().removeprefix(">"))
        counted = {"nth-child": ("nth", "of", False), "nth-last-child": ("nth", "of", True), "nth-of-type": ("nth_type", "of_type", False), "nth-last-of-type": ("nth_type", "of_type", True)}
        if name not in counted:
            raise SelectorError(f"unknown pseudo-class :{name}()")
        (k, size, last), want = counted[name], _position(argument)
        return "own", lambda n: want(n[size] - n[k] + 1 if last else n[k])


def _all(nodes: Column, tests: list[tuple[str, object]], more: Test | None) -> Flags:
    """Truth values of all tests of a compound, and of one more."""
    own: list[Test] = [t for kind, t in tests if kind == "own"] + ([more] if more is not None else [])
    inner = [(kind, t) for kind, t in tests if kind != "own"]

    def build(left: list, tested: list[Test]) -> Flags:
        if not left:
            def test(n: Column) -> Column:
                out = F.lit(True)
                for t in tested:
                    out = out & F.coalesce(t(n), F.lit(False))
                return out

            return _each(nodes, test)
        (kind, sel), *rest = left

        def with_flags(flags: Flags) -> Flags:
            test = {
                "not": lambda n: ~_at(flags, n["pre"]), "is": lambda n: _at(flags, n["pre"]), "where": lambda n: _at(flags, n["pre"]),
                "has": lambda n: _below(flags, n), "child": lambda n: _any(flags, n["kids"]),
            }[kind]
            return build(rest, [*tested, test])

        return _let(sel.flags(nodes), with_flags)

    return build(inner, own)


def _combined(nodes: Column, before: Flags, n: Column, how: str) -> Column:
    if how == ">":
        return _at(before, n["parent"])
    if how == " ":
        return _any(before, n["path"])
    if how == "~":
        return _siblings(nodes, before, n, False)
    kids = F.coalesce(F.get(nodes, n["parent"])["kids"], F.transform(F.filter(nodes, lambda x: x["parent"].isNull()), lambda x: x["pre"]))
    return (n["nth"] > 1) & _at(before, F.get(kids, n["nth"] - 2))


class _XPath:
    """A path of axes with predicates as a function from a node array to truth values."""

    def __init__(self, text: str):
        self.tokens, at = [], 0
        while at < len(text):
            m = _XTOKEN.match(text, at)
            if not m:
                raise SelectorError(f"cannot read XPath {text[at:]!r}")
            self.tokens.append(next((kind, m[g]) for g, kind in ((1, "op"), (2, "str"), (3, "num"), (4, "name")) if m[g] is not None))
            at = m.end()
        self.at = 0
        self.paths = [self.path()]
        while self.next("|"):
            self.paths.append(self.path())
        if self.at < len(self.tokens):
            raise SelectorError(f"cannot read all of {text!r}")

    def peek(self, k: int = 0) -> tuple[str, str]:
        return self.tokens[self.at + k] if self.at + k < len(self.tokens) else ("end", "")

    def next(self, op: str) -> bool:
        found = self.peek() == ("op", op)
        self.at += found
        return found

    def need(self, op: str) -> None:
        if not self.next(op):
            raise SelectorError(f"expected {op}, got {self.peek()[1] or 'the end'}")

    def path(self) -> list[tuple[str, str, list[Test]]]:
        steps = []
        self.next(".")
        if not self.peek()[1].startswith("/"):
            raise SelectorError("a path begins at the document here")
        while self.peek() in (("op", "/"), ("op", "//")):
            deep = self.peek()[1] == "//"
            self.at += 1
            axis = "child"
            if self.peek()[0] == "name" and self.peek(1) == ("op", "::"):
                axis = self.peek()[1]
                self.at += 2
            kind, tag = self.peek()
            self.at += 1
            if (kind, tag) == ("op", ".."):
                axis, tag = "parent", "*"
            elif (kind, tag) == ("op", "."):
                axis, tag = "self", "*"
            elif kind != "name" and tag != "*":
                raise SelectorError(f"unexpected {tag!r} in an XPath")
            if deep and axis not in ("child", "self"):
                raise SelectorError(f"the axis {axis} after // is not supported")
            tag, tests = tag.lower(), []
            while self.next("["):
                tests.append(self.either(axis, tag, first=not tests))
                self.need("]")
            steps.append((("descendant" if axis == "child" else "descendant-or-self") if deep else axis, tag, tests))
        return steps

    def either(self, axis: str, tag: str, first: bool) -> Test:
        out = self.both(axis, tag, first)
        while self.peek() == ("name", "or"):
            self.at += 1
            left, right = out, self.both(axis, tag, first)
            out = lambda n, a=left, b=right: a(n) | b(n)
        return out

    def both(self, axis: str, tag: str, first: bool) -> Test:
        out = self.test(axis, tag, first)
        while self.peek() == ("name", "and"):
            self.at += 1
            left, right = out, self.test(axis, tag, first)
            out = lambda n, a=left, b=right: a(n) & b(n)
        return out

    def test(self, axis: str, tag: str, first: bool) -> Test:
        k, size = ("nth", "of") if tag == "*" else ("nth_type", "of_type")
        kind, got = self.peek()
        if kind == "num" or (kind, got) in (("name", "last"), ("name", "position")):
            if axis != "child" or not first:
                raise SelectorError("positions are counted among all children only")
            self.at += 1
            if kind == "num":
                return lambda n: n[k] == int(float(got)) if float(got).is_integer() else F.lit(False)
            self.need("(")
            self.need(")")
            if got == "last":
                return lambda n: n[k] == n[size]
            op = self.peek()[1]
            self.at += 1
            number = self.peek()
            if number[0] != "num" or op not in ("=", "<", ">", "<=", ">="):
                raise SelectorError("position() is compared with a number")
            self.at += 1
            want = float(number[1])
            return lambda n: {"=": n[k] == want, "<": n[k] < want, ">": n[k] > want, "<=": n[k] <= want, ">=": n[k] >= want}[op]
        if (kind, got) == ("name", "not"):
            self.at += 1
            self.need("(")
            inner = self.either(axis, tag, False)
            self.need(")")
            return lambda n: ~F.coalesce(inner(n), F.lit(False))
        if (kind, got) in (("name", "contains"), ("name", "starts-with")):
            self.at += 1
            self.need("(")
            values = self.values()
            self.need(",")
            want = self.literal()
            self.need(")")
            how = F.contains if got == "contains" else F.startswith
            # The text of a list of nodes is that of the first; an absent one is empty.
            return lambda n: how(F.coalesce(F.get(values(n), F.lit(0)), F.lit("")), F.lit(want))
        values = self.values()
        if self.peek()[1] in ("=", "!="):
            op = self.peek()[1]
            self.at += 1
            want = self.literal()
            return lambda n: F.exists(values(n), lambda v: (v == want) if op == "=" else (v != want))
        return lambda n: F.size(values(n)) > 0

    def values(self) -> Callable[[Column], Column]:
        """An attribute or the element's own texts, as an array."""
        if self.next("@"):
            name = self.peek()[1].lower()
            self.at += 1
            return lambda n: F.filter(F.array(F.try_element_at(n["attrs"], F.lit(name))), lambda v: v.isNotNull())
        if self.peek() == ("name", "text") and self.peek(1) == ("op", "("):
            self.at += 2
            self.need(")")
            return lambda n: n["texts"]
        raise SelectorError(f"{self.peek()[1]!r} needs the texts of whole elements")

    def literal(self) -> str:
        kind, got = self.peek()
        if kind != "str":
            raise SelectorError(f"expected a text, got {got or 'the end'}")
        self.at += 1
        return got[1:-1]

    def flags(self, nodes: Column) -> Flags:
        out = None
        for path in self.paths:
            flags = self._path(nodes, path)
            out = flags if out is None else F.zip_with(out, flags, lambda a, b: a | b)
        return out

    @staticmethod
    def _path(nodes: Column, steps: list) -> Flags:
        def own(step, reached: Test) -> Flags:
            _, tag, tests = step

            def test(n: Column) -> Column:
                out = reached(n) if tag == "*" else (n["tag"] == tag) & reached(n)
                for t in tests:
                    out = out & F.coalesce(t(n), F.lit(False))
                return out

            return _each(nodes, test)

        first = {"child": lambda n: n["parent"].isNull(), "descendant": lambda n: F.lit(True), "descendant-or-self": lambda n: F.lit(True)}
        if steps[0][0] not in first:
            raise SelectorError(f"the axis {steps[0][0]} does not lead on from the document")
        flags = own(steps[0], first[steps[0][0]])
        def onward(step: tuple) -> Callable[[Column], Flags]:
            def run(before: Flags) -> Flags:
                reach: dict[str, Test] = {
                    "child": lambda n: _at(before, n["parent"]), "descendant": lambda n: _any(before, n["path"]), "self": lambda n: _at(before, n["pre"]), "parent": lambda n: _any(before, n["kids"]),
                    "descendant-or-self": lambda n: _at(before, n["pre"]) | _any(before, n["path"]), "ancestor": lambda n: _below(before, n), "ancestor-or-self": lambda n: _at(before, n["pre"]) | _below(before, n),
                    "following-sibling": lambda n: _siblings(nodes, before, n, False), "preceding-sibling": lambda n: _siblings(nodes, before, n, True),
                }
                if step[0] not in reach:
                    raise SelectorError(f"unknown axis {step[0]}")
                return own(step, reach[step[0]])

            return run

        for step in steps[1:]:
            flags = _let(flags, onward(step))
        return flags


def matches(nodes: Column, selector: str) -> Column:
    """The elements of a node array that a selector finds, in document order, as html.select finds them in the whole page:
    those in no template's tree, or, where there are none, all."""
    text = selector.strip()
    reader = _XPath(re.sub(r"^\s*xpath=", "", text).strip()) if is_xpath(text) else _Css(text)
    found = F.filter(F.zip_with(nodes, reader.flags(nodes), lambda n, f: F.struct(n.alias("n"), f.alias("f"))), lambda x: x["f"])
    every = F.transform(found, lambda x: x["n"])
    if is_xpath(text):
        return every
    light = lambda ns: F.filter(ns, lambda n: ~n["inside"])
    return _let(every, lambda ns: F.when(F.size(light(ns)) > 0, light(ns)).otherwise(ns))
