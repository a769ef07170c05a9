"""Repeated structures on a page: which elements are records, and what their columns are."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

from rowloom.html.read import clean, title
from rowloom.html.select import classes, select
from rowloom.html.tree import Node

#: Limits of the detector (fixed values).
MIN_RECORDS, MAX_CANDIDATES, MAX_FIELDS, MAX_SAMPLES, SHAPE, COVERAGE = 3, 6, 15, 3, 0.6, 0.5
NOISE = frozenset("script style noscript template svg path br hr".split())
JUNK_CLASS = re.compile(r"^(is|has|js|ng|v|active|open|show|hide|visible|hidden|selected|disabled|sr|clearfix)([-_]|$)|\d")
CHROME_TAGS, CHROME_ROLES, CHROME_CLASSES = ("nav", "footer"), ("navigation", "contentinfo"), ("pagination", "breadcrumb", "breadcrumbs")
LABELS = ("aria-label", "title", "alt")


def quiet(node: Node) -> list[Node]:
    """Children that are content."""
    return [c for c in node.elements() if c.tag not in NOISE]


def telling_class(node: Node) -> str | None:
    return next((c for c in classes(node) if not JUNK_CLASS.search(c)), None)


def _escaped(name: str) -> str:
    return re.sub(r"([^\w-])", r"\\\1", name)


def likeness(a: Counter, b: Counter) -> float:
    """Shared children of two bags over the larger bag; 1 for two empty ones."""
    most = max(a.total(), b.total())
    return 1.0 if most == 0 else (a & b).total() / most


def relative_selector(node: Node, record: Node) -> str:
    """A selector for node within record: up to the nearest telling class, else by place."""
    steps: list[str] = []
    while node is not record and node.parent is not None:
        name = telling_class(node)
        if name:
            return f".{_escaped(name)}" + (" " + " > ".join(steps) if steps else "")
        alike = [s for s in node.parent.elements() if s.tag == node.tag]
        place = next(i for i, s in enumerate(alike) if s is node) + 1
        steps.insert(0, node.tag if len(alike) == 1 else f"{node.tag}:nth-of-type({place})")
        node = node.parent
    return " > ".join(steps)


def record_selector(document: Node, record: Node) -> str:
    own = telling_class(record)
    if own and len(select(document, f".{_escaped(own)}")) >= MIN_RECORDS:
        return f".{_escaped(own)}"
    parent = telling_class(record.parent) if record.parent is not None else None
    return f".{_escaped(parent)} > {record.tag}" if parent else record.tag


def _above(node: Node, test) -> Node | None:
    """The nearest of a node and those above it that passes."""
    up: Node | None = node
    while up is not None and not test(up):
        up = up.parent
    return up


def is_header_row(node: Node) -> bool:
    kids = quiet(node)
    return bool(kids) and all(k.tag == "th" or k.attrs.get("role") == "columnheader" for k in kids)


def headers_of(record: Node) -> list[str]:
    """The column names that the page itself gives: a table's head, its first row with th, or an ARIA header row."""
    if record.tag == "tr" and (table := _above(record, lambda n: n.tag == "table")):
        head = select(table, "thead th, thead td")
        if not head:
            row = next((r for r in table.walk() if r.tag == "tr" and any(c.tag == "th" for c in r.elements())), None)
            head = [c for c in row.elements() if c.tag == "th"] if row else []
        if head:
            return [clean(c.text()) for c in head]
    grid = _above(record, lambda n: n.attrs.get("role") in ("table", "grid"))
    row = next((r for r in grid.elements() if is_header_row(r)), None) if grid else None
    return [clean(c.text()) for c in quiet(row)] if row else []


def is_chrome(node: Node) -> bool:
    return _above(node, lambda n: n.tag in CHROME_TAGS or n.attrs.get("role") in CHROME_ROLES or any(c in CHROME_CLASSES for c in classes(n))) is not None


def record_sets(document: Node) -> list[list[Node]]:
    """Siblings of one tag whose children resemble the shape that most of them agree with; header rows left out."""
    out = []
    for parent in document.walk():
        by_tag: dict[str, list[Node]] = {}
        for kid in quiet(parent):
            by_tag.setdefault(kid.tag, []).append(kid)
        for group in by_tag.values():
            if len(group) < MIN_RECORDS:
                continue
            bags = [tuple(sorted([k.tag for k in quiet(n)])) for n in group]
            weight = Counter(bags)  # equal bags agree with the same ones
            shapes = {s: Counter(s) for s in weight}
            agree = {s: sum(n for o, n in weight.items() if likeness(b, shapes[o]) >= SHAPE) for s, b in shapes.items()}
            model = shapes[max(agree, key=agree.__getitem__)]
            alike = {s for s, b in shapes.items() if likeness(b, model) >= SHAPE}
            rows = [n for n, b in zip(group, bags, strict=True) if b in alike and not is_header_row(n)]
            if len(rows) >= MIN_RECORDS:
                out.append(rows)
    return out


@dataclass
class Column:
    selector: str
    kind: str
    extra: dict
    order: int
    depth: int
    child: int
    hits: int = 0
    samples: list[str] = field(default_factory=list)
    wholes: list[str] = field(default_factory=list)
    name: str = ""


def _graphic(node: Node) -> list[tuple[str, str, dict]]:
    """What an element without text says: a label, a short data attribute, its class, or how many of its children are alike."""
    for name in LABELS:
        value = clean(node.attrs.get(name))
        if value and len(value) <= 120:
            return [("attr", value, {"attribute": name})]
    for name, raw in node.attrs.items():
        value = clean(raw)
        if name.startswith("data-") and value and len(value) <= 40:
            return [("attr", value, {"attribute": name})]
    kids, out = node.elements(), []
    if clean(node.attrs.get("class")) and kids:
        out.append(("attr", clean(node.attrs["class"]), {"attribute": "class"}))
    if len(kids) >= 2:
        leaves = [k for k in kids if k.tag not in NOISE and not k.elements()]
        kinds = Counter(".".join([k.tag, *(c for c in classes(k) if not JUNK_CLASS.search(c))]) for k in leaves)
        several = [(s.count("."), n, s) for s, n in kinds.items() if n >= 2]
        if several:
            _, n, best = max(several, key=lambda x: x[:2])
            out.append(("count", str(n), {"countSelector": best}))
    return out


def _readings(node: Node) -> list[tuple[str, str, dict]]:
    """(kind, value, extra) of one element inside a record."""
    whole, own = clean(node.text()), clean(" ".join(c for c in node.children if isinstance(c, str)))
    href, src, kids = node.attrs.get("href"), node.attrs.get("src"), quiet(node)
    if not href and not src and len(kids) == 1 and clean(kids[0].text()) == whole:
        return []  # a wrapper; its child will tell
    leaves = bool(node.elements()) and all(not c.elements() for c in node.elements())
    value = own or (whole if leaves else "")
    if not value and not href and not src:
        return _graphic(node)
    return [(k, v, {}) for k, v in (("text", value), ("href", href), ("src", src)) if v]


def _cell_place(selector: str) -> int:
    m = re.match(r"(?:td|th):nth-of-type\((\d+)\)\Z", re.split(r"[\s>+~]+", selector.strip())[0], re.I)
    return int(m[1]) if m else 0


def _given_name(column: Column, headers: list[str]) -> str:
    place = _cell_place(column.selector) or column.child + 1
    return headers[place - 1] if 0 < place <= len(headers) else ""


def _guessed_name(selector: str) -> str:
    last = [p for p in re.split(r"[\s>+~]+", selector) if p][-1:] or [""]
    named = re.search(r"\.([A-Za-z][\w-]*)", last[0])
    token = named[1] if named else re.sub("[^A-Za-z]", "", last[0])
    token = re.sub(r"^(s|p|c|js|is|ui|el)[-_]", "", token, flags=re.I)
    return re.sub("([a-z])([A-Z])", r"\1 \2", re.sub("[-_]+", " ", token)).strip().lower() or "field"


def columns_of(members: list[Node]) -> list[Column]:
    found: dict[tuple, Column] = {}
    for record in members:
        hit: set[tuple] = set()
        tops = quiet(record)
        for node in record.walk():
            if node is record or node.tag in NOISE:
                continue
            readings = _readings(node)
            selector = relative_selector(node, record) if readings else ""
            for kind, value, extra in readings:
                key = (selector, kind, *extra.values())
                if key not in found:
                    depth, up = 0, node
                    while up is not record and up is not None:
                        depth, up = depth + 1, up.parent
                    found[key] = Column(selector, kind, extra, len(found), depth, next((i for i, t in enumerate(tops) if t is node), -1))
                c = found[key]
                c.hits += key not in hit
                hit.add(key)
                c.samples.append(value)
                if kind == "text":
                    c.wholes.append(clean(node.text()))
    headers = headers_of(members[0])
    columns = [c for c in found.values() if c.hits >= COVERAGE * len(members)]
    columns = [c for c in columns if _given_name(c, headers) or len(c.samples) < min(len(members), MIN_RECORDS) or len(set(map(clean, c.samples))) > 1]
    texts = [c for c in columns if c.kind == "text"]
    inside = lambda c: any(o.depth < c.depth and c.samples[0] in o.wholes[0] for o in texts)
    columns = [c for c in columns if c.kind != "text" or not inside(c)]
    columns = sorted(sorted(columns, key=lambda c: (-c.hits, c.depth, c.order))[:MAX_FIELDS], key=lambda c: c.order)
    taken: Counter = Counter()
    for c in columns:
        base = _given_name(c, headers).lower() or _guessed_name(c.selector)
        suffix = {"href": "url", "src": "image"}.get(c.kind)
        name = base if not suffix or base.endswith(suffix) else f"{base} {suffix}"
        c.name, k = name, 2
        while taken[c.name]:
            c.name, k = f"{name} {k}", k + 1
        taken[c.name] += 1
    return columns


def detect(document: Node) -> dict:
    """Up to MAX_CANDIDATES sets of records, best first: selector, count, matched, fields, sample rows and score."""
    candidates = []
    for members in record_sets(document):
        if all(map(is_chrome, members)):
            continue
        columns = columns_of(members)
        bases = len({re.sub(r"\s*>\s*", " ", c.selector).strip() for c in columns})
        selector = record_selector(document, members[0])
        matched = len(select(document, selector))
        if bases < 2 or matched < MIN_RECORDS:
            continue
        fields = [{"name": c.name, "selector": c.selector, "kind": c.kind} | c.extra | {"coverage": int(100 * c.hits / len(members) + 0.5), "samples": c.samples[:MAX_SAMPLES]} for c in columns]
        rows = [{f["name"]: f["samples"][min(i, len(f["samples"]) - 1)] if i < len(f["samples"]) else f["samples"][0] for f in fields} for i in range(min(MAX_SAMPLES, len(members)))]
        candidates.append({"selector": selector, "count": len(members), "matched": matched, "fields": fields, "sampleRows": rows, "score": len(members) * max(1, bases)})
    best: dict[str, dict] = {}
    for c in sorted(candidates, key=lambda c: -c["score"]):
        best.setdefault(c["selector"], c)
    return {"title": title(document), "candidates": list(best.values())[:MAX_CANDIDATES]}
