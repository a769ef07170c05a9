"""Main text of HTML pages by minimum-cut labelling.

A page's text blocks are nodes of a graph. A logistic classifier on each block's ancestry, words and links gives the
cost of calling it content and that of calling it boilerplate; these are its capacities to the two terminals. Edges
between neighbouring blocks, the stronger the nearer they are in the tree, and between blocks of one parent, cost
something to cut, so lone misfits follow their surroundings: a short line of an article its paragraphs, a long notice
its page's furniture. Maximum flow finds the labelling of least total cost; blocks on the content side are the text.

The classifier is trained on labelled layouts (layouts.py): TRAINED_ON pages, a bounded sample made from seeds, by
logistic regression with PRIOR as the mean of a Gaussian prior. Names of furniture (tags, roles, words of classes and
ids) are evidence like length, links and punctuation, and weigh what the layouts show them to be worth. Ids of
headings and sections within articles name their subject and say nothing.

Scripts, styles, form controls and other things that are not text never become blocks, nor does what no reader sees (the
attribute hidden, or display:none); aria-hidden hides nothing from the eye, and such text stays. Character references are
decoded; white space within a block becomes one space; blocks are joined in page order by blank lines.

Edge cases: a null, empty or text-free page gives the empty text; a page without any content block, too; broken
markup is repaired as browsers do; pages of any length are read whole; repeated rows give equal results; an empty table
gives an empty one; columns named like the results are replaced.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowloom.html.tree import Node, parse
from rowloom.llm._arrow import col, map_arrow, one_pass, without
from rowloom.llm.layouts import layout

#: Never text, whatever the surroundings.
SKIPPED = frozenset("script style noscript template svg iframe object embed canvas audio video select option datalist button input textarea head title link meta form dialog map progress meter annotation annotation-xml".split())
#: Boilerplate by tag, by role, or by a word of the class or id.
FURNITURE_TAGS = frozenset("nav footer aside menu".split())
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
FURNITURE_WORDS = frozenset(
    "ad adbox adcontainer ads adsbygoogle adsense adslot adunit advert advertisement advertising adverts affiliate alert announcement banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification outbrain overlay pager pagination popup privacy promo promos promoted promotion recommended related replies reply respond share sharing sidebar sidebars signup skiplink social sponsor sponsored subscribe subscription taboola teaser toast toolbar topbar widget widgets".split()
)
CONTENT_WORDS = frozenset("article body content entry main post prose story text".split())
#: Elements whose own class may well name parts that they contain; for an article within an article, a comment as a rule, it does not.
FRAMES = frozenset("html body main article".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math maction menclose merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split()
)

#: What the classifier looks at, and its weights before training.
FEATURES = ("bias", "furniture_tag", "furniture_word", "word_in_article", "in_article", "content_class", "linked", "linked_in_article", "length", "paragraph", "heading", "item")
PRIOR = (-1.5, -9.0, -8.0, -7.0, 1.5, 1.5, -4.0, 3.0, 3.0, 1.0, -0.5, -1.0)
#: Training pages, and the precision of the prior.
TRAINED_ON, PRECISION = 300, 200.0

#: Cost of cutting between neighbours one step of the tree apart; its part across a boundary of furniture; the cost for
#: blocks of one parent with others between; and the number of steps up the tree after which blocks count as far apart.
TIE, ACROSS, SAME_PARENT, CLIMB = 3.0, 0.25, 0.5, 8

_WORD = re.compile(r"[a-z]+")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


class Block:
    __slots__ = ("text", "linked", "furniture", "worded", "named", "article", "content", "holder", "tag")


#: How deep in content an element is.
OUTSIDE, IN_MAIN, WITHIN = 0, 1, 2


def _furniture(node: Node, place: int) -> bool:
    return node.tag in FURNITURE_TAGS or (node.tag == "header" and not place) or (bool(node.attrs) and node.tag not in FRAMES and node.attrs.get("role", "").lower() in FURNITURE_ROLES)


def _named(node: Node, place: int) -> bool:
    attrs = node.attrs
    if not attrs or (node.tag in FRAMES and not (node.tag == "article" and place == WITHIN)):
        return False
    names = attrs.get("class", "")
    if not place or not (node.tag == "section" or node.tag in _HEADINGS):
        names += " " + attrs.get("id", "")
    return bool(names.strip()) and any(w in FURNITURE_WORDS and not (place and w == "header") for w in _WORD.findall(names.lower()))


def _hidden(attrs: dict[str, str]) -> bool:
    return bool(attrs) and ("hidden" in attrs or "display:none" in attrs.get("style", "").replace(" ", "").lower())


def blocks(root: Node) -> list[Block]:
    """The page's text blocks in order, with what the classifier looks at."""
    out: list[Block] = []
    text: list[str] = []
    linked = [0]

    def close(node: Node, furniture: bool, worded: bool, named: bool, place: int, content: bool) -> None:
        joined = " ".join("".join(text).split())
        text.clear()
        if joined:
            b = Block()
            b.text, b.linked, b.furniture, b.worded, b.named, b.article, b.content, b.holder, b.tag = joined, min(1.0, linked[0] / len(joined)), furniture, worded, named, place > OUTSIDE, content, node, node.tag
            out.append(b)
        linked[0] = 0

    # Entries: a node to enter, a string to take, or None to leave the block element that follows it.
    stack: list = [(root, root, False, False, False, OUTSIDE, False, False)]
    while stack:
        item, holder, furniture, worded, named, place, content, link = stack.pop()
        if item is None:
            close(holder, furniture, worded, named, place, content)
        elif isinstance(item, str):
            text.append(item)
            if link:
                linked[0] += len(item.strip())
        elif item.tag == "br":
            text.append(" ")
        elif item.tag not in SKIPPED and not _hidden(item.attrs):
            own, word = _furniture(item, place), _named(item, place)
            loose = not place and item.parent is not None and item.parent.tag in ("body", "div", "section") and (own or word)
            inline = item.tag in INLINE and not loose
            below_place = WITHIN if item.tag == "article" else place or (IN_MAIN if item.tag == "main" else OUTSIDE)
            inside = (furniture or own, worded or (word and not place), named or (word and bool(place)), below_place, content or (bool(item.attrs) and not CONTENT_WORDS.isdisjoint(_WORD.findall(item.attrs.get("class", "").lower()))), link or item.tag == "a")
            if not inline:
                close(holder, furniture, worded, named, place, content)
                stack.append((None, item, *inside))
            below = holder if inline else item
            stack.extend((c, below, *inside) for c in reversed(item.children))
    close(root, False, False, False, OUTSIDE, False)
    return out


def features(b: Block) -> list[float]:
    heading, item = b.tag in _HEADINGS, b.tag in ("li", "td")
    return [
        1.0, float(b.furniture), float(b.worded), float(b.named), float(b.article), float(b.content and not b.named), b.linked, b.linked * (b.article and not (b.furniture or b.named)), min(1.0, len(b.text) / 120),
        float(b.tag in ("p", "blockquote", "pre")), float(heading), float(item),
    ]


@lru_cache(maxsize=1)
def weights() -> tuple[float, ...]:
    """The weights of the features, most likely for the training layouts and the prior (Newton's method)."""
    x, y = [], []
    for seed in range(TRAINED_ON):
        html, content = layout(seed)
        known = set(content)
        for b in blocks(parse(html)):
            x.append(features(b))
            y.append(b.text in known)
    x, y, prior = np.array(x), np.array(y, float), np.array(PRIOR)
    w = prior.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - PRECISION * (w - prior)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + PRECISION * np.eye(len(w)), slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return tuple(float(round(v, 6)) for v in w)


def score(b: Block, weight: tuple[float, ...]) -> float:
    """Log odds that a block is content."""
    return sum(w * f for w, f in zip(weight, features(b), strict=True))


def distance(a: Node, b: Node) -> int:
    """Steps of the tree between two elements, at least 1; 2 CLIMB if they don't meet within CLIMB steps up."""
    up: dict[int, int] = {}
    for k in range(CLIMB):
        up[id(a)] = k
        if a.parent is None:
            break
        a = a.parent
    for k in range(CLIMB):
        if id(b) in up:
            return max(1, up[id(b)] + k)
        if b.parent is None:
            break
        b = b.parent
    return 2 * CLIMB


def edges(found: list[Block]) -> list[tuple[int, int, float]]:
    out, last = [], {}
    for i, b in enumerate(found):
        side = b.furniture or b.worded
        if i:
            before = found[i - 1]
            out.append((i - 1, i, TIE / distance(before.holder, b.holder) * (1.0 if side == (before.furniture or before.worded) else ACROSS)))
        parent = id(b.holder.parent)
        k, other = last.get(parent, (i - 1, side))
        if k < i - 1:
            out.append((k, i, SAME_PARENT * (1.0 if side == other else ACROSS)))
        last[parent] = i, side
    return out


def minimum_cut(gain: list[float], links: list[tuple[int, int, float]]) -> list[bool]:
    """The labelling (True: content) of least cost, where calling i content costs log(1 + exp(-gain)), boilerplate
    log(1 + exp(gain)), and each link whose ends differ its weight. Dinic's algorithm on integer capacities."""
    n = len(gain)
    if all(g >= 0 for g in gain) or all(g < 0 for g in gain):
        return [g >= 0 for g in gain]
    source, sink, scale = n, n + 1, 1_000_000
    to: list[int] = []
    room: list[int] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        room.append(round(forth * scale))
        out[b].append(len(to))
        to.append(a)
        room.append(round(back * scale))

    for i, g in enumerate(gain):
        # The smaller of the two terminal capacities flows straight through, which leaves their difference: |gain|.
        if g >= 0:
            arc(source, i, g, 0)
        else:
            arc(i, sink, -g, 0)
    for a, b, w in links:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = [source]
        for a in queue:
            for e in out[a]:
                if room[e] and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        at = [0] * (n + 2)
        path: list[int] = []
        node = source
        while True:
            if node == sink:
                flow = min(room[e] for e in path)
                cut = next(k for k, e in enumerate(path) if room[e] == flow)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                del path[cut:]
                node = to[path[-1]] if path else source
            while at[node] < len(out[node]):
                e = out[node][at[node]]
                if room[e] and level[to[e]] == level[node] + 1:
                    break
                at[node] += 1
            if at[node] < len(out[node]):
                path.append(out[node][at[node]])
                node = to[path[-1]]
            elif path:
                e = path.pop()
                node = to[e ^ 1]
                at[node] += 1
            else:
                break


def main_blocks(html: str | None, weight: tuple[float, ...] | None = None) -> tuple[list[str], int]:
    """The content blocks of a page, and how many blocks it has."""
    found, weight = blocks(parse(html)), weight or weights()
    keep = minimum_cut([score(b, weight) for b in found], edges(found)) if found else []
    return [b.text for b, k in zip(found, keep, strict=True) if k], len(found)


RESULT = ("text", "n_chars", "n_blocks", "n_content")


def main_text(df: DataFrame, html_col: str = "html", keep: tuple[str, ...] | None = None) -> DataFrame:
    """The kept columns (by default all but the html), then text, n_chars (code points), n_blocks and n_content; columns
    named like a result, in any letter case, are replaced."""
    kept = without([c for c in (keep if keep is not None else df.columns) if c != html_col], RESULT)
    own = [f"k{i}" for i in range(len(kept))]
    source = df.select(*(col(c).alias(k) for c, k in zip(kept, own, strict=True)), col(html_col).alias("html"))
    fields = [f"{k} {source.schema[k].dataType.simpleString()}" for k in own]
    weight = weights()

    def build(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [main_blocks(h, weight) for h in batch.column("html").to_pylist()]
        out = ["\n\n".join(b) for b, _ in done]
        columns = [*(batch.column(k) for k in own), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64()), pa.array([n for _, n in done], pa.int32()), pa.array([len(b) for b, _ in done], pa.int32())]
        return pa.RecordBatch.from_arrays(columns, names=[*own, *RESULT])

    schema = ", ".join([*fields, "text string, n_chars bigint, n_blocks int, n_content int"])
    return map_arrow(source, lambda batches: one_pass(batches, build), schema).toDF(*kept, *RESULT)
