"""Labelled page layouts, made from a seed: what the block classifier of the main-text extraction is trained on.

A layout has an article among furniture. Articles are marked by an article or main element, by a class, or by nothing;
furniture likewise by element, role, class, or nothing. Some parts of articles have classes that usually name
furniture, and some furniture (teasers, reader comments) stands in article elements, so no single mark decides.
"""

from __future__ import annotations

import random

LETTERS = "aeiounrstlmdp"

WRAPPERS = (("article", ""), ("article", ""), ("article", ""), ("article", ' class="post"'), ("main", ""), ("div", ' class="content"'), ("div", ' class="entry-body"'), ("div", ' id="story"'), ("div", ""), ("section", ""))
NAVS = (("nav", ""), ("div", ' class="menu"'), ("div", ' role="navigation"'), ("ul", ' class="breadcrumb"'), ("div", ' class="top"'))
SIDES = (("aside", ""), ("div", ' class="sidebar"'), ("div", ' class="widget"'), ("section", ' class="related-posts"'), ("div", ' class="col-2"'))
NOTICES = (("div", ' class="cookie-notice"'), ("div", ' class="ad"'), ("div", ' id="newsletter"'), ("div", ' class="promo box"'), ("p", ' class="sponsored"'))
FEET = (("footer", ""), ("div", ' class="footer"'), ("div", ' role="contentinfo"'), ("div", ' class="bottom"'))
#: Classes that usually name furniture, on parts of articles.
MISLEADING = (' class="notice"', ' class="related"', ' class="comment"', ' class="share-note"', ' class="disclaimer"')


class _Maker:
    def __init__(self, seed: int):
        self.r, self.content = random.Random(seed), []

    def words(self, low: int, high: int) -> list[str]:
        r = self.r
        return ["".join(r.choice(LETTERS) for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(low, high))]

    def sentence(self, low: int = 6, high: int = 18) -> str:
        return " ".join(self.words(low, high)).capitalize() + self.r.choice("....?!")

    def prose(self, sentences: int) -> str:
        return " ".join(self.sentence() for _ in range(sentences))

    def kept(self, text: str) -> str:
        self.content.append(text)
        return text

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f'<{tag}><a href="/{k}">{" ".join(self.words(1, 4))}</a></{tag}>' for k in range(n))

    def part(self) -> str:
        """A part of the article."""
        r, kind, mark = self.r, self.r.random(), self.r.choice(MISLEADING) if self.r.random() < 0.06 else ""
        if kind < 0.6:
            text = self.kept(self.prose(r.choice((1, 1, 2, 3, 5, 12))) if r.random() < 0.8 else " ".join(self.words(1, 60)))
            first, _, rest = text.partition(" ")
            if rest and r.random() < 0.25:
                return f'<p{mark}><a href="/x">{first}</a> {rest}</p>'
            return f"<p{mark}>{text}</p>"
        if kind < 0.75:
            return f"<h2>{self.kept(' '.join(self.words(1, 6)).capitalize())}</h2>"
        if kind < 0.88:
            return "<ul>" + "".join(f"<li>{self.kept(' '.join(self.words(1, 12)))}</li>" for _ in range(r.randrange(2, 6))) + "</ul>"
        if kind < 0.94:
            return f"<blockquote{mark}>{self.kept(self.sentence())}</blockquote>"
        if kind < 0.97:
            return "<ul>" + "".join(f'<li><a href="/r{k}">{self.kept(" ".join(self.words(2, 8)))}</a></li>' for k in range(r.randrange(1, 4))) + "</ul>"
        return f"<p>{self.kept(' '.join(self.words(1, 4)))}</p>"

    def article(self) -> str:
        tag, attrs = self.r.choice(WRAPPERS)
        parts = [f"<h1>{self.kept(' '.join(self.words(2, 8)).capitalize())}</h1>"] + [self.part() for _ in range(self.r.randrange(2, 12))]
        if self.r.random() < 0.25:
            parts.insert(self.r.randrange(1, len(parts)), self.r.choice((f'<div class="ad-slot">{self.sentence()}</div>', f"<aside><p>{self.prose(2)}</p></aside>", f'<div class="share">{self.links(3, "span")}</div>')))
        return f"<{tag}{attrs}>{''.join(parts)}</{tag}>"

    def side(self) -> str:
        tag, attrs = self.r.choice(SIDES)
        if self.r.random() < 0.2:
            cards = "".join(f"<article><h3><a href=/{k}>{' '.join(self.words(2, 6))}</a></h3><p>{self.sentence(4, 9)}</p></article>" for k in range(self.r.randrange(2, 5)))
            return f"<{tag}{attrs}>{cards}</{tag}>"
        return f"<{tag}{attrs}><h3>{' '.join(self.words(1, 3))}</h3><ul>{self.links(self.r.randrange(3, 8))}</ul></{tag}>"

    def comments(self) -> str:
        tag, attrs = self.r.choice((("article", ' class="comment"'), ("div", ' class="comment-body"'), ("li", ' class="reply"')))
        said = "".join(f"<{tag}{attrs}><p>{self.prose(self.r.randrange(1, 4))}</p></{tag}>" for _ in range(self.r.randrange(1, 5)))
        return f'<section id="comments">{said}</section>'

    def page(self) -> str:
        r = self.r
        tag, attrs = r.choice(NAVS)
        body = [f"<header><a href=/>{' '.join(self.words(1, 3))}</a></header>"] if r.random() < 0.5 else []
        body.append(f"<{tag}{attrs}>{self.links(r.randrange(3, 9))}</{tag}>")
        notice, extra = r.choice(NOTICES)
        if r.random() < 0.6:
            body.append(f"<{notice}{extra}>{self.prose(r.choice((1, 1, 2)))}</{notice}>")
        body.append(self.article())
        if r.random() < 0.6:
            body.insert(r.randrange(1, len(body) + 1), self.side())
        if r.random() < 0.4:
            body.append(self.comments())
        tag, attrs = r.choice(FEET)
        body.append(f"<{tag}{attrs}><p>{self.sentence(3, 8)}</p>{self.links(r.randrange(0, 4), 'span')}</{tag}>")
        joined = "".join(body)
        return f"<html><body>{f'<div>{joined}</div>' if r.random() < 0.5 else joined}</body></html>"


def layout(seed: int) -> tuple[str, list[str]]:
    """A page and the texts of its article's blocks."""
    maker = _Maker(seed)
    html = maker.page()
    return html, maker.content
