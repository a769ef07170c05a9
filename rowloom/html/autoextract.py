"""Automatic extraction of a page's main record: structured data first, then heuristics, merged with a confidence for each field.

Layout is not known offline, so font sizes, distances to buttons and picture areas take no part in the heuristic
scores; everything else does.
"""

from __future__ import annotations

import json
import re

from rowloom.functions import text_schema as TS
from rowloom.functions.similarity import DEFAULT_FIELDS, PRODUCT_WEIGHTS
from rowloom.functions.transforms import absolute_url
from rowloom.html.read import clean
from rowloom.html.select import classes, select
from rowloom.html.tree import Node

#: Meta properties by field, confidences by source, keyword scores, price and noise patterns.
META_FIELDS = {
    "name": ("og:title", "twitter:title", "product:name", "title"), "price": ("product:price:amount", "og:price:amount", "twitter:data1"), "currency": ("product:price:currency", "og:price:currency"),
    "images": ("og:image", "og:image:secure_url", "twitter:image", "product:image"), "description": ("og:description", "twitter:description", "description"), "brand": ("og:brand", "product:brand"),
    "availability": ("product:availability", "og:availability"),
}
CONFIDENCE = {"json-ld": 98, "microdata": 95, "og-meta": 90}
ESCALATE, WARN = 70, 50
KEYWORDS = (
    ("name", 90, r"\bproduct[-_]?(?:name|title)\b"), ("name", 85, r"\bpdp[-_]?(?:name|title|heading)\b"), ("name", 80, r"\bitem[-_]?(?:name|title)\b"), ("name", 70, r"\bproduct[-_]?(?:header|info)\b"),
    ("name", 60, r"\btitle\b.*\bproduct\b|\bproduct\b.*\btitle\b"), ("price", 95, r"\bselling[-_]?price\b|\bsale[-_]?price\b|\bdiscounted[-_]?price\b"), ("price", 90, r"\bproduct[-_]?price\b|\bitem[-_]?price\b|\bpdp[-_]?price\b"),
    ("price", 85, r"\boffer[-_]?price\b|\bcurrent[-_]?price\b|\bfinal[-_]?price\b"), ("price", 80, r"\bprice[-_]?(?:box|container|block|value|amount)\b"), ("price", 70, r"\b(?:price|pricing)\b"),
    ("originalPrice", 90, r"\b(?:mrp|original|was|before|old|regular|full)[-_]?price\b"), ("originalPrice", 80, r"\bprice[-_]?(?:before|was|original|old)\b"), ("originalPrice", 70, r"\bstrike[-_]?price\b|\blist[-_]?price\b"),
    ("images", 90, r"\bproduct[-_]?(?:image|img|photo|gallery|media)\b"), ("images", 80, r"\bpdp[-_]?(?:image|gallery|media)\b"), ("images", 70, r"\bgallery[-_]?(?:main|primary|hero)\b"), ("images", 60, r"\bmain[-_]?(?:image|img|photo)\b|\bhero[-_]?(?:image|img)\b"),
    ("brand", 85, r"\bproduct[-_]?brand\b|\bbrand[-_]?name\b"), ("brand", 75, r"\bbrand\b"), ("sku", 90, r"\bsku\b|\bmodel[-_]?(?:no|num|number|id)\b|\bpart[-_]?(?:no|num|number)\b"), ("sku", 75, r"\bitem[-_]?id\b|\bproduct[-_]?id\b|\bpid\b"),
    ("description", 85, r"\bproduct[-_]?desc(?:ription)?\b"), ("description", 75, r"\bitem[-_]?desc(?:ription)?\b|\bpdp[-_]?desc(?:ription)?\b"), ("description", 65, r"\bdesc(?:ription)?\b"),
    ("availability", 85, r"\b(?:in[-_]?stock|out[-_]?of[-_]?stock|availability|stock[-_]?status)\b"), ("availability", 70, r"\bstock\b"), ("rating", 85, r"\brating(?:[-_]?value|[-_]?score|[-_]?avg)?\b"),
    ("rating", 75, r"\bstars?\b.*\brating|\brating.*\bstars?\b"), ("reviewCount", 85, r"\b(?:review|rating)[-_]?count\b|\bnum[-_]?reviews?\b"), ("reviewCount", 75, r"\breviews?\b.*\bcount|\bcount.*\breviews?\b"),
)
PRICE_START = re.compile(r"(?:[$₹€£¥₩₽R]|(?:USD|INR|EUR|GBP|JPY|CNY|AED|AUD|CAD)\s*)?\s?[\d,]+(?:\.\d{1,2})?", re.A)
MONEY = re.compile("[$₹€£¥₩₽]|USD|INR|EUR|GBP")
CURRENCIES = (("INR", "₹|INR"), ("USD", r"\$|USD"), ("EUR", "€|EUR"), ("GBP", "£|GBP"), ("JPY", "¥|JPY|CNY"), ("KRW", "₩|KRW"), ("RUB", "₽|RUB"), ("AED", "AED"))
NOISE = "nav, header, footer, aside, [role=navigation], [role=banner], [role=contentinfo], .nav, .navbar, .header, .footer, .sidebar, .breadcrumb, .breadcrumbs, #nav, #header, #footer, #sidebar"
DULL_IMAGE = re.compile("sprite|icon|logo|flag|pixel|1x1|blank|placeholder", re.I)
DOM_NOISE = "script, style, link, noscript, svg, iframe, nav, header, footer, aside, [role=navigation], [role=banner], [role=contentinfo], .nav, .navbar, .header, .footer, .sidebar, .breadcrumb, .ads, .advertisement, .cookie-banner, .popup, .modal:not([aria-label*=product])"
MIN_SCORES = {"name": 50, "brand": 55, "sku": 60, "description": 55, "availability": 60, "rating": 60, "reviewCount": 60}
MOST_IMAGES, MOST_DOM = 8, 12_000

_KEYWORDS = {f: [(s, re.compile(p, re.I | re.A)) for g, s, p in KEYWORDS if g == f] for f in {f for f, _, _ in KEYWORDS}}


def _first(*values):
    return next((v for v in values if v not in (None, "", [])), None)


def currency_of(text: str | None) -> str | None:
    return next((c for c, p in CURRENCIES if re.search(p, clean(text))), None)


def price_of(text: str | None) -> float | None:
    m = re.search(r"[0-9]+(?:\.[0-9]{1,2})?", clean(text).replace(",", ""))
    return float(m[0]) if m else None


def _documents(root: Node):
    for block in root.walk():
        if block.tag == "script" and block.attrs.get("type") == "application/ld+json":
            try:
                yield json.loads(block.text())
            except ValueError:
                continue


def _products(data):
    if isinstance(data, list):
        for item in data:
            yield from _products(item)
    elif isinstance(data, dict):
        kind = data.get("@type")
        if kind == "Product" or (isinstance(kind, list) and "Product" in kind):
            yield data
        yield from _products(data.get("@graph") if isinstance(data.get("@graph"), list) else None)


def from_json_ld(root: Node) -> dict | None:
    p = next((x for d in _documents(root) for x in _products(d)), None)
    if p is None:
        return None
    offers = p.get("offers")
    offer = (offers[0] if offers else {}) if isinstance(offers, list) else offers
    offer = offer if isinstance(offer, dict) else {}
    price = offer.get("price") if offer.get("price") is not None else p.get("price")
    pictures = p.get("image") if isinstance(p.get("image"), list) else [p.get("image")]
    stock = clean(_first(offer.get("availability"), p.get("availability")))
    said = next((w for k, w in (("instock", "In Stock"), ("outofstock", "Out of Stock"), ("preorder", "Pre-order")) if k in stock.lower()), stock or None)
    rated = p.get("aggregateRating") if isinstance(p.get("aggregateRating"), dict) else {}
    text = lambda v: None if v is None else str(v)
    return {
        "name": clean(p.get("name")), "price": text(price), "currency": _first(offer.get("priceCurrency"), p.get("priceCurrency")), "images": [i if isinstance(i, str) else i["url"] for i in pictures if isinstance(i, str) or (isinstance(i, dict) and i.get("url"))],
        "brand": p["brand"] if isinstance(p.get("brand"), str) else (p["brand"].get("name") if isinstance(p.get("brand"), dict) else None), "description": clean(p.get("description")), "sku": _first(*(p.get(k) for k in ("sku", "mpn", "productID", "identifier"))),
        "availability": said, "rating": text(rated.get("ratingValue")), "reviewCount": text(_first(rated.get("reviewCount"), rated.get("ratingCount"))),
    }


def from_microdata(root: Node) -> dict | None:
    scope = next(iter(select(root, '[itemtype*="schema.org/Product"]')), None)
    if scope is None:
        return None

    def get(*names: str, within: Node = scope) -> str | None:
        for name in names:
            n = next(iter(select(within, f'[itemprop="{name}"]')), None)
            if n is not None and (value := clean(_first(n.attrs.get("content"), n.attrs.get("href"), n.text()))):
                return value
        return None

    offer = next(iter(select(scope, '[itemtype*="Offer"]')), None)
    pictures = [clean(_first(n.attrs.get("src"), n.attrs.get("content"))) for n in select(scope, '[itemprop="image"]')]
    return {
        "name": get("name"), "price": get("price", "lowPrice", within=offer) if offer else get("price"), "currency": get("priceCurrency", within=offer or scope), "images": [i for i in pictures if i], "brand": get("brand", "manufacturer"), "description": get("description"),
        "sku": get("sku", "mpn", "productID"), "availability": "In Stock" if get("availability") else None, "rating": get("ratingValue"), "reviewCount": get("reviewCount", "ratingCount"),
    }


def from_meta(root: Node) -> dict | None:
    tags: dict[str, list[str]] = {}
    for n in root.walk():
        if n.tag == "meta" and clean(n.attrs.get("content")):
            for key in {n.attrs.get("property"), n.attrs.get("name")} - {None}:
                tags.setdefault(key, []).append(clean(n.attrs["content"]))
    found = {f: [v for k in keys for v in tags.get(k, [])] for f, keys in META_FIELDS.items()}
    if not found["name"] and not found["price"]:
        return None
    return {f: v if f == "images" else (v[0] if v else None) for f, v in found.items()} | {"sku": None, "rating": None, "reviewCount": None}


def structured(root: Node) -> tuple[str, dict] | None:
    """The best structured record of the page and where it is from."""
    for method, read in (("json-ld", from_json_ld), ("microdata", from_microdata), ("og-meta", from_meta)):
        record = read(root)
        if record is not None:
            return method, record
    return None


def _element_score(node: Node, field: str, text: str) -> int:
    names = " ".join([*classes(node), node.attrs.get("id", "")])
    data = " ".join(f"{k[5:]} {v}" for k, v in node.attrs.items() if k.startswith("data-"))
    scores = [s for s, p in _KEYWORDS[field] if p.search(names)] + [s - 10 for s, p in _KEYWORDS[field] if data and p.search(data)]
    best = max([0, *scores, {("name", "h1"): 75, ("name", "h2"): 60, ("images", "img"): 60}.get((field, node.tag), 0)])
    return min(100, best + 20) if field in ("price", "originalPrice") and PRICE_START.match(text) else best


def heuristics(root: Node, base: str | None = None) -> tuple[dict, dict]:
    """Values and confidences by class names, tags and money signs."""
    noise = set()
    for top in select(root, NOISE):
        noise.update(id(n) for n in top.walk())
    nodes = [(n, clean(n.text())) for n in root.walk() if n.tag != "#document" and id(n) not in noise and n.tag not in ("script", "style", "noscript", "template")]
    values, sure = dict.fromkeys(DEFAULT_FIELDS), dict.fromkeys(DEFAULT_FIELDS, 0)
    for field, least in MIN_SCORES.items():
        for n, text in nodes:
            if text and len(text) <= 2000 and (s := _element_score(n, field, text)) >= least and s > sure[field]:
                values[field], sure[field] = text, s
    for field in ("price", "originalPrice"):
        for n, text in nodes:
            if len(n.elements()) > 3 or not text or not (PRICE_START.match(text) or MONEY.search(text)):
                continue
            amount = price_of(text)
            struck = field == "originalPrice" and (n.tag in ("s", "del", "strike") or "line-through" in n.attrs.get("style", ""))
            s = min(100, _element_score(n, field, text) + 25 + 20 * struck)
            if amount and 0 < amount <= 1_000_000 and s > sure[field]:
                values[field], sure[field] = text, s
    pictures: dict[str, int] = {}
    for n, _ in nodes:
        src = _first(n.attrs.get("src"), n.attrs.get("data-src")) if n.tag == "img" else None
        if src and not DULL_IMAGE.search(src) and not (src.startswith("data:") and len(src) < 200):
            pictures.setdefault(absolute_url(src, base), min(100, _element_score(n, "images", "") + 10))
    values["images"] = sorted(pictures, key=lambda u: -pictures[u])[:MOST_IMAGES]
    sure["images"] = max(pictures.values(), default=0)
    values["currency"] = currency_of(values["price"])
    sure["currency"] = 70 if values["currency"] else 0
    return values, sure


def overall(confidence: dict[str, int], weights: dict[str, int] = PRODUCT_WEIGHTS) -> int:
    total = sum(weights.values())
    return int(sum(confidence.get(f, 0) * w for f, w in weights.items()) / total + 0.5) if total else 0


def merged(first: tuple[str, dict] | None, second: tuple[dict, dict]) -> dict:
    """Structured values where there are any, else the heuristics'."""
    method, record = first or ("heuristic", {})
    values, sure = second
    out, confidence, source = {}, {}, {}
    for f in DEFAULT_FIELDS:
        given, guessed = record.get(f), values.get(f)
        has, guess = given not in (None, "", []), guessed not in (None, "", [])
        out[f] = given if has else guessed if guess else None
        confidence[f] = CONFIDENCE[method] if has else sure.get(f, 0)
        source[f] = method if has else "heuristic" if guess else "none"
    warnings = [f'Field "{f}" has low confidence ({confidence[f]}/100): verify it by hand.' for f in DEFAULT_FIELDS if out[f] is not None and confidence[f] < WARN]
    return {"result": out, "confidence": confidence, "from": source, "overall": overall(confidence), "method": method, "warnings": warnings}


def richest_node(root: Node) -> dict:
    """The JSON-LD node with the most keys of its own, for fields that the user named."""
    found: list[dict] = []

    def collect(data, depth: int = 0) -> None:
        if depth <= 4 and isinstance(data, list):
            for item in data:
                collect(item, depth + 1)
        elif depth <= 4 and isinstance(data, dict):
            if isinstance(data.get("@graph"), list):
                collect(data["@graph"], depth)
            if any(not k.startswith("@") for k in data):
                found.append(data)

    for d in _documents(root):
        collect(d)
    return max(found, key=lambda n: sum(not k.startswith("@") for k in n), default={})


def meta_node(root: Node) -> dict[str, str]:
    out: dict[str, str] = {}
    for n in root.walk():
        key = (n.attrs.get("property") or n.attrs.get("name") or "").strip() if n.tag == "meta" else ""
        key = re.sub("^(og|article|twitter|product|book|profile):", "", key)
        if key and ":" not in key and n.attrs.get("content", "").strip():
            out.setdefault(key, n.attrs["content"].strip())
    return out


def simplified_text(root: Node) -> str:
    """The page's text without furniture, squeezed and cut to MOST_DOM characters: what a model would be shown."""
    drop = {id(n) for n in select(root, DOM_NOISE)}
    out: list[str] = []

    def walk(node: Node) -> None:
        for c in node.children:
            if isinstance(c, str):
                out.append(c)
            elif id(c) not in drop:
                walk(c)

    for body in select(root, "body") or [root]:
        walk(body)
    return re.sub(r"\s{3,}", "\n\n", "".join(out)).strip()[:MOST_DOM]


def parse_model_answer(text: str | None) -> dict | None:
    """A model's JSON answer: fences cut off, an object or nothing."""
    body = re.sub(r"^```[a-z]*\s*|\s*```\s*$", "", (text or "").strip(), flags=re.I)
    try:
        data = json.loads(body)
    except ValueError:
        start, end = body.find("{"), body.rfind("}")
        try:
            data = json.loads(body[start : end + 1]) if 0 <= start < end else None
        except ValueError:
            return None
    return data if isinstance(data, dict) else None


#: Confidence of a value that a model gives without a score: of a product field, and of a field asked for by name.
UNSCORED_PRODUCT, UNSCORED_NAMED = 80, 60


def _said(value) -> str | None:
    if isinstance(value, list):
        return ", ".join(x for x in map(_said, value) if x) or None
    if isinstance(value, dict):
        return json.dumps(value, ensure_ascii=False)
    text = "" if value is None else ("true" if value else "false") if isinstance(value, bool) else f"{value:g}" if isinstance(value, float) and value.is_integer() else str(value)
    return text.strip() or None


def model_cells(text: str | None, names: list[str], named: bool) -> list[tuple[str | None, int]]:
    """(value, confidence) of each field in a model's answer. Fields asked for by name are matched to the answer's keys
    by likeness; scores stand under "confidence", from 0 to 100: others are no scores (of product fields) or the nearest
    that is one (of named fields)."""
    data = parse_model_answer(text)
    if data is None:
        return [(None, 0)] * len(names)
    scores = data.get("confidence") if isinstance(data.get("confidence"), dict) else {}
    given = {k: v for k, v in data.items() if k != "confidence" or "confidence" in names}
    likely = TS.map_node(given, names)[0] if named else {}
    by_name = {k.lower(): v for k, v in scores.items()}
    out = []
    for name in names:
        value = _said(given[name] if name in given else likely.get(name))
        try:
            score = float(by_name.get(name.lower()))
        except (TypeError, ValueError):
            score = float("nan")
        if named and score == score and abs(score) != float("inf"):
            sure = int(min(100.0, max(0.0, score)) + 0.5)
        elif not named and 0 <= score < 101:
            sure = int(score)
        else:
            sure = 0 if value is None else UNSCORED_NAMED if named else UNSCORED_PRODUCT
        out.append((value, sure))
    return out
