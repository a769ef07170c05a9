"""Schema mapping on the driver's side of a page parse: the same rules as functions.similarity.map_to_schema, for Python dictionaries."""

from __future__ import annotations

import re

from rowloom.functions.similarity import MATCH_THRESHOLD, NAMING_KEYS


def tokens(text: str) -> set[str]:
    spaced = re.sub("([a-z])([A-Z])", r"\1 \2", text)
    return {w.lower() for w in re.split(r"[\s_\-./\\\[\]()+,;:]+", spaced) if w}


def edit_distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]


def match_score(a: str, b: str) -> float:
    s, t = tokens(a), tokens(b)
    jaccard = len(s & t) / len(s | t) if s | t else 1.0
    x, y = a.lower().strip(), b.lower().strip()
    longest = max(len(x), len(y))
    return max(jaccard, 1.0 if longest == 0 else 1 - edit_distance(x, y) / longest)


def flat_value(value) -> str | None:
    """A nested value as one cell: lists joined, objects by what they are called."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int | float):
        return str(int(value)) if float(value).is_integer() else str(value)
    if isinstance(value, str):
        return value.strip() or None
    if isinstance(value, list):
        return ", ".join(filter(None, map(flat_value, value))) or None
    if isinstance(value, dict):
        return next((v for k in NAMING_KEYS if (v := flat_value(value.get(k)))), None)
    return None


def map_node(node: dict, fields: list[str]) -> tuple[dict[str, str], dict[str, str]]:
    """Values and matched keys of the fields that a node answers."""
    values, matched = {}, {}
    keys = [k for k in node if not k.startswith("@")]
    for f in fields:
        free = [k for k in keys if k not in matched.values()]
        chosen = next((k for k in free if k.lower() == f.lower()), None)
        if chosen is None and free:
            best = max(free, key=lambda k: match_score(f, k))
            chosen = best if match_score(f, best) >= MATCH_THRESHOLD else None
        value = flat_value(node[chosen]) if chosen is not None else None
        if value is not None:
            values[f], matched[f] = value, chosen
    return values, matched
