"""Conditions, assertions and the capture filter as boolean columns. Unknown names and bad comparands raise when the plan is made."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowloom.functions.js import WS_CHARS, coerced_number, collapse, finite, text_of, trim
from rowloom.functions.transforms import is_valid_pattern, java_pattern, number


@dataclass(frozen=True)
class Observed:
    """What is seen of an element: whether it exists, its text, the value of the attribute asked for, and its number where that is known."""

    exists: Column
    text: Column
    attr: Column
    number: Column | None = None

    def as_number(self) -> Column:
        return number(self.text) if self.number is None else self.number


def observed(text: Column, exists: Column | None = None, attr: Column | None = None) -> Observed:
    return Observed(exists if exists is not None else text.isNotNull(), text, attr if attr is not None else F.lit(None).cast("string"))


def observed_number(value: Column, data_type: str = "double") -> Observed:
    """A numeric column: comparisons take its value as it is, and need not read it out of a text."""
    return Observed(value.isNotNull(), text_of(value, data_type), F.lit(None).cast("string"), finite(value.cast("double")))


CONDITIONS = {
    "exists": "none", "not-exists": "none", "is-empty": "none", "not-empty": "none", "text-equals": "value", "text-contains": "value", "text-matches": "value",
    "attr-equals": "attr+value", "attr-contains": "attr+value", "attr-exists": "attr", "number-equals": "value", "number-gt": "value", "number-lt": "value",
}

COMPARABLE = tuple(name for name, needs in CONDITIONS.items() if "value" in needs)


def _squeezed(value: object) -> str:
    return re.sub(f"[{re.escape(WS_CHARS)}]+", " ", str("" if value is None else value)).strip(" ")


def _comparand(value: object, name: str) -> float:
    n = coerced_number(value)
    if n is None:
        raise ValueError(f'"{value}" is no number, and condition "{name}" compares numbers.')
    return n


def _test(name: str, o: Observed, value: Column | None, number_value: Column | None) -> Column:
    text = F.coalesce(collapse(o.text), F.lit(""))
    if name == "exists":
        return o.exists
    if name == "not-exists":
        return ~o.exists
    if name == "is-empty":
        return ~o.exists | (text == "")
    if name == "not-empty":
        return o.exists & (text != "")
    if name == "text-equals":
        return o.exists & (text == value)
    if name == "text-contains":
        return o.exists & F.contains(text, value)
    if name == "attr-equals":
        return o.exists & (F.coalesce(trim(o.attr), F.lit("")) == value)
    if name == "attr-contains":
        return o.exists & F.contains(F.coalesce(o.attr, F.lit("")), value)
    if name == "attr-exists":
        return o.exists & o.attr.isNotNull()
    read = o.as_number()
    compared = {"number-equals": read == number_value, "number-gt": read > number_value, "number-lt": read < number_value}[name]
    return o.exists & F.coalesce(compared, F.lit(False))


def condition(name: str, o: Observed, value: object = "", other: Observed | None = None, compare_attr: bool = False) -> Column:
    """A condition's truth, never null. With other, the comparand is that element's text (or attribute) instead of value."""
    if name not in CONDITIONS:
        raise ValueError(f'Unknown condition "{name}". Supported: {", ".join(CONDITIONS)}.')
    if other is not None:
        raw = F.coalesce(other.attr if compare_attr else other.text, F.lit(""))
        if name == "text-matches":
            raise ValueError('Condition "text-matches" needs a pattern that is known when the plan is made, not a second element.')
        if name.startswith("number-"):
            result = _test(name, o, None, number(raw) if compare_attr or other.number is None else other.number)
        else:
            side = collapse(raw) if name.startswith("text-") else trim(raw) if name == "attr-equals" else raw
            result = _test(name, o, side, None)
        return F.coalesce(other.exists & result, F.lit(False))
    if name == "text-matches":
        pattern = str("" if value is None else value)
        if not is_valid_pattern(pattern):
            raise ValueError(f'Condition "text-matches" has an invalid pattern: {pattern}')
        result = o.exists & F.rlike(F.coalesce(collapse(o.text), F.lit("")), F.lit(java_pattern(pattern)))
    elif name.startswith("number-"):
        result = _test(name, o, None, F.lit(_comparand(value, name)))
    else:
        text = str("" if value is None else value)
        result = _test(name, o, F.lit(_squeezed(text) if name.startswith("text-") else text.strip(WS_CHARS) if name == "attr-equals" else text), None)
    return F.coalesce(result, F.lit(False))


ASSERTIONS = ("exists", "not-exists", "count-equals", "count-at-least", "count-at-most", "text-contains", "text-equals")


def _matches(n: Column) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, " element").otherwise(" elements"))


def assertion(name: str, count: Column, text: Column, selector: str | Column = "", wanted: object = "", value: object = "") -> Column:
    """null where the assertion holds, else the message that says why not. Columns may stand for the selector (in the message),
    the count and the value that are wanted; a count that is no number fails."""
    if name not in ASSERTIONS:
        raise ValueError(f'Unknown assertion "{name}". Supported: {", ".join(ASSERTIONS)}.')
    column = lambda x: x if isinstance(x, Column) else F.lit(x)
    shown_selector = F.concat(F.lit('"'), column(selector), F.lit('"'))
    seen, nothing = F.coalesce(collapse(text), F.lit("")), F.concat(F.lit("nothing on the page matches "), shown_selector)
    if name == "exists":
        return F.when(count > 0, None).otherwise(nothing)
    if name == "not-exists":
        return F.when(count == 0, None).otherwise(F.concat(_matches(count), F.lit(" still match "), shown_selector, F.lit(", and none were expected")))
    if name.startswith("count-"):
        n = number(wanted) if isinstance(wanted, Column) else coerced_number(wanted)
        if n is None:
            raise ValueError(f'ASSERT needs a number to count against (got "{wanted}").')
        holds, words = {"count-equals": (count == n, "exactly"), "count-at-least": (count >= n, "at least"), "count-at-most": (count <= n, "at most")}[name]
        if isinstance(n, Column):
            shown = F.concat(F.coalesce(wanted, F.lit("")), F.when(n == 1, " element").otherwise(" elements"))
        else:
            shown = F.lit(f"{int(n) if float(n).is_integer() else n} element{'' if n == 1 else 's'}")
        return F.when(F.coalesce(holds, F.lit(False)), None).otherwise(F.concat(F.lit(f"expected {words} "), shown, F.lit(" matching "), shown_selector, F.lit(", found "), count.cast("string")))
    want = F.coalesce(collapse(value), F.lit("")) if isinstance(value, Column) else F.lit(_squeezed(value))
    holds, words = (F.contains(seen, want), (', which does not contain "', '"')) if name == "text-contains" else (seen == want, (', not "', '"'))
    return F.when((count > 0) & holds, None).when(count == 0, nothing).otherwise(F.concat(shown_selector, F.lit(' reads "'), seen, F.lit(f'"{words[0]}'), want, F.lit(words[1])))


def capture_filter(url: Column, method: Column, url_filter: str = "", methods: str = "") -> Column:
    """Methods (a list, any case) and an address filter: `re:` and a case-sensitive pattern, or any of a comma list, ignoring case."""
    result = F.lit(True)
    wanted = [m.upper() for m in re.split(r"[,\s]+", methods or "") if m]
    if wanted:
        result = F.upper(F.coalesce(method, F.lit(""))).isin(*wanted)
    text, url = (url_filter or "").strip(), F.coalesce(url, F.lit(""))
    if not text:
        return result
    if text.startswith("re:"):
        pattern = text[3:]
        try:
            re.compile(pattern)
        except re.error as error:
            raise ValueError(f"Sniffer URL filter is not a valid pattern: {error}") from error
        return result & F.rlike(url, F.lit(java_pattern(pattern)))
    any_part = F.lit(False)
    for part in filter(None, (p.strip().lower() for p in text.split(","))):
        any_part = any_part | F.contains(F.lower(url), F.lit(part))
    return result & any_part


#: Address parts and content types that captures leave out (fixed values).
NOISE_IN_URL, NOISE_IN_TYPE = (".png", ".jpg", ".css", ".woff"), ("image", "font", "css")


def capture_noise(url: Column, kind: Column) -> Column:
    """True for requests that captures leave out: no address, or pictures, style sheets and fonts."""
    out = F.coalesce(url, F.lit("")) == ""
    for part in NOISE_IN_URL:
        out = out | F.coalesce(F.contains(F.lower(url), F.lit(part)), F.lit(False))
    for part in NOISE_IN_TYPE:
        out = out | F.coalesce(F.contains(kind, F.lit(part)), F.lit(False))
    return out
