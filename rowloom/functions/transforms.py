"""Value transforms: names that compile to Column expressions.

A transform that cannot do its job gives null, never a plausible wrong value; a chain stops at its first null. Names,
patterns, flags and groups are checked when the plan is made.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from urllib.parse import quote, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.js import WORD_EDGE, WS, WS_CHARS, collapse, double_or_null, finite, trim

#: Texts longer than this are not searched by patterns.
MAX_REGEX_INPUT = 20_000
FLAGS = "ims"
MAX_GROUP = 20


_EXPONENT = r"-?[0-9]+(?:[.,][0-9]+)?[eE][+-]?[0-9]+"
_NUMERIC_RUN = rf"-?[0-9][0-9.,{WS}]*[0-9]|-?[0-9]"
#: One decimal mark, after thousands marks of the other kind, or alone before one or two digits.
_DECIMAL_COMMA = r"^-?(?:[0-9.]*\.[0-9.]*,[0-9]+|[0-9]+,[0-9]{1,2})\z"
_DECIMAL_POINT = r"^-?(?:[0-9,]*,[0-9,]*\.[0-9]+|[0-9]+\.[0-9]{1,2})\z"


def number(c: Column) -> Column:
    """The number in a text: exponents first; the last of comma and point is the decimal mark; a lone mark is one only before one or two digits."""

    def read(found: Column) -> Column:
        run = found["run"]
        plain = (
            F.when(F.rlike(run, F.lit(_DECIMAL_COMMA)), F.translate(run, ",.", ".")).when(F.rlike(run, F.lit(_DECIMAL_POINT)), F.translate(run, ",", ""))
            .when(F.contains(run, F.lit(",")) & F.contains(run, F.lit(".")), None).otherwise(F.translate(run, ",.", ""))
        )
        return F.coalesce(finite(F.translate(found["exponent"], ",", ".").try_cast("double")), finite(plain.try_cast("double")))

    # The lambda's variable names what both extractions gave, so that neither is made more than once.
    found = F.struct(F.regexp_extract(c, _EXPONENT, 0).alias("exponent"), F.regexp_replace(F.regexp_extract(c, _NUMERIC_RUN, 0), f"[{WS}]", "").alias("run"))
    return F.transform(F.array(found), read)[0]


def normalize_flags(flags: object) -> str:
    given = str(flags or "").lower()
    return "".join(f for f in FLAGS if f in given)


def normalize_group(group: object) -> int | None:
    if group is None or group == "":
        return None
    try:
        n = float(str(group))
    except ValueError:
        return None
    return int(n) if n.is_integer() and 0 <= n <= MAX_GROUP else None


def is_catastrophic(pattern: str) -> bool:
    """A repeated group that itself repeats."""
    return re.search(r"\([^()]*[+*][^()]*\)[+*]", pattern) is not None


def is_valid_pattern(pattern: str, flags: str = "") -> bool:
    if is_catastrophic(pattern):
        return False
    try:
        re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", pattern))
        return True
    except re.error:
        return False


def java_pattern(pattern: str, flags: str = "") -> str:
    """A script pattern for Java: ASCII classes and boundaries, script white space, flags in front."""
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            d = pattern[i + 1]
            if d == "s":
                out.append(WS if in_class else f"[{WS}]")
            elif d == "S" and not in_class:
                out.append(f"[^{WS}]")
            elif d == "b" and not in_class:
                out.append(WORD_EDGE)
            else:
                out.append(c + d)
            i += 2
            continue
        if c == "[":
            in_class = True
            out.append(c if not out or not in_class or i == 0 or pattern[i - 1] != "[" else "\\[")
        elif c == "]":
            in_class = False
            out.append(c)
        elif c == "$" and not in_class and "m" not in flags:
            out.append("\\z")
        else:
            out.append(c)
        i += 1
    java = "".join({"i": "iu", "m": "m", "s": "s"}[f] for f in flags)
    return (f"(?{java})" if java else "") + "".join(out)


def regex(c: Column, pattern: object = "", flags: object = "", group: object = None) -> Column:
    """The pattern's first group (or the whole match if it has none, or the group asked for); null where there is none."""
    raw, f = str(pattern or ""), normalize_flags(flags)
    if not raw or not is_valid_pattern(raw, f):
        return F.lit(None).cast("string")
    groups = re.compile(re.sub(r"\(\?<([A-Za-z_]\w*)>", r"(?P<\1>", raw)).groups
    wanted = normalize_group(group)
    index = 0 if wanted == 0 or (groups == 0 and wanted in (None, 1)) else wanted or 1
    if index > groups:
        return F.lit(None).cast("string")
    java = java_pattern(raw, f)
    found = F.regexp_extract(c, java, index)
    # An unmatched optional group and a group that matched nothing look alike; both are told from "no match" here.
    return F.when((F.length(c) <= MAX_REGEX_INPUT) & F.rlike(c, F.lit(java)), found if index == 0 else F.when(found != "", found))


def base64(c: Column) -> Column:
    """Decoded text; null unless the input is base64 (URL-safe and unpadded forms too) of at least four characters and UTF-8."""
    norm = F.translate(trim(c), "-_", "+/")
    bare = F.regexp_replace(norm, "=+$", "")
    length = F.length(bare) % 4
    ok = F.rlike(norm, F.lit(r"^[A-Za-z0-9+/]+={0,2}\z")) & (F.length(norm) >= 4) & (length != 1) & ((F.length(norm) == F.length(bare)) | (F.length(norm) % 4 == 0))
    padded = F.concat(bare, F.when(length == 2, "==").when(length == 3, "=").otherwise(""))
    return F.try_validate_utf8(F.try_to_binary(F.when(ok, padded), F.lit("base64")).cast("string"))


_SPECIAL = {"http": 80, "https": 443, "ftp": 21, "ws": 80, "wss": 443}


def absolute_url(value: str | None, base: str | None) -> str | None:
    """value resolved against base, in the normal form of a browser; unchanged where it cannot be."""
    if value is None:
        return None
    text = value.strip(WS_CHARS)
    if not text:
        return text
    try:
        joined = urljoin(base or "", text)
        parts = urlsplit(joined)
        if not parts.scheme:
            return text
        if parts.scheme not in _SPECIAL:
            return joined
        host = (parts.hostname or "").lower()
        if not host or " " in host:
            return text
        port = f":{parts.port}" if parts.port and parts.port != _SPECIAL[parts.scheme] else ""
        login = parts.netloc.rpartition("@")[0]
        segments: list[str] = []
        path = quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._[]|\\^")
        for s in path.replace("\\", "/").split("/")[1:]:
            if s == "..":
                segments[-1:] = []
            elif s != ".":
                segments.append(s)
        if path.endswith(("/.", "/..")):
            segments.append("")
        encode = lambda s, safe: quote(s, safe=safe + "/%:@!$&()*+,;=~-._?[]|\\^`{}")
        return urlunsplit((parts.scheme, (login + "@" if login else "") + host + port, "/" + "/".join(segments), encode(parts.query, ""), encode(parts.fragment, "'#")))
    except ValueError:
        return text


def url(c: Column, base: Column | str | None = None) -> Column:
    """Full address; an Arrow-batched Python stage, as no built-in resolves addresses."""

    @F.pandas_udf("string")
    def resolve(values: pd.Series, bases: pd.Series) -> pd.Series:
        return pd.Series([absolute_url(v, b) for v, b in zip(values, bases, strict=True)], dtype=object)

    return resolve(c, base if isinstance(base, Column) else F.lit(base).cast("string"))


TRANSFORMS: dict[str, Callable[..., Column]] = {
    "trim": lambda c, **_: collapse(c),
    "number": lambda c, **_: number(c),
    "url": lambda c, base=None, **_: url(c, base),
    "regex": lambda c, pattern="", flags="", group=None, **_: regex(c, pattern, flags, group),
    "base64": lambda c, **_: base64(c),
    "lower": lambda c, **_: F.lower(c),
    "upper": lambda c, **_: F.upper(c),
}


def apply_transform(c: Column, name: str | None, **options) -> Column:
    if not name or name == "none":
        return c
    if name not in TRANSFORMS:
        raise ValueError(f'Unknown value transform "{name}". Supported: {", ".join(TRANSFORMS)}.')
    return TRANSFORMS[name](c, **options)


def apply_transforms(c: Column, names: Iterable[str], **options) -> Column:
    """A chain; null once any step gives null. A number that goes on to a text transform is printed as a script prints it."""
    from rowloom.functions.js import number_text

    is_number = False
    for name in names:
        if is_number and name not in ("none", "", None):
            c = number_text(c)
            is_number = False
        c = apply_transform(c, name, **options)
        is_number = is_number or name == "number"
    return c


def transform_rows(df: DataFrame, fields: dict[str, dict]) -> DataFrame:
    """Apply each field's chain ({"transform": [...], options...}) to the columns that are there; an error names the field."""
    columns = {}
    for name, spec in fields.items():
        if name in df.columns and spec.get("transform"):
            options = {k: v for k, v in spec.items() if k != "transform"}
            try:
                columns[name] = apply_transforms(F.col(name), spec["transform"], **options)
            except ValueError as error:
                raise ValueError(f'Field "{name}": {error}') from error
    return df.withColumns(columns) if columns else df


# Form-fill transforms: a failing one gives the value back unchanged.
def _title(c: Column) -> Column:
    """The first letter of each word upper-cased, the rest left as it is."""
    words = F.regexp_extract_all(c, F.lit(r"([0-9A-Za-z_]+|[^0-9A-Za-z_]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substr(w, F.lit(1), F.lit(1))), F.substr(w, F.lit(2)))), "")


FORM_TRANSFORMS: dict[str, Callable[[Column], Column]] = {
    "trim": trim,
    "lowercase": F.lower,
    "uppercase": F.upper,
    "title-case": _title,
    "normalize-phone": lambda c: F.regexp_replace(c, r"[^0-9+]", ""),
    "strip-html": lambda c: F.regexp_replace(c, "<[^>]+>", ""),
    "parse-number": lambda c: double_or_null(F.regexp_replace(c, r"[^0-9.\-]", "")),
    "boolean": lambda c: F.lower(c).isin("yes", "true", "1", "y"),
    "truncate-100": lambda c: F.substr(c, F.lit(1), F.lit(100)),
    "pad-zero-5": lambda c: F.when(F.length(c) < 5, F.lpad(c, 5, "0")).otherwise(c),
    "iso-date": lambda c: F.coalesce(F.date_format(F.coalesce(F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("M/d/yyyy")), F.try_to_timestamp(c)), "yyyy-MM-dd"), c),
}

