"""Building blocks with a browser script's semantics, as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the scripting language defines it (fixed values), for use inside a character class.
WS = "\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
WS_CHARS = "\t\n\x0b\x0c\r \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

#: ASCII word boundaries; Java's own are Unicode-aware.
NOT_AFTER_WORD, NOT_BEFORE_WORD = "(?<![0-9A-Za-z_])", "(?![0-9A-Za-z_])"
WORD_EDGE = "(?:(?<![0-9A-Za-z_])(?=[0-9A-Za-z_])|(?<=[0-9A-Za-z_])(?![0-9A-Za-z_]))"


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null stays null."""
    return F.btrim(F.regexp_replace(c, f"[{WS}]+", " "), F.lit(" "))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def number_text(c: Column) -> Column:
    """A double as the scripting language prints it: 25, not 25.0; exponents from 1e21 up and under 1e-6."""
    exponent = F.regexp_extract(c.cast("string"), r"E(-?\d+)$", 1)
    digits = F.regexp_replace(F.regexp_replace(c.cast("string"), r"E-?\d+$", ""), r"\.0$", "")
    scientific = F.concat(digits, F.lit("e"), F.when(F.startswith(exponent, F.lit("-")), exponent).otherwise(F.concat(F.lit("+"), exponent)))
    plain = F.when(F.abs(c) >= 1e15, c.cast("decimal(38,0)").cast("string")).otherwise(
        F.regexp_replace(F.regexp_replace(c.cast("decimal(38,20)").cast("string"), "0+$", ""), r"\.$", "")
    )
    small_or_large = (F.abs(c) >= 1e21) | ((F.abs(c) < 1e-6) & (c != 0))
    direct = F.regexp_replace(c.cast("string"), r"\.0$", "")
    return (
        F.when(F.isnan(c), "NaN").when(c == float("inf"), "Infinity").when(c == float("-inf"), "-Infinity").when(c == 0, "0")
        .when(small_or_large, scientific).when(exponent != "", F.when(F.abs(c) >= 1, plain).otherwise(plain)).otherwise(direct)
    )


def text_of(c: Column, data_type: str) -> Column:
    """A value as text: numbers and booleans as the scripting language prints them, structures as JSON."""
    if data_type in ("double", "float"):
        return number_text(c.cast("double"))
    if data_type == "string":
        return c
    if data_type.startswith(("struct", "array", "map")) or data_type == "variant":
        return F.to_json(c, {"ignoreNullFields": "false"})
    return c.cast("string")


def finite(d: Column) -> Column:
    """A double, or null where it is infinite."""
    return F.when(d.between(-1.7976931348623157e308, 1.7976931348623157e308), d)


def double_or_null(c: Column) -> Column:
    """try_cast to a finite double."""
    return finite(c.try_cast("double"))


def coerced_number(value: object) -> float | None:
    """A plan-time value read as the scripting language's Number() reads it: blank is 0, text that is no number None."""
    import math
    import re

    s = str("" if value is None else value).strip(WS_CHARS)
    if s == "":
        return 0.0
    if re.fullmatch(r"0[xX][0-9a-fA-F]+|0[oO][0-7]+|0[bB][01]+", s):
        return float(int(s, 0))
    if re.fullmatch(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", s):
        x = float(s)
        return x if math.isfinite(x) else None
    return None
