"""Personal data in rows: types and columns are reported, never values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.js import NOT_AFTER_WORD, NOT_BEFORE_WORD, WORD_EDGE, WS

#: Patterns by type (fixed values), with ASCII word boundaries.
PATTERNS = {
    "SSN": rf"{NOT_AFTER_WORD}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{NOT_BEFORE_WORD}",
    "CreditCard-Visa": rf"{NOT_AFTER_WORD}4[0-9]{{12}}(?:[0-9]{{3}})?{NOT_BEFORE_WORD}",
    "CreditCard-Mastercard": rf"{NOT_AFTER_WORD}5[1-5][0-9]{{14}}{NOT_BEFORE_WORD}",
    "CreditCard-Amex": rf"{NOT_AFTER_WORD}3[47][0-9]{{13}}{NOT_BEFORE_WORD}",
    "Email": r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}",
    "Phone": rf"{WORD_EDGE}(\+[0-9]{{1,3}})?[{WS}.-]?\(?[0-9]{{3}}\)?[{WS}.-]?[0-9]{{3}}[{WS}.-]?[0-9]{{4}}{NOT_BEFORE_WORD}",
}
LIMIT = 50


def _found(c: Column, name: str) -> Column:
    """Whether a type is found; cheap tests of what every match has come first."""
    sure = F.contains(c, F.lit("@")) if name == "Email" else F.rlike(c, F.lit("[0-9]{4}"))
    return sure & F.rlike(c, F.lit(PATTERNS[name]))


def types_in(c: Column) -> Column:
    """ARRAY<STRING> of the types found in a text, in the patterns' order."""
    return F.filter(F.array(*(F.when(_found(c, name), F.lit(name)) for name in PATTERNS)), lambda x: x.isNotNull())


def has_pii(columns: list[Column]) -> Column:
    out = F.lit(False)
    for c in columns:
        for name in PATTERNS:
            out = out | F.coalesce(_found(c.cast("string"), name), F.lit(False))
    return out


def scan_rows(df: DataFrame, order: str, limit: int | None = LIMIT) -> DataFrame:
    """(row_index, field, type): findings by row, then column, then pattern; the first `limit` of them, or all."""
    fields = [c for c in df.columns if c != order]
    per_field = [F.struct(F.lit(i).alias("at"), F.lit(c).alias("field"), types_in(F.col(f"`{c}`").cast("string")).alias("types")) for i, c in enumerate(fields)]
    cells = df.select(F.col(order).alias("row_index"), F.explode(F.array(*per_field)).alias("cell")).where(F.size("cell.types") > 0)
    found = cells.select("row_index", "cell.at", "cell.field", F.posexplode("cell.types").alias("n", "type"))
    if limit is not None:
        found = found.orderBy("row_index", "at", "n").limit(limit)
    return found.select("row_index", "field", "type")


def counts_by_type(df: DataFrame, columns: list[str]) -> DataFrame:
    """(type, n): cells in which each type was found; one pass with map-side sums."""
    types = F.explode(F.flatten(F.array(*(F.coalesce(types_in(F.col(f"`{c}`").cast("string")), F.array().cast("array<string>")) for c in columns))))
    return df.select(types.alias("type")).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def run_warning(rows: DataFrame, columns: list[str] | None = None) -> str | None:
    """One line on the personal data in a run's rows, or None: an aggregate over all of them, said once a run."""
    names = columns or [c for c in rows.columns if not c.startswith("_")]
    found = {r.type: r.n for r in counts_by_type(rows, names).collect()}
    return summary({t: found[t] for t in PATTERNS if t in found}) if found else None


def summary(counts: dict[str, int]) -> str:
    if not counts:
        return "no personal data"
    return ", ".join(f"{n} of {t}" for t, n in counts.items())
