"""Grounding of extracted values in the page's text, their provenance, and judging learnt selectors."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.js import WS, collapse
from rowloom.functions.transforms import number

MIN_GROUNDABLE = 4
PROVEN = ("exact", "number", "parts", "url")
MAX_SELECTOR = 300

#: Characters folded before matching (fixed values): spaces, single quotes, double quotes, dashes.
_FOLD_FROM = "\u00a0\u2007\u202f" + "\u2018\u2019\u201b" + "\u201c\u201d" + "\u2010\u2011\u2012\u2013\u2014\u2015"
_FOLD_TO = "   " + "'''" + '""' + "------"
_CURRENCY = "".join(re.escape(chr(c)) for c in range(0x110000) if unicodedata.category(chr(c)) == "Sc")


def normalise(c: Column) -> Column:
    return F.lower(collapse(F.translate(F.coalesce(c, F.lit("")), _FOLD_FROM, _FOLD_TO)))


def numbers_in(c: Column) -> Column:
    """ARRAY<DOUBLE>: every number that a text states."""
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(rf"(-?[0-9][0-9.,{WS}]*[0-9]|-?[0-9])"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(runs, number), lambda x: x.isNotNull()))


def corpus(c: Column) -> Column:
    """STRUCT<text, numbers>: what groundings of one page share; keep it as a column."""
    return F.struct(normalise(c).alias("text"), numbers_in(c).alias("numbers"))


def _numeric_only(c: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(c, f"[{_CURRENCY}{WS}%+]", ""), "[,.']", "")
    return F.rlike(bare, F.lit(r"^-?[0-9]+\z"))


def ground(value: Column, page: Column) -> Column:
    """How a value is borne out by a page's corpus: exact, url, number, parts, unproven or missing (which is not)."""
    needle, text = normalise(value), page["text"]
    path = normalise(F.coalesce(F.regexp_extract(value, r"(?i)^https?://[^/?#]*([^?#]*)", 1), F.lit("")))
    parts = F.filter(F.transform(F.split(value, rf"[{WS}]*[,;|][{WS}]*"), normalise), lambda p: F.length(p) >= MIN_GROUNDABLE)
    short = F.length(needle) < MIN_GROUNDABLE
    return (
        F.when(value.isNull() | (needle == ""), "exact")
        .when(F.contains(text, needle), F.when(short, "unproven").otherwise("exact"))
        .when((path != "") & (path != "/") & F.contains(text, path), "url")
        .when(_numeric_only(value) & F.coalesce(F.array_contains(page["numbers"], number(value)), F.lit(False)), "number")
        .when((F.size(parts) > 1) & F.forall(parts, lambda p: F.contains(text, p)), "parts")
        .when(short, "unproven")
        .otherwise("missing")
    )


def grounded(value: Column, how: Column) -> Column:
    """The value, or null where nothing bears it out."""
    return F.when(how != "missing", value)


def describe_source(source: Column) -> Column:
    """STRUCT<kind, detail, label, trust> of a source such as meta:og:title (only the first colon counts)."""
    raw = F.coalesce(source, F.lit("none"))
    named = F.regexp_extract(raw, "^([^:]*)", 1)
    detail = F.regexp_extract(raw, "(?s)^[^:]*:(.*)$", 1)
    detail = F.when(detail != "", detail)
    kind = F.when(named.isin("meta", "og-meta"), "meta").when(named.isin("json-ld", "microdata", "heuristic", "llm"), named).otherwise("none")
    with_detail = lambda words: F.when(detail.isNotNull(), F.concat(F.lit(f"{words} ("), detail, F.lit(")"))).otherwise(words)
    label = (
        F.when(kind == "json-ld", with_detail("the page's own JSON-LD")).when(kind == "microdata", "the page's own microdata").when(kind == "meta", with_detail("a meta tag"))
        .when(kind == "heuristic", "a guess from the page's markup").when(kind == "llm", "a model").otherwise("nothing answered")
    )
    trust = F.when(kind == "none", "none").when(kind == "llm", "model").otherwise("free")
    return F.struct(kind.alias("kind"), detail.alias("detail"), label.alias("label"), trust.alias("trust"))


def provenance(field: str, value: Column, confidence: Column, source: Column, how: Column) -> Column:
    """A field's record; only a model's value that the page bears out is verified."""
    s = describe_source(source)
    by_model = s["trust"] == "model"
    verified = F.coalesce(by_model & how.isin(*PROVEN), F.lit(False))
    note = F.when(verified, F.concat(F.lit("found in the page text ("), how, F.lit(")"))).when(by_model & (how == "unproven"), "too short to prove either way — kept, not proven").otherwise("")
    return F.struct(
        F.lit(field).alias("field"), value.alias("value"), s["kind"].alias("kind"), s["detail"].alias("detail"), s["label"].alias("label"), s["trust"].alias("trust"),
        F.coalesce(confidence, F.lit(0)).cast("int").alias("confidence"), verified.alias("verified"), note.alias("note"),
    )


def provenance_column(records: Column) -> Column:
    """field=kind(detail):confidence verified; ..."""

    def one(r: Column) -> Column:
        source = F.when(r["detail"].isNotNull(), F.concat(r["kind"], F.lit("("), r["detail"], F.lit(")"))).otherwise(r["kind"])
        confidence = F.when(r["trust"] == "none", "").otherwise(F.concat(F.lit(":"), r["confidence"].cast("string")))
        return F.concat(r["field"], F.lit("="), source, confidence, F.when(r["verified"], " verified").otherwise(""))

    return F.regexp_replace(F.array_join(F.transform(records, one), "; "), rf"[{WS}]*\n[{WS}]*", " ")


def provenance_summary(records: Column) -> Column:
    n = lambda trust: F.size(F.filter(records, lambda r: r["trust"] == trust))
    verified = F.size(F.filter(records, lambda r: r["verified"]))
    free = F.when(n("free") > 0, F.concat(n("free").cast("string"), F.lit(" from the page")))
    model = F.when(n("model") > 0, F.concat(n("model").cast("string"), F.lit(" from a model"), F.when(verified > 0, F.concat(F.lit(" ("), verified.cast("string"), F.lit(" verified)"))).otherwise("")))
    empty = F.when(n("none") > 0, F.concat(n("none").cast("string"), F.lit(" empty")))
    joined = F.concat_ws(", ", free, model, empty)
    return F.when(joined == "", "nothing extracted.").otherwise(F.concat(joined, F.lit(".")))


def weighted_confidence(confidences: dict[str, Column], weights: dict[str, int]) -> Column:
    """Weighted mean of the fields' confidences, rounded half up."""
    total = sum(weights.get(f, 0) for f in confidences)
    if not total:
        return F.lit(0)
    weighted = sum((F.coalesce(c, F.lit(0)) * weights.get(f, 0) for f, c in confidences.items()), F.lit(0))
    return F.floor(weighted / total + 0.5).cast("int")


def coverage(values: list[Column]) -> Column:
    """The share of fields that have an answer, in percent, rounded half up."""
    answered = sum((F.when(v.isNotNull() & (v.cast("string") != ""), 1).otherwise(0) for v in values), F.lit(0))
    return F.floor(answered * 100 / max(1, len(values)) + 0.5).cast("int")


def is_fragile(selector: Column) -> Column:
    """A selector by position rather than identity."""
    s = F.coalesce(selector, F.lit(""))
    identifies = F.rlike(s, F.lit(r"[.#\[]|:not\(|(?<![0-9A-Za-z_])data-"))
    steps = F.size(F.filter(F.split(s, rf"[{WS}]*[>+~{WS}][{WS}]*"), lambda p: p != ""))
    return (s == "") | (~identifies & (F.rlike(s, F.lit(":nth-|:first-child|:last-child")) | (steps >= 4)))


def judge_selector(selector: Column, expected: Column, count: Column, text: Column, error: Column) -> Column:
    """verified, wrong-value, not-found, ambiguous or bad-selector; null where there is nothing to check against."""
    s = collapse(selector)
    return (
        F.when(s.isNull() | (s == "") | expected.isNull() | (expected == ""), None).when((F.length(s) > MAX_SELECTOR) | error.isNotNull(), "bad-selector")
        .when(F.coalesce(count, F.lit(0)) == 0, "not-found").when(count > 1, "ambiguous").when(normalise(text) != normalise(expected), "wrong-value").otherwise("verified")
    )


#: The verdicts of a selector, from best to worst.
STATUSES = ("verified", "wrong-value", "ambiguous", "not-found", "bad-selector")


def selector_history(seen: DataFrame, keys: list[str], selector: str = "selector", status: str = "status") -> DataFrame:
    """From judged observations: for each selector of each field (keys), how often each verdict was given. Histories of
    parts of the runs add up to that of all."""
    counts = [F.count_if(F.col(status) == s).alias(s.replace("-", "_")) for s in STATUSES]
    return seen.where(F.col(status).isNotNull()).groupBy(*keys, selector).agg(*counts)


def merge_histories(a: DataFrame, b: DataFrame, keys: list[str], selector: str = "selector") -> DataFrame:
    """The history of the runs of both."""
    return a.unionByName(b).groupBy(*keys, selector).agg(*(F.sum(s.replace("-", "_")).alias(s.replace("-", "_")) for s in STATUSES))


def learnt_selectors(history: DataFrame, keys: list[str], selector: str = "selector", least: int = 1) -> DataFrame:
    """The selector that each field is best read by: of those that were verified at least so often and are right more often
    than not, one by identity before one by position, then the one right most often, then by text. One aggregate."""
    total = sum((F.col(s.replace("-", "_")) for s in STATUSES), F.lit(0))
    right = history.withColumns({"runs": total, "fragile": is_fragile(F.col(selector))}).where((F.col("verified") >= least) & (2 * F.col("verified") > F.col("runs")))
    # Exact: shares are compared as parts in a billion, rounded down.
    share = F.floor(F.col("verified") * 1_000_000_000 / F.col("runs")).cast("long")
    best = F.min(F.struct("fragile", (-share).alias("share"), (-F.col("runs")).alias("more"), F.col(selector).alias("selector"), "verified", "runs")).alias("best")
    return right.groupBy(*keys).agg(best).select(*keys, F.col("best.selector").alias(selector), "best.fragile", "best.verified", "best.runs")
