"""What loops and earlier steps give to later ones, as columns of a run's frames.

A frame is a table of the pages (or, before any page is open, just of the iterations) that a step works on. A loop binds
its items to the frame, one row an iteration, so that its body is one plan whatever the number of items; steps that
later templates refer to bind their results. Templates of a configuration become columns over those bindings; what a
step hands to a Python stage travels as an array of rendered texts.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.js import text_of
from rowloom.plans.templates import _TEMPLATE, _text, resolve_path
from rowloom.sources.pages import FILLED

#: The bindings: the item and counters of the innermost loop, the values of the last row of earlier extractions, results by
#: name (JSON texts), and the place in the run (numbers of loops and iterations, which sort as text).
ITEM, LOOP, EXTRACTED, STORED, AT = "_item", "_loop", "_extracted", "_stored", "_at"
BINDINGS = (ITEM, LOOP, EXTRACTED, STORED, AT)
LOOP_FIELDS = ("index", "index0", "first", "last", "count")

_MARK = "\x00{}\x00"
_MARKED = re.compile("\x00(\\d+)\x00")


def heads(value: object) -> set[str]:
    """The first names of all templates in a configuration."""
    if isinstance(value, str):
        return {keys(m[1])[0] for m in _TEMPLATE.finditer(value)}
    parts = value.values() if isinstance(value, dict) else value if isinstance(value, list) else ()
    return set().union(*map(heads, parts)) if parts else set()


def keys(path: str) -> list[str]:
    """The keys of a.b[0].1, as text."""
    out: list[str] = []
    for part in path.strip().split("."):
        m = re.fullmatch(r"(.+?)\[(\d+)\]", part)
        out += [m[1], m[2]] if m else [part]
    return out


def mark(value, templates: list[str]):
    """A copy of a configuration in which each text with templates is a mark, and its template in the list."""
    if isinstance(value, str) and _TEMPLATE.search(value):
        templates.append(value)
        return _MARK.format(len(templates) - 1)
    if isinstance(value, list):
        return [mark(v, templates) for v in value]
    if isinstance(value, dict):
        return {k: mark(v, templates) for k, v in value.items()}
    return value


def fill(value, rendered: list[str] | None):
    """The configuration with its marks replaced by the texts that a row has for them."""
    if not rendered:
        return value
    if isinstance(value, str):
        return _MARKED.sub(lambda m: rendered[int(m[1])], value) if "\x00" in value else value
    if isinstance(value, list):
        return [fill(v, rendered) for v in value]
    if isinstance(value, dict):
        return {k: fill(v, rendered) for k, v in value.items()}
    return value


def _json_path(parts: list[str]) -> str:
    return "$" + "".join(f"[{p}]" if p.isdigit() else "['" + p.replace("'", "") + "']" for p in parts)


def _below(text: Column, parts: list[str]) -> Column:
    return F.get_json_object(text, _json_path(parts)) if parts else text


def value(df: DataFrame, path: str, context: dict, scalars: dict[str, Column]) -> Column:
    """What a path holds in a row of a frame, as text; where it is not bound, in the context of the run; else empty."""
    head, *rest = keys(path)
    found: Column | None = None
    if head == "loop" and rest[:1] == ["current"]:
        head, rest = "item", rest[1:]
    if head == "item" and ITEM in df.columns:
        found = _below(F.try_element_at(F.col(ITEM), F.lit(rest[0])), rest[1:]) if rest else F.lit("")
    elif head == "loop" and LOOP in df.columns:
        kind = df.schema[LOOP].dataType
        found = text_of(F.col(LOOP)[rest[0]], kind[rest[0]].dataType.simpleString()) if len(rest) == 1 and rest[0] in LOOP_FIELDS else F.lit("")
    elif head == "extracted" and EXTRACTED in df.columns:
        found = _below(F.try_element_at(F.col(EXTRACTED), F.lit(rest[0])), rest[1:]) if rest else F.lit("")
        found = F.coalesce(found, _below(scalars[head], rest)) if rest and head in scalars else found
    elif head in scalars:
        found = _below(scalars[head], rest)
    elif head not in context and STORED in df.columns:
        found = _below(F.try_element_at(F.col(STORED), F.lit(head)), rest)
    if found is None:
        return F.lit(_text(resolve_path(context, path)))
    return F.coalesce(found, F.lit(""))


def column(df: DataFrame, template: str, context: dict, scalars: dict[str, Column]) -> Column:
    """A template over the rows of a frame."""
    pieces = [F.lit(p) if i % 2 == 0 else value(df, p, context, scalars) for i, p in enumerate(_TEMPLATE.split(template)) if p or i % 2]
    return F.concat(*pieces) if pieces else F.lit("")


def filled(df: DataFrame, config: dict, context: dict, scalars: dict[str, Column]) -> tuple[DataFrame, dict]:
    """The frame with the rendered texts of a configuration's templates, and the configuration with marks for them."""
    templates: list[str] = []
    marked = mark(config, templates)
    if not templates:
        return df.drop(FILLED), marked
    return df.withColumn(FILLED, F.array(*(column(df, t, context, scalars) for t in templates))), marked


def iterate(df: DataFrame, items: Column, number: int) -> DataFrame:
    """A row for each item of an array of maps, with the item, the counters of its loop and its place in the run."""
    n = F.size("__items")
    dealt = df.withColumn("__items", items).select("*", n.alias("__n"), F.posexplode("__items").alias("__i", "__item")).drop("__items")
    return counted(dealt, F.col("__item"), F.col("__i"), F.col("__n"), number).drop("__n", "__i", "__item")


def counted(df: DataFrame, item: Column, index0: Column, n: Column, number: int, place: Column | None = None) -> DataFrame:
    """df with the bindings of an iteration of the loop of this number. place: where it stands, if its number does not tell."""
    index0 = index0.cast("int")
    loop = F.struct((index0 + 1).alias("index"), index0.alias("index0"), (index0 == 0).alias("first"), (index0 + 1 == n).alias("last"), n.cast("int").alias("count"))
    return df.withColumns({ITEM: item, LOOP: loop, AT: at(df, number, F.lpad(index0.cast("string"), 8, "0") if place is None else place)})


def at(df: DataFrame, number: int, place: Column | None = None) -> Column:
    """The place of a step, or of an iteration of a loop, in the run."""
    above = [F.col(AT)] if AT in df.columns else []
    return F.concat(*above, F.lit(f"{number:06d}."), *([place, F.lit(".")] if place is not None else []))


def items_of(given: list) -> Column:
    """Items of a list as an array of maps: a text is its own value; numbers from 1 and 0 and a value and text are there for all."""
    maps = []
    for i, v in enumerate(given):
        row = v if isinstance(v, dict) else {"value": v}
        row = {str(k): _item_text(x) for k, x in row.items()}
        own = row.get("value", next(iter(row.values()), ""))
        maps.append({"index": str(i + 1), "index0": str(i), "value": own, "text": own} | row)
    import json

    return F.from_json(F.lit(json.dumps(maps, ensure_ascii=False)), "array<map<string,string>>")


def _item_text(x: object) -> str:
    import json

    return json.dumps(x, ensure_ascii=False) if isinstance(x, dict | list) else _text(x)


def items_in_json(text: Column) -> Column:
    """Items of a JSON text: its elements, or it alone where it is an object; an array of maps as from items_of."""
    listed = F.when(F.rlike(text, F.lit(r"^\s*\[")), F.from_json(text, "array<string>")).when(F.rlike(text, F.lit(r"^\s*\{")), F.array(text))

    def one(x: Column, i: Column) -> Column:
        row = F.coalesce(F.from_json(x, "map<string,string>"), F.create_map(F.lit("value"), x))
        row = F.when(F.rlike(x, F.lit(r"^\s*\{")), row).otherwise(F.create_map(F.lit("value"), x))
        own = F.coalesce(F.try_element_at(row, F.lit("value")), F.try_element_at(F.map_values(row), F.lit(1)), F.lit(""))
        base = F.create_map(F.lit("index"), (i + 1).cast("string"), F.lit("index0"), i.cast("string"), F.lit("value"), own, F.lit("text"), own)
        return merged(base, row)

    return F.transform(F.coalesce(listed, F.array().cast("array<string>")), one)


def merged(old: Column, new: Column) -> Column:
    """Two maps as one; of a key that both have, the new value."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)


def without_bindings(df: DataFrame) -> DataFrame:
    """The rows of a frame without what is bound to them, but for their place in the run."""
    return df.drop(*(c for c in (ITEM, LOOP, EXTRACTED, STORED, FILLED) if c in df.columns))
