"""Name similarity and schema mapping."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.functions.js import trim

#: Fixed values of the field vocabulary.
DEFAULT_FIELDS = ("name", "price", "originalPrice", "currency", "brand", "description", "sku", "availability", "rating", "reviewCount", "images")
PRODUCT_WEIGHTS = {"name": 30, "price": 25, "images": 15, "brand": 10, "description": 10, "sku": 5, "availability": 5}
MATCH_THRESHOLD, MAX_FIELDS = 0.62, 40
#: The keys under which a nested value says what it is, in order.
NAMING_KEYS = ("name", "@value", "value", "text", "url", "@id")

_NAME = re.compile(r"[A-Za-z][A-Za-z0-9 _.-]{0,60}\Z")


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length, of lower-cased trimmed texts; 1 for two empty ones."""
    a, b = trim(F.lower(a)), trim(F.lower(b))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longest)


def tokens(c: Column) -> Column:
    """Distinct lower-cased words: camelCase is cut, then white space and punctuation."""
    spaced = F.regexp_replace(F.coalesce(c, F.lit("")), "([a-z])([A-Z])", "$1 $2")
    parts = F.transform(F.split(spaced, r"[\s_\-./\\\[\]()+,;:]+"), lambda w: F.lower(w))
    return F.array_distinct(F.filter(parts, lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays; 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def token_coverage(wanted: Column, signal: Column) -> Column:
    """The share of the wanted tokens that the signal has."""
    n = F.size(wanted)
    return F.when(n == 0, 0.0).otherwise(F.size(F.array_intersect(wanted, signal)) / n)


def field_match_score(name: Column, signal: Column, coverage: bool = False) -> Column:
    parts = [jaccard(tokens(name), tokens(signal)), levenshtein_similarity(name, signal)]
    return F.greatest(*parts, *([token_coverage(tokens(name), tokens(signal))] if coverage else []))


def parse_schema(text: object) -> tuple[list[str], bool, list[str]]:
    """Field names of a comma or line list: (fields, whether they are the defaults, rejected entries)."""
    entries = list(text) if isinstance(text, list | tuple) else re.split(r"[,\n]", str(text or ""))
    fields, rejected, seen = [], [], set()
    for entry in entries:
        name = str(entry or "").strip()
        if not name or (_NAME.match(name) and name.lower() in seen):
            continue
        if not _NAME.match(name):
            rejected.append(name)
            continue
        seen.add(name.lower())
        (fields if len(fields) < MAX_FIELDS else rejected).append(name)
    return (fields, False, rejected) if fields else (list(DEFAULT_FIELDS), True, rejected)


def weights_for(fields: list[str], is_default: bool) -> dict[str, int]:
    return dict(PRODUCT_WEIGHTS) if is_default else dict.fromkeys(fields, 1)


def map_to_schema(keys: Column, fields: list[str], usable: Column | None = None) -> Column:
    """ARRAY<STRUCT<field, key>>: for each field, in order, the key that answers it, or null.

    A key of the same name (ignoring case) wins; else the most similar one from MATCH_THRESHOLD up, the first of
    equals. A key answers one field only, and is not used up by a field that it gave no usable value (usable: the
    keys with a value, by default all).
    """
    usable = keys if usable is None else usable
    start = F.struct(F.array().cast("array<string>").alias("taken"), F.array().cast("array<struct<field:string,key:string>>").alias("out"))

    def step(state: Column, field: Column) -> Column:
        free = F.filter(keys, lambda k: ~F.startswith(k, F.lit("@")) & ~F.array_contains(state["taken"], k))
        exact = F.try_element_at(F.filter(free, lambda k: F.lower(k) == F.lower(field)), F.lit(1))
        scored = F.transform(free, lambda k, i: F.struct(field_match_score(field, k).alias("score"), (-i).alias("place"), k.alias("key")))
        best = F.array_max(scored)
        chosen = F.coalesce(exact, F.when(best["score"] >= MATCH_THRESHOLD, best["key"]))
        key = F.when(F.array_contains(usable, chosen), chosen)
        taken = F.when(key.isNotNull(), F.array_append(state["taken"], key)).otherwise(state["taken"])
        return F.struct(taken.alias("taken"), F.array_append(state["out"], F.struct(field.alias("field"), key.alias("key"))).alias("out"))

    return F.aggregate(F.array(*map(F.lit, fields)), start, step)["out"]


def schema_rows(rows: DataFrame, json: str, fields: list[str], sent: int = 10_000) -> DataFrame:
    """rows with the fields' values (texts; nested ones as JSON) out of a column of JSON objects, whatever their keys are called.

    Records of one source have few sets of keys: each distinct set, with what of it holds a value, is mapped once, and the
    mappings are joined back, by a broadcast up to `sent` of them. A null, or no object, has no values.
    """
    held = F.from_json(F.col(json), "map<string,string>")
    usable = F.filter(F.map_keys("__row"), lambda k: F.coalesce(trim(F.try_element_at("__row", k)), F.lit("")) != "")
    keyed = rows.withColumn("__row", F.coalesce(held, F.create_map().cast("map<string,string>"))).withColumns({"__keys": F.map_keys("__row"), "__usable": usable})
    sets = keyed.select("__keys", "__usable").distinct()
    mapped = sets.withColumn("__map", F.map_from_entries(F.filter(map_to_schema(F.col("__keys"), fields, F.col("__usable")), lambda m: m["key"].isNotNull())))
    few = sets.limit(sent + 1).count() <= sent
    joined = keyed.join(F.broadcast(mapped) if few else mapped, ["__keys", "__usable"])
    values = {f: F.try_element_at("__row", F.try_element_at("__map", F.lit(f))) for f in fields}
    return joined.withColumns(values).drop("__row", "__keys", "__usable", "__map")
