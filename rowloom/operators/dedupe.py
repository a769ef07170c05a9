"""Keyed deduplication: keep the first row of each key."""

from __future__ import annotations

import json
from collections import OrderedDict
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.functions.js import collapse, text_of
from rowloom.session import ship_package

SEPARATOR, ABSENT, NULL = "\u001f", "\u001fundef", "\u001fnull"
SEEN_LIMIT = 100_000


def parse_fields(text: str | None) -> list[str]:
    return [f.strip() for f in (text or "").split(",") if f.strip()]


def row_key(df: DataFrame, fields: list[str] | None = None) -> Column:
    """The key of a row: absent, null, structures as JSON, else text with white space collapsed and lower-cased."""
    types = dict(df.dtypes)
    parts = []
    for name in fields or sorted(df.columns):
        if name not in types:
            parts.append(F.lit(ABSENT))
            continue
        text = text_of(F.col(f"`{name}`"), types[name])
        flat = text if types[name].startswith(("struct", "array", "map")) else F.lower(collapse(text))
        parts.append(F.when(F.col(f"`{name}`").isNull(), NULL).otherwise(flat))
    return F.concat_ws(SEPARATOR, *parts)


def export_key(df: DataFrame) -> Column:
    """A row as the JSON text of its [column, value] pairs, by column: what tells whether two stores hold the same row."""
    pairs = (F.concat(F.lit(f"[{json.dumps(c)},"), F.substr(F.to_json(F.array(F.col(f"`{c}`")), {"ignoreNullFields": "false"}), F.lit(2))) for c in sorted(df.columns))
    return F.concat(F.lit("["), F.concat_ws(",", *pairs), F.lit("]"))


def map_row_key(row: Column, fields: list[str]) -> Column:
    """The same key for rows held as MAP<STRING, STRING>, where absent and null are two facts."""
    part = lambda name: F.when(~F.map_contains_key(row, name), ABSENT).when(row[name].isNull(), NULL).otherwise(F.lower(collapse(row[name])))
    return F.concat_ws(SEPARATOR, *map(part, fields))


def keep_first(df: DataFrame, order: str, fields: list[str] | None = None, after: Column | None = None) -> DataFrame:
    """The first row by order, which no two rows share, of each key; rows for which `after` is false pass the gate untouched.

    The first place of each key is an aggregate with map-side combine, so a key that a third of all rows have is
    cheap. Rows join the places alone: keys are made once, and only for the aggregate.
    """
    key = F.sha2(row_key(df.drop(order), fields), 256)
    if after is not None:
        key = F.when(after, key).otherwise(F.concat(F.lit("pass-"), F.col(order).cast("string")))
    first = df.withColumn("__key", key).groupBy("__key").agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi").select(*df.columns)


def first_rows(df: DataFrame, order: str, fields: list[str] | None = None) -> DataFrame:
    """The same where rows may share their place: one row of each key, in one aggregate of whole rows."""
    keyed = df.withColumn("__key", F.sha2(row_key(df.drop(order), fields), 256))
    row = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    return keyed.groupBy("__key").agg(F.min_by(row, order).alias("__row")).select("__row.*")


def keep_unseen(df: DataFrame, order: str, seen: DataFrame, fields: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Deduplication against keys of earlier runs (one column, key): the rows to keep, and the keys to remember."""
    kept = keep_first(df, order, fields).withColumn("__key", F.sha2(row_key(df.drop(order), fields), 256))
    new = kept.join(seen.select(F.col("key").alias("__key")), "__key", "left_anti")
    return new.select(*df.columns), seen.select("key").unionByName(new.select(F.col("__key").alias("key")))


#: No value of a column equals it.
NOTHING = object()


def matching(df: DataFrame, other: DataFrame, columns: list[str], how: str) -> DataFrame:
    """A semi or anti join in which nulls match each other, as they do in groupBy."""
    there = other.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(columns)))
    return df.join(there, reduce(and_, (F.col(c).eqNullSafe(F.col(f"__{i}")) for i, c in enumerate(columns))), how)


def in_order(df: DataFrame, partition: str, order: str, replay) -> DataFrame:
    """replay over Arrow batches in which each partition value's rows stand together, in order: a task holds a batch, not a group.

    A null is a value like any other; rows without a place come last. Rows are dealt by a hash of the value. By the value
    itself, the exchange would be left out after a join on it, and a join's rows may be dealt anew when it runs (skewed keys
    are split, broadcasts read locally).
    """
    ship_package(df.sparkSession)
    return df.repartition(F.xxhash64(partition)).sortWithinPartitions(F.col(partition), F.col(order).asc_nulls_last()).mapInArrow(replay, df.schema)


class SeenKeys:
    """Keys in the order first seen, at most limit of them: the oldest goes when a new one comes, repeats do not refresh."""

    def __init__(self, limit: int = SEEN_LIMIT, initial=()):
        self.limit, self.keys, self.forgotten = max(1, limit or SEEN_LIMIT), OrderedDict(), 0
        for k in initial:
            self.add(k)

    def add(self, key: str) -> bool:
        if key in self.keys:
            return False
        self.keys[key] = None
        if len(self.keys) > self.limit:
            self.keys.popitem(last=False)
            self.forgotten += 1
        return True


def keep_bounded(df: DataFrame, order: str, fields: list[str], limit: int, partition: str) -> DataFrame:
    """keep_first with a memory of `limit` keys for each partition value, exactly as a bounded queue forgets.

    Where a partition has no more than limit distinct keys nothing is forgotten, and it takes keep_first's path; only
    the others go through a sequential pass, which the definition (what was forgotten when) demands.
    """
    keyed = df.withColumn("__key", F.sha2(row_key(df.select(*[c for c in fields if c in df.columns]), fields), 256))
    distinct = keyed.groupBy(partition, "__key").agg(F.min(order).alias("__first"))
    crowded = distinct.groupBy(partition).count().where(F.col("count") > limit).select(partition)
    firsts = distinct.withColumnRenamed("__first", order)
    free = matching(matching(keyed, crowded, [partition], "left_anti"), firsts, [partition, "__key", order], "left_semi")

    def replay(batches):
        memory, at = SeenKeys(limit), NOTHING
        for b in batches:
            kept = []
            for group, key in zip(b.column(partition).to_pylist(), b.column("__key").to_pylist(), strict=True):
                if group != at:
                    memory, at = SeenKeys(limit), group
                kept.append(memory.add(key))
            yield b.filter(pa.array(kept, pa.bool_()))

    full = in_order(matching(keyed, crowded, [partition], "left_semi"), partition, order, replay)
    return free.select(*keyed.columns).unionByName(full).drop("__key")


def first_by_window(df: DataFrame, order: str, key: Column) -> DataFrame:
    """The window form, for keys known to be small groups."""
    return df.withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(order))).where("__n = 1").drop("__n")
