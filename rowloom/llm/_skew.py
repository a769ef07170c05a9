"""Joins of a long table with a table of unique keys, of which one may be that of a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key that are one part, and keys that are parted at most: beyond so many there is no key of more than
#: a COMMON-th of all rows.
PART, COMMON = 100_000, 1000


def parted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """left, which is read twice, joined with right, which has one row for each key. The rows of the most frequent keys,
    found by a count, meet copies of their key's row in as many parts as they have PARTs of rows."""
    counts = left.groupBy(*on).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > PART)
    common = counts.orderBy(F.desc("__n")).limit(COMMON).select(*on, F.ceil(F.col("__n") / PART).cast("int").alias("__parts"))
    parts = F.coalesce("__parts", F.lit(1))
    dealt = right.join(F.broadcast(common), on, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    told = left.join(F.broadcast(common), on, "left").withColumn("__part", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("__parts")
    return told.join(dealt.hint("merge"), [*on, "__part"], how).drop("__part")
