"""Sharding by extendible hashing, in DataFrame operations only.

A row's shard is a prefix of its hash bits. The directory starts with the empty prefix; a bucket over the byte limit
splits on its next bit, and only such buckets do, until every one fits. The directory is settled from below: the bytes
of a fine grid of prefixes are pre-aggregated, added up STEP_BITS depths at a time as long as anything fits, and every
prefix of the grid takes the least depth at which its bucket fits. Buckets that the grid does not settle go on to all
HASH_BITS bits. Rows find their leaf in a broadcast of the leaves, up to LEAVES_SENT of them; beyond, by a join.

Rows that are alike in id and text have the same hash and cannot be split by it. Where they exceed the limit together,
they are dealt into sub-shards (prefix#part-number) by running sums within each partition of the input, so that they are
never gathered; the parts' numbers are those of the input's partitions.

Edge cases: a row larger than the limit gets a shard of its own; null ids and texts hash and count as empty ones;
an empty table gives an empty one; columns named like the results are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.llm._arrow import col, without
from rowloom.llm._skew import parted_join
from rowloom.session import cut_lineage

HASH_BITS = 60
LIMIT_BYTES = 1 << 20

#: The grid is so many bits deeper than shards of even size would be.
SPARE_BITS = 4
#: Depths that are settled together, and leaves (a few dozen bytes each) that are sent to every executor at most.
STEP_BITS, LEAVES_SENT = 4, 200_000

RESULT = ("n_bytes", "shard", "depth", "shard_bytes")


def hash_bits(*columns: Column) -> Column:
    """The first 60 bits of the MD5 of the columns, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def _fits(limit: int) -> Column:
    return (F.col("shard_bytes") <= limit) | (F.col("rows") == 1)


def _settle(cells: DataFrame, low: int, high: int, limit: int, step: int) -> DataFrame:
    """For each cell (a prefix of `high` bits, with bytes and n rows): the least depth from low to high that fits, or null, and its bytes.

    `step` depths are settled at a time, from the finest up, so a prefix is never summed over more than 2^step cells.
    A prefix fits only if its parts do, so the way up ends where no prefix fits any more.
    """
    at, out = high, None
    while True:
        least = max(low, at - step)
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(least), F.lit(at)))).withColumn("prefix", F.expr(f"shiftright(cell, {at} - depth)"))
        sums = cut_lineage(levels.groupBy("depth", "prefix").agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("rows")), "shard-sums")
        leaf = levels.select("cell", "depth", "prefix").join(sums.where(_fits(limit)), ["depth", "prefix"]).groupBy("cell").agg(F.min(F.struct("depth", "shard_bytes")).alias("leaf"))
        if out is None:
            out = cells.select("cell").join(leaf, "cell", "left")
        else:
            above = leaf.select(F.col("cell").alias("__up"), F.col("leaf").alias("__leaf"))
            out = out.withColumn("__up", F.shiftright("cell", high - at)).join(above, "__up", "left").select("cell", F.coalesce("__leaf", "leaf").alias("leaf"))
        top = sums.where(F.col("depth") == least)
        if least == low or top.where(_fits(limit)).isEmpty():
            return out
        cells, at = top.select(F.col("prefix").alias("cell"), F.col("shard_bytes").alias("bytes"), F.col("rows").alias("n")), least


def _placed(rows: DataFrame, directory: DataFrame, grid: int) -> DataFrame:
    """rows with their leaf (null where the directory has not settled them): by a broadcast of the leaves where those
    are few, otherwise by a join on the cell."""
    depth = F.coalesce("leaf.depth", F.lit(grid))
    leaves = cut_lineage(directory.select(depth.alias("__depth"), F.expr(f"shiftright(cell, {grid} - coalesce(leaf.depth, {grid}))").alias("__prefix"), "leaf").distinct(), "shard-leaves")
    if leaves.count() > LEAVES_SENT:
        return rows.withColumn("cell", F.shiftright("__hash", HASH_BITS - grid)).join(directory, "cell").drop("cell")
    depths = [r[0] for r in leaves.select("__depth").distinct().collect()]
    tried = rows.withColumn("__depth", F.explode(F.array(*map(F.lit, depths)) if depths else F.lit(None).cast("array<int>"))).withColumn("__prefix", F.expr(f"shiftright(__hash, {HASH_BITS} - __depth)"))
    return tried.join(F.broadcast(leaves), ["__depth", "__prefix"]).drop("__depth", "__prefix")


def shard(df: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of df, then n_bytes (of the text), shard (a string of bits), depth and shard_bytes."""
    kept = without(df.columns, RESULT)
    own = [f"k{i}" for i in range(len(kept))]
    size, text_hash = F.coalesce(F.octet_length(col(text_col)), F.lit(0)).cast("long"), hash_bits(col(id_col), col(text_col))
    rows = df.select(*(col(c).alias(k) for c, k in zip(kept, own, strict=True)), size.alias("n_bytes"), text_hash.alias("__hash"), F.spark_partition_id().alias("__input"))
    return _shards(rows, own, limit).toDF(*kept, *RESULT)


def _shards(rows: DataFrame, own: list[str], limit: int) -> DataFrame:
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    grid = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + SPARE_BITS)
    count = (F.sum("n_bytes").alias("bytes"), F.count(F.lit(1)).alias("n"))
    cell = F.shiftright("__hash", HASH_BITS - grid)
    cells = cut_lineage(rows.groupBy(cell.alias("cell")).agg(*count), "shard-cells")
    directory = cut_lineage(_settle(cells, 0, grid, limit, STEP_BITS), "shard-directory")
    placed = _placed(rows, directory, grid)
    bits = lambda value, width: F.lpad(F.bin(value), width, "0")
    name = F.when(F.col("leaf.depth") > 0, F.substr(bits(F.col("__hash"), HASH_BITS), F.lit(1), F.col("leaf.depth"))).otherwise("")
    columns = [*own, "n_bytes"]
    out = placed.where("leaf IS NOT NULL").select(*columns, name.alias("shard"), F.col("leaf.depth").alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes"))
    if directory.where("leaf IS NULL").limit(1).count() == 0:
        return out
    deep = placed.where("leaf IS NULL").drop("leaf")
    whole = cut_lineage(deep.groupBy(F.col("__hash").alias("cell")).agg(*count), "shard-cells")
    leaves = cut_lineage(_settle(whole, grid + 1, HASH_BITS, limit, HASH_BITS), "shard-deep")
    deep = parted_join(deep.withColumn("cell", F.col("__hash")).withColumnRenamed("__input", "__from"), leaves, ["cell"]).withColumnRenamed("__from", "__part")
    split = deep.where("leaf IS NOT NULL").select(*columns, name.alias("shard"), F.col("leaf.depth").alias("depth"), F.col("leaf.shard_bytes").alias("shard_bytes"))
    alike = deep.where("leaf IS NULL").withColumn("__of", F.greatest(F.lit(1), F.floor(limit / F.greatest(F.col("n_bytes"), F.lit(1)))))
    number = F.floor((F.row_number().over(W.partitionBy("cell", "__part").orderBy("n_bytes")) - 1) / F.col("__of"))
    alike = alike.withColumn("shard", F.concat(bits(F.col("cell"), HASH_BITS), F.lit("#"), F.col("__part"), F.lit("-"), number))
    alike = alike.withColumn("shard_bytes", F.sum("n_bytes").over(W.partitionBy("shard")))
    return out.unionByName(split).unionByName(alike.select(*columns, "shard", F.lit(HASH_BITS).alias("depth"), "shard_bytes"))


def write_shards(df: DataFrame, path: str, **options) -> None:
    """Write df as Parquet, one folder a shard."""
    shard(df, **options).repartition("shard").write.partitionBy("shard").parquet(path)


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
e AS (SELECT rn, doc_id, n_bytes, h, unnest(generate_series(0, 60)) AS depth FROM d),
s AS (SELECT depth, h >> (60 - depth) AS prefix, sum(n_bytes)::BIGINT AS shard_bytes FROM e GROUP BY ALL HAVING sum(n_bytes) <= 1048576 OR count(*) = 1),
l AS (
  SELECT rn, doc_id, n_bytes, h, min(s.depth) AS depth, min_by(s.shard_bytes, s.depth) AS shard_bytes
  FROM e JOIN s ON s.depth = e.depth AND s.prefix = e.h >> (60 - e.depth) GROUP BY ALL)
SELECT doc_id, n_bytes, CASE WHEN depth > 0 THEN substr(lpad(bin(h), 60, '0'), 1, CAST(depth AS INT)) ELSE '' END AS shard, CAST(depth AS INT) AS depth, shard_bytes
FROM l
"""
