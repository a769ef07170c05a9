"""Row numbers over a whole table, without one task that sees all of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.session import cut_lineage


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with its rows numbered from 0 in an order: ranges of the order are numbered each for itself, and start after all
    rows of the ranges before. Rows of equal order get different numbers, in no certain order."""
    spread = cut_lineage(df.repartitionByRange(F.col(order)).withColumn("__range", F.spark_partition_id()), "numbered")
    before = W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)
    sizes = spread.groupBy("__range").agg(F.count(F.lit(1)).alias("__n"))
    starts = sizes.select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    here = F.row_number().over(W.partitionBy("__range").orderBy(order)) - 1
    return spread.withColumn("__here", here).join(starts, "__range").withColumn(name, F.col("__start") + F.col("__here")).drop("__range", "__here", "__start")
