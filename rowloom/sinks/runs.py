"""Runs: their rows, where they got to, their answers' cache, and archives of their files."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Answers kept, and how many are evicted at once (fixed values).
CACHE_ENTRIES, EVICT = 500, 50

CURSOR = "run_id string, step_index int, step_id string, saved_at timestamp, done boolean"


def save_rows(rows: DataFrame, root: str, run_id: str) -> None:
    """Append a run's rows; runs are partitions, so that reading one scans only its own."""
    rows.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").parquet(f"{root}/rows")


def read_rows(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/rows").where(F.col("run_id") == run_id).drop("run_id")


def save_cursor(spark: SparkSession, root: str, run_id: str, step_index: int, step_id: str, done: bool = False) -> None:
    """Note that a run has finished a top-level step (or all of it)."""
    one = spark.createDataFrame([(run_id, step_index, step_id, done)], "run_id string, step_index int, step_id string, done boolean")
    one.select("run_id", "step_index", "step_id", F.current_timestamp().alias("saved_at"), "done").coalesce(1).write.mode("append").parquet(f"{root}/cursors")


def incomplete_runs(cursors: DataFrame) -> DataFrame:
    """Runs with no cursor that says done, at the furthest step that each reached."""
    last = cursors.groupBy("run_id").agg(F.max(F.struct("step_index", "step_id", "saved_at")).alias("at"), F.bool_or("done").alias("done"))
    return last.where(~F.col("done")).select("run_id", "at.step_index", "at.step_id", "at.saved_at")


def cache_key(url: Column, fields: list[str], provider: Column, model: Column, base_url: Column, dom: Column) -> Column:
    """The key of a model's answer; the order in which fields were named does not matter."""
    parts = [F.coalesce(c, F.lit("")) for c in (url, F.lit(",".join(sorted(fields))), provider, model, base_url, dom)]
    return F.sha2(F.concat_ws(" ", *parts), 256)


def page_fingerprint(url: Column, html: Column) -> Column:
    """What tells one state of a page from another: its address and the length of its markup."""
    return F.sha2(F.concat_ws("|", F.coalesce(url, F.lit("")), F.coalesce(F.length(html), F.lit(0)).cast("string")), 256)


def evict(cache: DataFrame, last_used: str = "last_used", most: int = CACHE_ENTRIES, batch: int = EVICT, key: str = "key") -> DataFrame:
    """The cache with its oldest entries gone, a batch at a time, if it holds more than `most`; of equally old ones, the smallest keys go."""
    n = cache.count()
    if n <= most:
        return cache
    drop = -(-(n - most) // batch) * batch
    return cache.orderBy(F.col(last_used).desc(), F.col(key).desc()).limit(max(0, n - drop))


def merge_answers(known: DataFrame, new: DataFrame, key: str = "key", last_used: str = "last_used") -> DataFrame:
    """The newest answer of each key."""
    both = known.unionByName(new)
    newest = both.groupBy(key).agg(F.max(last_used).alias(last_used))
    return both.join(newest, [key, last_used], "left_semi").withColumn("__n", F.row_number().over(W.partitionBy(key).orderBy(F.lit(1)))).where("__n = 1").drop("__n")


def zip_store(files: dict[str, bytes]) -> bytes:
    """An archive without compression, for results small enough to be handed over as one file."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name in sorted(files):
            z.writestr(name, files[name])
    return out.getvalue()
