"""Named append-only datasets: rows survive runs; a cap's overflow is counted."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.session import cut_lineage, discard
from rowloom.sinks.render import APPENDABLE, write_document

MOST_ROWS = 200_000
NAME_LENGTH = 60


def dataset_name(name: object) -> str:
    """A name that is safe as a folder; an empty one is "default"."""
    kept = "".join(c if c.isalpha() or c.isnumeric() or c in " ._-" else "_" for c in str("" if name is None else name))
    return re.sub(r"^[.\s]+|[.\s]+$", "", kept)[:NAME_LENGTH].strip() or "default"


def safe_segment(c: Column) -> Column:
    """One path segment from page-supplied text: separators and dot parts flattened, unsafe characters replaced, 100 characters at most."""
    parts = F.filter(F.split(F.coalesce(c, F.lit("")), r"[\\/]"), lambda p: ~p.isin("", ".", ".."))
    clean = F.regexp_replace(F.array_join(parts, "_"), r"[^\p{L}\p{N} ._()\[\]{}@#&+,;'!~=%-]", "_")
    return F.substr(F.regexp_replace(F.regexp_replace(clean, r"^[.\s]+", ""), r"[.\s]+\z", ""), F.lit(1), F.lit(100))


def append(df: DataFrame, root: str, name: str, cap: int = MOST_ROWS, order: str | None = None, batches: bool = False) -> dict[str, int]:
    """Add rows to a dataset up to its cap, the first by order where one is given; returns rows added, dropped and in all.
    batches: rows have a _batch, the number of rows that were there before them."""
    spark, path = df.sparkSession, f"{root}/{dataset_name(name)}"
    staged = cut_lineage(df, "append")
    here, given = count(spark, root, name), staged.count()
    added = max(0, min(given, cap - here))
    if added:
        kept = staged if added == given else (staged.orderBy(order) if order else staged).limit(added)
        kept = kept.withColumn("_batch", F.lit(here).cast("long")) if batches else kept
        kept.write.mode("append").parquet(path)
    discard(staged)
    return {"added": added, "dropped": given - added, "total": here + added}


def clear(spark: SparkSession, root: str, name: str) -> None:
    """Forget a dataset's rows."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/{dataset_name(name)}")
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.option("mergeSchema", "true").parquet(f"{root}/{dataset_name(name)}")


def count(spark: SparkSession, root: str, name: str) -> int:
    from pyspark.errors import AnalysisException

    try:
        return read(spark, root, name).count()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return 0
        raise


def export_appended(df: DataFrame, root: str, name: str, fmt: str, path: str, order: str | None = None) -> dict[str, int]:
    """Append, then write the whole dataset as the one document at path: run after run, each in its order."""
    if fmt not in APPENDABLE:
        raise ValueError(f"{fmt} cannot be appended to; use one of {', '.join(APPENDABLE)}")
    done = append(df, root, name, order=order, batches=order is not None)
    rows = read(df.sparkSession, root, name)
    if order:
        place = F.concat(F.lpad(F.coalesce("_batch", F.lit(0)).cast("string"), 20, "0"), F.coalesce(F.col(f"`{order}`").cast("string"), F.lit("")))
        rows = rows.withColumn("__place", place).drop("_batch", order)
    write_document(rows, fmt, path, "overwrite", "__place" if order else None)
    return done


def listing(rows: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Rows of each dataset, by name, for datasets kept as one table."""
    return rows.groupBy(dataset).agg(F.count(F.lit(1)).alias("rows")).orderBy(dataset)


def capped(rows: DataFrame, dataset: str, order: str, cap: int) -> DataFrame:
    """The first cap rows of each dataset by order, for datasets kept as one table."""
    return rows.withColumn("__n", F.row_number().over(W.partitionBy(dataset).orderBy(order))).where(F.col("__n") <= cap).drop("__n")


def merge_stores(results: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """All of this run's rows, and the stored ones whose key it does not have, once each; duplicates of the run stay."""
    return results.unionByName(stored.dropDuplicates([key]).join(results.select(key), key, "left_anti").select(*results.columns))
