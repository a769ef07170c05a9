"""A buffer for the rows of a run that come as a stream: flushed batch by batch, each batch once, with a cap.

Every micro-batch is a flush, so the trigger says how long rows wait and the source's own limits how many come at once. A
flush writes its rows and its counts into folders of the batch's number, overwriting them: a batch that is replayed after
a failure adds nothing. Rows beyond the cap of a run are dropped and counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rowloom.sinks.datasets import MOST_ROWS, dataset_name

#: How long rows wait for a flush, and how many one file of it holds (fixed values).
FLUSH_EVERY, FLUSH_ROWS = "30 seconds", 50

COUNTS = "rows bigint, dropped bigint"


def _folder(root: str, kind: str, run_id: str) -> str:
    return f"{root.rstrip('/')}/{kind}/{dataset_name(run_id)}"


def flushes(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    """batch, rows and dropped of each flush of a run."""
    try:
        found = spark.read.schema(COUNTS).option("basePath", _folder(root, "flushes", run_id)).parquet(_folder(root, "flushes", run_id) + "/batch=*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], f"batch bigint, {COUNTS}")
    return found.select(F.regexp_extract(F.col("_metadata.file_path"), r"batch=(\d+)/", 1).cast("long").alias("batch"), "rows", "dropped")


def buffered(spark: SparkSession, root: str, run_id: str, schema) -> DataFrame:
    """The rows of a run that have been flushed."""
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(_folder(root, "rows", run_id))


def flush(root: str, run_id: str, cap: int = MOST_ROWS, order: list[str] | None = None, file_rows: int = FLUSH_ROWS) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: write a batch's rows while the run has room for them, the first by order, and count both kinds."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = flushes(spark, root, run_id).where(F.col("batch") < number).agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
        given, room = batch.count(), max(0, cap - before)
        kept = batch if given <= room else (batch.orderBy(*order) if order else batch).limit(room)
        kept.write.mode("overwrite").option("maxRecordsPerFile", max(1, file_rows)).parquet(f"{_folder(root, 'rows', run_id)}/batch={number}")
        counts = spark.createDataFrame([(min(given, room), max(0, given - room))], COUNTS)
        counts.coalesce(1).write.mode("overwrite").parquet(f"{_folder(root, 'flushes', run_id)}/batch={number}")

    return write


def buffer_rows(
    stream: DataFrame, root: str, run_id: str, checkpoint: str, every: str | None = FLUSH_EVERY, cap: int = MOST_ROWS, order: list[str] | None = None, file_rows: int = FLUSH_ROWS
) -> StreamingQuery:
    """Buffer a stream's rows for a run; without a trigger time, what is there now is flushed and the query ends."""
    writer = stream.writeStream.foreachBatch(flush(root, run_id, cap, order, file_rows)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
