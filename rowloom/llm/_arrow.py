"""Small helpers for Arrow-batched Python stages."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowloom.session import ship_package

#: Rows in one Arrow batch; long texts make batches large, so this stays well below Spark's default.
BATCH_ROWS = 1000


def map_arrow(df: DataFrame, function, schema: str) -> DataFrame:
    """df.mapInArrow with small batches; function takes and yields pyarrow RecordBatches. The executors get this package."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return df.mapInArrow(function, schema)


def col(name: str) -> Column:
    """The column of just this name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def without(columns: list[str], results: tuple[str, ...]) -> list[str]:
    """The columns that are not named like a result, in any letter case."""
    taken = {r.lower() for r in results}
    return [c for c in columns if c.lower() not in taken]


def set_aside(df: DataFrame, results: tuple[str, ...]) -> tuple[DataFrame, list[str]]:
    """df with columns named like a result under other names that no column has, in the same order; and all its names then."""
    taken = {c.lower() for c in df.columns} | {r.lower() for r in results}
    names = []
    for c in df.columns:
        name = c
        if c.lower() in {r.lower() for r in results}:
            while name.lower() in taken:
                name += "_"
            taken.add(name.lower())
        names.append(name)
    return df.toDF(*names), names


def texts(batch: pa.RecordBatch, column: str) -> list[str]:
    """A string column as Python strings, null as the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def with_columns(batch: pa.RecordBatch, drop: set[str], **columns: pa.Array) -> pa.RecordBatch:
    """The batch without the dropped columns, with new ones at the end."""
    kept = [n for n in batch.schema.names if n not in drop and n not in columns]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), *columns.values()], names=[*kept, *columns])


def one_pass(batches: Iterator[pa.RecordBatch], build) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            yield build(batch)
