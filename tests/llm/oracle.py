"""Runs a DuckDB oracle over a folder of tables and compares it with a Spark result."""

import glob
import os

import duckdb


def oracle_rows(sql, sf_dir):
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    rel = db.execute(sql)
    names = [c[0] for c in rel.description]
    return sorted((tuple(v for _, v in sorted(zip(names, row, strict=True))) for row in rel.fetchall()), key=repr), sorted(names)


def spark_rows(df):
    names = sorted(df.columns)
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr), names


def assert_same(df, sql, sf_dir):
    got, want = spark_rows(df), oracle_rows(sql, sf_dir)
    assert got[1] == want[1]
    assert len(got[0]) == len(want[0])
    for a, b in zip(got[0], want[0], strict=True):
        assert a == b
