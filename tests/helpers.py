"""Runs oracles over a folder of tables and compares them with Spark results."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.01"


def oracle_rows(sql, sf_dir=SF):
    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    done = db.execute(sql)
    names = [c[0] for c in done.description]
    return names, done.fetchall()


def normal(names, rows):
    order = sorted(range(len(names)), key=names.__getitem__)
    fix = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted((tuple(fix(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql, sf_dir=SF):
    names, rows = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    got, want = normal(df.columns, df.collect()), normal(names, rows)
    assert len(got) == len(want), (len(got), len(want))
    for a, b in zip(got, want, strict=True):
        assert a == b
    return len(got)
