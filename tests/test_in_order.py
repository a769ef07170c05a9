"""Sequential passes must see each group whole and in order, however the join before them is run."""

import os
import sys
from contextlib import contextmanager
from functools import reduce

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]
from helpers import compare  # noqa: E402

from rowloom.operators.dedupe import keep_bounded  # noqa: E402
from rowloom.plans.catalogue import ORACLES, QUERIES  # noqa: E402
from rowloom.streaming.pacing import cap_captures  # noqa: E402

#: Joins are planned by sorting; as they run, adaptive execution may make broadcasts of them.
TURNED = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}


@contextmanager
def settings(spark, conf):
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


@pytest.fixture(scope="module")
def rows(spark, tmp_path_factory):
    """One user with most rows, in eight files."""
    path = str(tmp_path_factory.mktemp("events") / "rows")
    ids = spark.range(0, 4000, 1, 8).withColumn("user", F.when(F.col("id") % 10 < 8, 1).otherwise(F.col("id") % 7))
    ids.select(F.col("id"), "user", (F.xxhash64("id") % 11).cast("string").alias("kind"), (F.col("id") * 31 % 23).alias("size")).repartition(8).write.parquet(path)
    return spark.read.parquet(path)


def deals_before_replay(df):
    """Whether an exchange of its own comes after the join: the join's is lost where it turns into a broadcast."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.index("MapInArrow") < plan.find("REPARTITION_BY_COL") < plan.rindex("LeftSemi")


def test_bounded_memory(spark, rows):
    want, known = set(), {}
    for r in rows.orderBy("id").collect():
        memory = known.setdefault(r.user, [])
        if r.kind not in memory:
            want.add(r.id)
            memory.append(r.kind)
            del memory[:-3]
    with settings(spark, TURNED):
        kept = keep_bounded(rows, "id", ["kind"], 3, "user")
        assert deals_before_replay(kept)
        got = [r.id for r in kept.collect()]
    assert sorted(got) == sorted(want)


def test_capture_caps(spark, rows):
    want, used = set(), {}
    for r in rows.orderBy("id").collect():
        n, size = used.get(r.user, (0, 0))
        if n < 40 and size + r.size <= 300:
            want.add(r.id)
            used[r.user] = n + 1, size + r.size
    with settings(spark, TURNED):
        kept = cap_captures(rows, "user", "id", "size", most=40, most_bytes=300)
        assert deals_before_replay(kept)
        got = [r.id for r in kept.collect()]
    assert sorted(got) == sorted(want)


@pytest.fixture(scope="module")
def without_values(spark, tmp_path_factory):
    """Rows of no user, more than any limit here, and rows without a place, which come last."""
    path = str(tmp_path_factory.mktemp("without") / "rows")
    ids = spark.range(0, 600, 1, 4).select(F.when(F.col("id") % 40 != 3, F.col("id")).alias("id"), F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("user"), F.col("id").alias("n"))
    ids.select("id", "user", (F.xxhash64("n") % 5).cast("string").alias("kind"), F.when(F.col("id").isNull(), 1).otherwise(F.col("n") % 7).alias("size")).write.parquet(path)
    return spark.read.parquet(path)


def in_place(rows):
    return sorted(rows.collect(), key=lambda r: (r.id is None, r.id))


def test_captures_of_no_run_have_caps_too(spark, without_values):
    want, used = [], {}
    for r in in_place(without_values):
        n, size = used.get(r.user, (0, 0))
        if n < 20 and size + r.size <= 50:
            want.append((r.user, r.id, r.size))
            used[r.user] = n + 1, size + r.size
    got = [(r.user, r.id, r.size) for r in cap_captures(without_values, "user", "id", "size", most=20, most_bytes=50).collect()]
    assert None in {u for u, _, _ in got} and sorted(got, key=repr) == sorted(want, key=repr)


def test_captures_without_a_place_come_last_but_stay(spark, without_values):
    got = cap_captures(without_values, "user", "id", "size", most=198, most_bytes=10_000).collect()
    assert len(got) == 3 * 198 and sum(r.id is not None for r in got) == without_values.where("id IS NOT NULL").count()


def test_rows_of_no_partition_have_a_memory(spark, without_values):
    placed = without_values.where("id IS NOT NULL")
    for limit in (2, 100):
        want, known = [], {}
        for r in in_place(placed):
            memory = known.setdefault(r.user, [])
            if r.kind not in memory:
                want.append((r.user, r.id))
                memory.append(r.kind)
                del memory[:-limit]
        got = [(r.user, r.id) for r in keep_bounded(placed, "id", ["kind"], limit, "user").collect()]
        assert None in {u for u, _ in got} and sorted(got, key=repr) == sorted(want, key=repr)


def test_missed_windows_rounds_and_orders_as_its_sql(spark, tmp_path):
    """Runs a fraction of a millisecond from whole hours, at and before 1970, and alike in time with and without an id."""
    start, hours = "TIMESTAMP_NTZ'{}' + make_dt_interval(0, 3 * CAST(id AS INT), 0, (id * 137 % 19 - 9) * 0.00025)", []
    for user, at in enumerate(("2024-01-01", "1969-12-31", "1960-01-01", "9990-01-01")):
        hours.append(spark.range(400).selectExpr(f"id + {user} * 1000 AS event_id", f"{start.format(at)} AS ts", f"CAST({user} AS LONG) AS user_id"))
    hours.append(spark.range(9).selectExpr("id + 9000 AS event_id", "TIMESTAMP_NTZ'1969-12-31 12:00:00' + make_dt_interval(0, 6 * CAST(id AS INT)) AS ts", "9L AS user_id"))
    hours.append(spark.range(40).selectExpr("IF(id % 2 = 0, NULL, id + 9500) AS event_id", "TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(CAST(id AS INT) DIV 2) AS ts", "10L AS user_id"))
    reduce(lambda a, b: a.unionByName(b), hours).write.parquet(f"{tmp_path}/events.parquet")
    os.rename(f"{tmp_path}/events.parquet", f"{tmp_path}/parts")
    pq.write_table(pq.read_table(f"{tmp_path}/parts"), f"{tmp_path}/events.parquet")
    assert compare(QUERIES["missed_windows"](spark, str(tmp_path)), ORACLES["missed_windows"], str(tmp_path)) == 1649
