import hashlib
import os
import sys
from collections import defaultdict

sys.path.insert(0, os.path.dirname(__file__))
from oracle import assert_same  # noqa: E402

from rowloom.llm import registry, sharding  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_query_equals_oracle(spark):
    got = registry.QUERIES["op10_sharding"](spark, SF)
    assert got.select("shard").distinct().count() > 1
    assert_same(got, registry.ORACLES["op10_sharding"], SF)


def brute(rows, limit):
    """Split by recursion from the empty prefix."""
    hashed = [(int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16), i, len((t or "").encode())) for i, t in rows]
    out = []

    def split(part, prefix):
        if sum(n for *_, n in part) <= limit or len(part) == 1 or len(prefix) == 60:
            out.extend((i, n, prefix) for _, i, n in part)
            return
        for bit in "01":
            here = [x for x in part if f"{x[0]:060b}"[len(prefix)] == bit]
            if here:
                split(here, prefix + bit)

    split(hashed, "")
    return sorted(out, key=repr)


def test_small_shards_against_brute_force(spark, monkeypatch):
    rows = [(i, "é" * (i * 7 % 90)) for i in range(300)] + [(500, "x" * 5000), (501, None), (None, ""), (None, "null id")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, shard string")
    for limit, sent in ((400, 200_000), (400, 0), (3000, 200_000), (10**9, 200_000), (1, 5)):
        monkeypatch.setattr(sharding, "LEAVES_SENT", sent)
        got = sorted(((r.doc_id, r.n_bytes, r.shard) for r in sharding.shard(df, limit).collect()), key=repr)
        assert got == brute(rows, limit)


def test_alike_rows_over_the_limit(spark):
    df = spark.createDataFrame([(1, "same text")] * 50 + [(2, "other"), (3, None)], "doc_id long, text string").repartition(3)
    got = sharding.shard(df, 40).collect()
    size = defaultdict(int)
    for r in got:
        size[r.shard] += r.n_bytes
    assert len(got) == 52 and max(size.values()) <= 40 and all(r.shard_bytes == size[r.shard] for r in got)
    assert sharding.shard(df.limit(0)).count() == 0


def test_write_shards_keeps_all_rows_in_their_shards(spark, tmp_path):
    df = spark.createDataFrame([(i, "x" * (i % 40), "c") for i in range(200)] + [(None, None, "d")], "doc_id long, text string, `a.b` string")
    sharding.write_shards(df, f"{tmp_path}/out", limit=300)
    back = spark.read.option("recursiveFileLookup", "false").schema("doc_id long, text string, `a.b` string, n_bytes long, depth int, shard_bytes long, shard string").parquet(f"{tmp_path}/out").collect()
    want = {(r.doc_id, r.shard) for r in sharding.shard(df, 300).collect()}
    assert len(back) == 201 and {(r.doc_id, None if r.shard == "__HIVE_DEFAULT_PARTITION__" else r.shard) for r in back} == want
    size = defaultdict(int)
    for r in back:
        size[r.shard] += r.n_bytes
    assert max(size.values()) <= 300


def test_few_large_rows_settle_above_the_grid(spark):
    rows = [(i, "y" * 1000) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_bytes, r.shard) for r in sharding.shard(df, 1).collect()), key=repr) == brute(rows, 1)


def test_alike_rows_stay_where_they_are_read(spark, monkeypatch):
    """Also where the join with the leaves is a shuffle, equal rows are never gathered in one task."""
    monkeypatch.setattr(sharding, "LEAVES_SENT", 0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(1, "same text")] * 600, "doc_id long, text string").repartition(6)
        names = [r.shard for r in sharding.shard(df, 90).collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(names) == 600 and len({n.partition("#")[2].partition("-")[0] for n in names}) == 6
