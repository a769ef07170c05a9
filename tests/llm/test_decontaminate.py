import os
import sys

sys.path.insert(0, os.path.dirname(__file__))
from oracle import assert_same  # noqa: E402

from rowloom.llm import decontaminate as dc  # noqa: E402
from rowloom.llm import registry  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_query_equals_oracle(spark):
    got = registry.QUERIES["op5_decontamination"](spark, SF)
    assert got.where("contaminated").count() > 0
    assert_same(got, registry.ORACLES["op5_decontamination"], SF)


def test_blocks_give_the_same_as_one_broadcast(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    one = dc.decontamination_digest(dc.find_benchmark(docs, bench))
    many = dc.decontamination_digest(dc.find_benchmark(docs, bench, block_chars=20_000, piece_words=15))
    assert one.exceptAll(many).count() == 0 and many.exceptAll(one).count() == 0


def test_edge_rows_spans_and_documents(spark):
    long = "zz " * 50_000
    phrase = "The quick brown fox jumps over the lazy dog again today"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, f"A {phrase}! end", 0), (3, f"A {phrase}! end", 0), (None, long + "Kurz, Wort! x", 0), (5, "quick brown fox", 0)], "doc_id long, text string, n_words int")
    bench = spark.createDataFrame([(1, phrase), (2, "kurz wort"), (None, "kurz"), (4, None), (5, "?!")], "item_id long, text string")
    rows = dc.decontamination_digest(dc.find_benchmark(docs, bench)).collect()
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r.n_items) for r in rows) == [(0, 50003, 2, 2), (1, 0, 0, 0), (2, 0, 0, 0), (3, 13, 11, 1), (3, 13, 11, 1), (5, 3, 0, 0)]
    cut = {r.doc_id: r.text for r in dc.decontaminate(docs, bench, "spans").collect()}
    assert cut[3] == "A ! end" and cut[5] == "quick brown fox" and cut[1] is None and cut[None].endswith("zz ! x")
    assert sorted(r.doc_id for r in dc.decontaminate(docs, bench).collect()) == [1, 2, 5]
    assert dc.find_benchmark(docs.limit(0), bench).count() == 0
    assert dc.decontaminate(docs, bench.limit(0)).count() == 6


def test_windows_that_many_items_share(spark):
    shared = "one two three four five six seven eight nine ten"
    bench = spark.createDataFrame([(i, f"{shared} item{i} " * 3) for i in range(3000)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x {shared} y"), (2, "one two three"), (3, f"{shared} item7 one two")], "doc_id long, text string")
    got = {r.doc_id: (r.n_hit, r.n_items) for r in dc.decontamination_digest(dc.find_benchmark(docs, bench)).collect()}
    assert got == {1: (10, 3000), 2: (0, 0), 3: (13, 3000)}


def test_pieces_hold_every_window():
    for n in (0, 1, 9, 10, 11, 35, 60):
        found = [b"w%d" % i for i in range(n)]
        windows = {tuple(found[k : k + 10]) for k in range(max(1, n - 9))} if n else set()
        got = {tuple(w[k : k + length]) for length, p in dc.pieces(found, 10, 20) for w in [p.split(b" ")] for k in range(len(w) - length + 1)}
        assert got == windows


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "q", "r")], "doc_id long, text string, N_words int, k1 string, `x.y` string")
    bench = spark.createDataFrame([(1, "zz")], "item_id long, text string")
    got = dc.decontaminate(docs, bench)
    assert got.columns == docs.columns and [tuple(r) for r in got.collect()] == [tuple(docs.first())]
    assert [tuple(r) for r in dc.decontaminate(docs, bench, "spans").collect()] == [tuple(docs.first())]
