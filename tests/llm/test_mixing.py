import hashlib
import heapq
import math
import os
import random
import sys
from collections import Counter
from fractions import Fraction

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import assert_same  # noqa: E402

from rowloom.llm import mixing, registry  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_query_equals_oracle(spark):
    assert_same(registry.QUERIES["op6_mixing"](spark, SF), registry.ORACLES["op6_mixing"], SF)


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    room, out, rest = Fraction(3, 2) * sum(sizes.values()), {}, set(names)
    while rest:
        level = room / sum(weight[s] for s in rest)
        above = {s for s in rest if level * weight[s] > 2 * sizes[s]}
        if not above:
            return out | {s: level * weight[s] for s in rest}
        out |= {s: Fraction(2 * sizes[s]) for s in above}
        room -= sum(2 * sizes[s] for s in above)
        rest -= above
    return out


def brute_mix(rows, shard_blocks, block_words=16):
    """From (id, text, source): words of each row that the mix takes and words of each shard and source, block by block."""
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = brute_targets(sizes)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    width = {s: math.ceil(sizes[s] / math.ceil(sizes[s] / block_words)) if sizes[s] else 1 for s in names}
    blocks = {s: math.ceil(sizes[s] / width[s]) for s in names}
    worth = {s: float(want[s]) / width[s] for s in names}
    house = min(math.floor(sum(worth.values()) + 0.5), 2 * sum(blocks.values()))
    # Seat after seat to the highest quotient.
    queue = [(-worth[s], i, 1, s) for i, s in enumerate(names) if blocks[s]]
    heapq.heapify(queue)
    shards = [Counter() for _ in range(max(1, math.ceil(house / shard_blocks)))]
    for seat in range(house):
        _, i, j, s = heapq.heappop(queue)
        shards[seat // shard_blocks][s] += 1
        if j < 2 * blocks[s]:
            heapq.heappush(queue, (-worth[s] / (2 * j + 1), i, j + 1, s))
    words_of, taken = {}, Counter()
    for s in names:
        n, total = blocks[s], sum(q[s] for q in shards)
        copies, left = divmod(total, n) if n else (0, 0)
        length = lambda j: min(width[s], sizes[s] - j * width[s])  # noqa: B023, E731
        times, before, whole = [copies] * n, 0, 0
        for k, q in enumerate(shards, 1):
            upto = before + q[s]
            a, b = (before * left // total, upto * left // total) if total else (0, 0)
            first, end = (-(-n * a // left), -(-n * b // left)) if left else (0, 0)
            m, r = end - first, b - a
            start = int(hashlib.md5(f"mix-1:{'null' if s is None else '=' + s}:{k}".encode()).hexdigest()[:12], 16) % max(1, m)
            chosen = [j for j in range(m) if (j + start + 1) * r // m > (j + start) * r // m]
            assert len(chosen) == r
            for j in chosen:
                times[first + j] += 1
            wholes = range(whole, whole + (upto - before) - r)
            words_of[k, s] = sum(length(first + j) for j in chosen) + sum(length(f % n) for f in wholes)
            whole, before = wholes.stop, upto
        order = sorted((hashlib.md5(f"mix-1:{'' if i is None else i}".encode()).hexdigest(), len((t or "").split()), hashlib.md5((t or "").encode()).hexdigest(), str(i)) for i, t, x in rows if x == s)
        at = 0
        for _, size, _, i in order:
            taken[s, i, size, sum(times[w // width[s]] for w in range(at, at + size))] += 1
            at += size
    return want, taken, words_of


def test_edge_rows_against_brute_force(spark):
    rows = [(i, "w " * (i % 50), s, 1) for i, s in enumerate(["b"] * 300 + ["a"] * 40 + ["é"] * 20 + [None] * 30 + ["tiny"])]
    rows += [(1000, None, "a", 1), (1001, "", None, 1), (None, "x y", "b", 1), (7, "r r r", "b", 1), (7, "r r r", "b", 1), (2000, "long\t" * 40000, "c", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    plain = [r[:3] for r in rows]
    for shard_blocks, bucket_rows, hot_rows in ((4096, 2000, 50_000), (50, 3, 2), (700, 1000, 10), (333, 1, 1)):
        got = mixing.mix(df.repartition(7), shard_blocks=shard_blocks, bucket_rows=bucket_rows, hot_rows=hot_rows).collect()
        want, taken, words_of = brute_mix(plain, shard_blocks)
        assert Counter((r.source, str(r.doc_id), r.size, r.taken) for r in got) == taken
        words, whole = Counter(), Counter()
        for r in got:
            assert abs(r.target - want[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r.size and sum(x.words for x in r.shards) == r.taken
            whole[r.source] += r.taken
            for x in r.shards:
                words[x.shard, r.source] += x.words
        assert all(words[k] == n for k, n in words_of.items())
        assert all(abs(whole[s] - want[s]) <= 2.5 * mixing.BLOCK_WORDS for s in want)
    assert mixing.mix(df.limit(0)).count() == 0
    assert {r.taken for r in mixing.mix(df.where("text IS NULL")).collect()} == {0}
    copies = mixing.mixed_documents(df)
    assert copies.columns == df.columns and copies.where("text IS NULL OR text = ''").count() == 0


def test_what_is_taken_depends_on_the_shards(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    few, many = ({r.doc_id: r.taken for r in mixing.mix(docs, shard_blocks=n).select("doc_id", "taken").collect()} for n in (1 << 20, 100))
    assert few.keys() == many.keys() and sum(few[i] != many[i] for i in few) > 100
    assert abs(sum(few.values()) - sum(many.values())) < 100


def test_seats_go_to_the_highest_quotients(spark, monkeypatch):
    r = random.Random(8)
    for n in (1, 3, 40):
        worth = [r.choice((0.0, 0.3, 5.0, 900.0)) * r.random() for _ in range(n)]
        rows = [(str(i), i, w, 2 * math.ceil(w) + r.randrange(2)) for i, w in enumerate(worth)]
        df = spark.createDataFrame(rows, "__source string, place long, worth double, cap long")
        for size in (1000, 7):
            upto = {(x.place, x.shard): x.upto for x in mixing.seats(df, size).collect()}
            house = min(math.floor(sum(worth) + 0.5), sum(x[3] for x in rows))
            best = sorted((-w / (2 * j - 1), i, j) for _, i, w, cap in rows for j in range(1, min(cap, house) + 1))
            for k in range(1, max(1, math.ceil(house / size)) + 1):
                given = Counter(i for _, i, _ in best[: min(house, k * size)])
                assert all(upto[i, k] == given[i] for i in range(n))


def test_many_sources_and_large_blocks(spark, monkeypatch):
    rows = [(i, "w " * (20 + i % 30), f"s{i % 60}") for i in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    whole = sorted(map(tuple, mixing.mix(df, shard_blocks=40).select("doc_id", "taken").collect()))
    monkeypatch.setattr(mixing, "SENT", 0)
    assert sorted(map(tuple, mixing.mix(df, shard_blocks=40).select("doc_id", "taken").collect())) == whole
    monkeypatch.setattr(mixing, "MOST_BLOCKS", 100)
    got = mixing.mix(df)
    assert got.agg({"taken": "sum"}).first()[0] == pytest.approx(1.5 * sum(20 + i % 30 for i in range(600)), rel=0.2)


def test_one_id_of_many_rows_and_clashing_names(spark):
    rows = [(None, "same words here", "a", 1, 2)] * 30 + [(None, "w " * (i % 9), "a", 1, 2) for i in range(40)] + [(5, "x y z", "b", 1, 2)] * 20
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, Taken int, `k0.x` int").repartition(5)
    few, many = (mixing.mixed_documents(df, hot_rows=n) for n in (10**6, 4))
    assert few.columns == many.columns == df.columns
    sizes = {"a": 90 + sum(i % 9 for i in range(40)), "b": 60}
    want = brute_targets(sizes)
    for out in (few, many):
        words = Counter()
        for r in out.collect():
            words[r.source] += len(r.text.split())
        assert all(abs(words[s] - want[s]) <= 2.5 * mixing.BLOCK_WORDS + 8 for s in sizes)
