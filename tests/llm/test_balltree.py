import hashlib
import math
import os
import random
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import assert_same  # noqa: E402

from rowloom.llm import balltree, registry  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_query_equals_oracle(spark):
    assert_same(registry.QUERIES["op13_centroid_clustering"](spark, SF), registry.ORACLES["op13_centroid_clustering"], SF)


def brute(rows, k, rounds, dims, seed=2):
    """Every vector against every centroid, in Python integers."""
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        own = {}
        for _, v in kept:
            own.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if n in own else c for n, c in enumerate(centroids)]
    out = [(i, nearest(v)) for i, v in kept]
    inertia = {n: sum(d for _, (d, m) in out if m == n) for n in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha[n]) for i, (d, n) in out), key=repr)


def run(df, **options):
    return sorted(map(tuple, balltree.with_inertia(*balltree.cluster(df, **options)).collect()), key=repr)


@pytest.mark.parametrize("case", ["clusters", "grid", "alike", "few"])
def test_small_tables_against_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(balltree, "LEAF_ROWS", 3)
    monkeypatch.setattr(balltree, "TREE_ROWS", 50)
    r = random.Random(case)
    make = {
        "clusters": lambda i: [i % 5 * 3.0 + r.gauss(0, 0.1) for _ in range(4)],
        "grid": lambda i: [float(r.randint(-1, 1)) for _ in range(4)],  # many ties
        "alike": lambda i: [0.5, -0.25, 0.0, 1.0] if i % 3 else [r.gauss(0, 9) for _ in range(4)],
        "few": lambda i: [r.random() - 1 for _ in range(4)],
    }[case]
    rows = [(i, make(i)) for i in range(4 if case == "few" else 300)]
    rows += [rows[0], (None, [0.1, 0.2, 0.3, 0.4]), (None, [0.1, -0.2, 0.3, 0.4]), (2000, None), (2001, []), (2002, [1.0] * 3), (2003, [1.0] * 5)]
    rows += [(2004, [1.0, None, 2.0, 3.0]), (2005, [1.0, float("nan"), 2.0, 3.0]), (2006, [1.0, float("inf"), 2.0, 3.0]), (2007, [-float("inf")] * 4)]
    df = spark.createDataFrame([(*x, "c", 1) for x in rows], "vec_id long, embedding array<float>, cluster string, `a.b` int").repartition(3)
    floats = [(i, v and [x if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert run(df, k=7, rounds=3, dims=4) == brute(floats, 7, 3, 4)


def test_whole_balls_are_assigned():
    rng = np.random.default_rng(1)
    points = (rng.normal(size=(3000, 8)) + 100 * rng.integers(0, 4, size=(3000, 1))).round().astype(np.int64)
    centroids = np.array([[100 * i] * 8 for i in range(4)])
    tree = balltree.BallTree.build(points)
    told = list(tree.assign(centroids, balltree._margin(points, centroids)))
    assert len(told) < 40 and sum(stop - start for node, start, stop, _ in told if node >= 0) > 2900
    cluster = np.empty(len(points), int)
    for _, start, stop, to in told:
        cluster[start:stop] = to
    assert (cluster == balltree.squared(tree.points, centroids).argmin(1)).all()
    assert sorted(tree.order.tolist()) == list(range(3000)) and (tree.points == points[tree.order]).all()
    for start, stop, _, radius in tree.nodes.tolist():
        own = tree.points[start:stop]
        assert np.sqrt(((own - own.mean(0)) ** 2).sum(1)).max() <= radius * (1 + 1e-12)


def test_large_components(spark):
    rows = [(i, [(-1) ** i * 400_000.0 + i, 3.5 * i]) for i in range(50)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert run(df, k=3, rounds=2, dims=2) == brute(rows, 3, 2, 2)
    with pytest.raises(Exception, match="too large"):
        balltree.cluster(spark.createDataFrame([(1, [1e9, 0.0])], df.schema), k=1, dims=2)


def test_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, [1.0])], "vec_id string, embedding array<float>")
    assert run(df) == run(df.limit(0)) == []
