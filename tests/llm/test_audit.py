import os
import re
import sys
from collections import Counter
from itertools import permutations

import pytest

sys.path.insert(0, os.path.dirname(__file__))
from oracle import assert_same  # noqa: E402

from rowloom.llm import audit, registry  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_query_equals_oracle(spark):
    assert_same(registry.QUERIES["op12_filter_audit"](spark, SF), registry.ORACLES["op12_filter_audit"], SF)


def failed(rows):
    """The letters of each row, condition by condition."""
    out = []
    for i, text, _ in rows:
        t = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
        out.append(
            "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t))
            + "D" * any(c in "#$%&*|" for c in t) + "E" * (i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in rows))
        )
    return out


def brute(rows, labels):
    """Apply the filters one after the other, in every order."""
    masks = failed(rows)
    good, toxic = ({i for i, *l in labels if l[k] == 1 and i is not None} for k in (0, 1))
    out, shapley = {}, Counter()
    for part in {p or "" for *_, p in rows}:
        own = [(i, m) for (i, _, p), m in zip(rows, masks, strict=True) if (p or "") == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                fails = [x for x in own if f in x[1]]
                shapley[part, f] += len(gone)
                out[part, order, step] = [
                    len(left), len(gone), len(fails) - len(gone), sum(x[1] == f for x in fails), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone),
                ]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


LONG = " ".join(f"w{i}" for i in range(3000))
ROWS = [
    (1, "a b c", "en"), (2, "a b c", None), (3, "a b  c", "en"), (4, None, "en"), (5, "", "de"), (6, LONG, "en"), (7, LONG, ""), (8, LONG[:-1] + "x", "en"),
    (9, "x" + LONG[1:], "en"), (10, LONG[:300] + "#" + LONG[301:], "en"), (11, "WORDS IN CAPITALS", "fr"), (12, "same " * 200, "fr"), (12, "same " * 200, "fr"),
    (13, "same " * 200, "fr"), (None, "a b c", "en"), (None, "only | null", None), (14, "é\x0bü\x1cz", "en"), (0, "only | null", "fr"), (3, "a b c", "fr"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, None, None), (6, 0, 1), (7, 1, None), (13, 1, 0), (13, 0, 1), (None, 1, 1), (99, 1, 1), (8, 1, 0)]


@pytest.mark.parametrize("sent", [200_000, 0])
def test_small_tables_against_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(audit, "SENT", sent)
    monkeypatch.setattr(audit, "COMMON", 2)
    docs = spark.createDataFrame([(*r, "x", 1) for r in ROWS], "doc_id long, text string, lang string, `a.b` string, `Part` int").repartition(3)
    labels = spark.createDataFrame([(*r, 0) for r in LABELS], "doc_id long, quality int, toxic int, Good int")
    got = audit.interactions(audit.failure_counts(docs, labels)).collect()
    want = brute(ROWS, LABELS)
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    assert {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got} == want
    assert len(got) == len(want) == 600 * 4


def test_copies_against_brute_force(spark, monkeypatch):
    for sent in (200_000, 0):
        monkeypatch.setattr(audit, "SENT", sent)
        df = spark.createDataFrame([r[:2] for r in ROWS] + [(100 + i, "hot") for i in range(500)], "doc_id long, text string").repartition(5)
        got = sorted(r.id for r in audit.later_copies(df).collect())
        assert got == sorted({i for (i, *_), m in zip(ROWS, failed(ROWS), strict=True) if "E" in m}) + list(range(101, 600))


def test_equal_hashes_do_not_make_copies(spark, monkeypatch):
    """Texts are compared in full, also where all block hashes agree."""
    real = audit.F.xxhash64
    monkeypatch.setattr(audit.F, "xxhash64", lambda *c: audit.F.lit(7).cast("long") if len(c) == 1 else real(*c))
    df = spark.createDataFrame([(1, "aa"), (2, "bb"), (3, "aa"), (4, "bb"), (5, "cc"), (6, "a")], "doc_id long, text string")
    assert sorted(r.id for r in audit.later_copies(df).collect()) == [3, 4]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audit.interactions(audit.failure_counts(docs, labels)).count() == 0
    one = spark.createDataFrame([(1, "x", "en")], docs.schema)
    assert audit.interactions(audit.failure_counts(one, labels)).where("good_lost + toxic_lost > 0").count() == 0
