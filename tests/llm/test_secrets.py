import os
import random
import re
import sys

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, os.path.dirname(__file__))
from oracle import assert_same  # noqa: E402

from rowloom.llm import registry, secrets  # noqa: E402

SF = "/root/testdata/sf0.01"
NO_MODEL = [0] * len(secrets.ALPHABET) ** 2


def test_query_equals_oracle(spark):
    assert_same(registry.QUERIES["op11_secret_scan"](spark, SF), registry.ORACLES["op11_secret_scan"], SF)


def brute(text, model):
    """Spans by regular expressions, one match after the other."""
    t, out = text or "", []
    assign = r"""((?:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    blank = list(t)
    for m in re.finditer(assign, t, re.I | re.A):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
            blank[m.start() : m.end()] = " " * (m.end() - m.start())
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    k = secrets.ALPHABET.index
    for m in re.finditer("[A-Za-z0-9+/_-]{16,}={0,2}", "".join(blank)):
        run = m[0]
        if re.search("AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", run):
            continue
        if sum(model[k(a) * 67 + k(b)] for a, b in zip(run, run[1:], strict=False)) >= max(10_000, 1000 * len(run)):
            out.append((m.start(), 3, m.end()))
    return [(a, secrets.KINDS[k], b) for a, k, b in sorted(out)]


@pytest.fixture(scope="module")
def model(spark):
    return secrets.train(secrets.labelled_samples(spark.read.parquet(f"{SF}/documents.parquet")))


def found(spark, texts, model):
    df = spark.createDataFrame([(i, t, "c", 2) for i, t in enumerate(texts)], "doc_id long, text string, `a.b` string, Spans int")
    rows = secrets.secret_spans(df, model).collect()
    for r in rows:
        assert all((texts[r.id] or "")[s.start : s.end].replace(" ", "") == s.match.replace(" ", "") for s in r.spans)
    return {r.id: [(s.start, s.kind, s.end) for s in r.spans] for r in rows}


RANDOM = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY"
CASES = [
    None, "", " ", "token = abcdef", "token=abcde", 'API_KEY": "x1.y2=z3"', "ApiKey:aaaaaa passwd = \"bbbbbb\"", "secret=token = abcdefgh", "ſecret=abcdefgh toKen=abcdefgh",
    "AKIA" + "A1" * 8, "AKIAAKIAAKIAAKIAAKI", "xAKIA" + "B2" * 30 + "c", "0123456789abcdef01234567", "0123456789abcdef0123456", "é" * 30 + "deadbeef" * 4 + "\U0001f600 " + "deadbeef" * 4,
    f"é́ {RANDOM} x", f"key={RANDOM}== token: {RANDOM}", "a" * 40, "_" * 40, "internationalization_of_the_words", f"{RANDOM}{'deadbeef' * 4}", "token=" * 30, "\x00token=\x01abcdef",
]


def test_cases_against_brute_force(spark, model):
    got = found(spark, CASES, model)
    assert got == {i: brute(t, model) for i, t in enumerate(CASES)}
    assert any(k == "random" for s in got.values() for _, k, _ in s)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["token", "SECRET", "api_key", "=", ":", " ", '"', "'", "AKIA", "ABCDEFGH12345678", "deadbeef", "abc", "é", "😀", ".", "\n", RANDOM[:17], RANDOM]), max_size=25).map("".join), min_size=8, max_size=8))
def test_any_texts_against_brute_force(spark, model, texts):
    assert found(spark, texts, model) == {i: brute(t, model) for i, t in enumerate(texts)}


def test_held_out_strings(model):
    rng = random.Random(5)
    k = secrets.ALPHABET.index
    each = lambda s: sum(model[k(a) * 67 + k(b)] for a, b in zip(s, s[1:], strict=False)) >= max(10_000, 1000 * len(s))
    chars = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    strings = ["".join(rng.choices(chars, k=rng.randint(20, 60))) for _ in range(300)]
    words = "the number of pages in this document and its owner with another value from each table reader stream format window handler".split()
    names = ["_".join(rng.choices(words, k=5)) for _ in range(150)] + ["".join(w.title() for w in rng.choices(words, k=5)) for _ in range(150)]
    assert sum(map(each, strings)) >= 297
    assert sum(each(n) for n in names if len(n) >= 16) <= 3


def test_many_matches_in_one_text(spark):
    text = "token=abcdef é " * 20_000
    spans = found(spark, [text], NO_MODEL)[0]
    assert len(spans) == 20_000 and spans[-1] == (19_999 * 15, "assign", 19_999 * 15 + 12)


def test_without_samples_and_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    model = secrets.train(secrets.labelled_samples(df, strings=0).where("secret"))
    assert model == NO_MODEL and secrets.secret_spans(df, model).count() == 0
    assert found(spark, [RANDOM, "token=abcdef"], model) == {0: [], 1: [(0, "assign", 12)]}


def test_digest(spark):
    rows = secrets.secret_digest(secrets.secret_spans(spark.createDataFrame([(1, "token=abcdef " + "0a" * 12), (1, None)], "doc_id long, text string"), NO_MODEL)).collect()
    assert {(r.n_assign, r.n_access, r.n_hex, r.spans) for r in rows} == {(1, 0, 1, "assign:0:12,hex:13:37"), (0, 0, 0, "")}
