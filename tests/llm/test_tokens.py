import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rowloom.llm import tokens

LIBRARY = Tokenizer.from_file(tokens.vocabulary_path())
COUNTER = tokens.counter(tokens.vocabulary_path())


def brute(text):
    return len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=600, deadline=None)
@given(st.one_of(st.text(max_size=40), st.text(alphabet="aeinst hT'.\n!", max_size=60)))
def test_counts_equal_the_library(text):
    ends, counts, *_ = COUNTER.table(text)
    assert (counts[-1] if len(counts) else 0) == brute(text)
    for e, n in list(zip(ends, counts, strict=True))[:-1]:
        if not text[:e].isspace() and not text[e - 1].isspace():
            assert brute(text[:e]) == n


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcdefinorstuABé", min_size=1, max_size=25))
def test_every_prefix_of_a_word(word):
    counts = COUNTER.prefix_counts(word.encode())
    at = 0
    for i, c in enumerate(word, 1):
        at += len(c.encode())
        assert counts[at] == brute(word[:i])


@pytest.mark.parametrize("text", ["", "a<|endoftext|>b <|endoftext|>", "  \n\n  x  ", "don't we'll", "!" * 5000, "q" * 3000, "日本語のテキスト 🙂🙂", "a\U00016d1ab \U00016d1a\U00016d1a1", "x\U0001e5d0y\U00016d40 \U000323b0\u1c89q"])
def test_special_strings_and_long_pieces(text):
    _, counts, *_ = COUNTER.table(text)
    assert (counts[-1] if len(counts) else 0) == brute(text)


def test_characters_that_unicode_tables_class_differently():
    plain = [chr(c) for c in range(0x250, 0x33480, 7) if not 0xD800 <= c < 0xE000]
    other = [c for c in plain if not COUNTER._alike(c)]
    for c in [*other[::50], *plain[::500]]:
        for text in (f"a{c}b 1{c} {c}{c}!", f"{c}"):
            _, counts, *_ = COUNTER.table(text)
            assert counts[-1] == brute(text)


def test_truncation_keeps_within_budget():
    text = "Thnt eringing onheed, with erenenst thaner <|endoftext|> ing"
    for budget in range(30):
        n = COUNTER.truncate(text, budget)
        assert brute(text[:n]) <= budget
    assert COUNTER.truncate(text, 1000) == len(text)


def test_table_on_documents_and_edge_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    extra = spark.createDataFrame([(-1, None), (-2, ""), (None, "one two"), (None, "one two")], "doc_id long, text string")
    both = docs.union(extra).selectExpr("*", "1 AS n_tokens", "2 AS id")
    want = sorted(((r.doc_id is None, r.doc_id or 0, len((r.text or "").encode()), brute(r.text or "")) for r in both.collect()))
    rows = tokens.token_table(both, budget=5).collect()
    assert sorted((r.id is None, r.id or 0, r.n_bytes, r.n_tokens) for r in rows) == want
    assert all(len(r.prefix_tokens) == 0 or np.frombuffer(r.prefix_tokens, "<u4")[-1] == r.n_tokens for r in rows)
    assert tokens.token_table(both.limit(0)).count() == 0
    texts = {r.doc_id: r.text or "" for r in both.collect() if r.doc_id is not None}
    for r in rows:
        if r.id is not None:
            assert r.cut_at == COUNTER.truncate(texts[r.id], 5) and tokens.tokens_before(tokens.read_table(r), len(texts[r.id])) == r.n_tokens


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=30), st.text(alphabet="aeinstxqé hT'.😀", max_size=60)))
def test_the_table_has_every_prefix(text):
    table = COUNTER.table(text)
    start = 0
    for k, end in enumerate(table[0].tolist()):
        piece = text[start:end]
        for i in range(start + 1, end + 1):
            before = int(table[1][k - 1]) if k else 0
            assert tokens.tokens_before(table, i) == before + COUNTER.prefix_counts(piece[: i - start].encode("utf-8", "surrogatepass"))[-1]
            if not text[i - 1].isspace() and not any(c.isspace() for c in piece[: i - start]) and piece[: i - start].isascii() and piece.isalpha():
                assert tokens.tokens_before(table, i) == brute(text[:i])
        start = end
    for budget in range(0, 12):
        n = COUNTER.truncate(text, budget, table)
        assert tokens.tokens_before(table, n) <= budget


def test_truncation_reads_the_table_alone(monkeypatch):
    text = "supercalifragilistic antidisestablishmentarianism " + "q" * 3000 + " end"
    table = COUNTER.table(text)
    monkeypatch.setattr(tokens.PrefixCounter, "prefix_counts", lambda *_: 1 / 0)
    for budget in (0, 1, 3, 7, 20, 400, 5000):
        n = COUNTER.truncate(text, budget, table)
        assert brute(text[:n]) <= budget < (brute(text[: n + 1]) if n < len(text) else 10**9)
