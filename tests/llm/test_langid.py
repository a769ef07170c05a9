import zlib

import numpy as np

from rowloom.llm import langid, registry


def test_held_out_accuracy_and_split(spark):
    got = registry.QUERIES["op2_language_id"](spark, "/root/testdata/sf0.01")
    truth = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = got.collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) / len(out) >= 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_bundle_equals_the_definition():
    text = "Ça et là, çà!"
    codes = [int(c) for c in langid.letter_codes(text)]
    want = np.zeros(langid.DIMENSIONS, np.int64)
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        want += langid.letter_vector(a).astype(int) * np.roll(langid.letter_vector(b), 1) * np.roll(langid.letter_vector(c), 2)
    assert (langid.bundle_text(text) == want).all()
    assert langid.bundle_text("12 34!") is None


def test_edge_rows(spark):
    rows = [(1, "the thing and then", "en", 1), (2, "der und die das", "de", 2), (3, None, "en", 3), (4, "", None, 4), (5, "42 !?", "de", 5), (None, "the the " * 30000, None, 6), (1, "the thing and then", "en", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    model = langid.train(df)
    assert sorted(model) == ["de", "en"]
    got = {(r.doc_id, r.lang_pred) for r in langid.predict(df, model).collect()}
    assert got == {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "en")}
    assert {r.lang_pred for r in langid.predict(df, {}).collect()} == {"und"}
    assert langid.train(df.limit(0)) == {} and langid.predict(df.limit(0), model).count() == 0


def brute_prediction(texts, train):
    """The definition, letter by letter: cosines of bundles with the sums of each language's bundles."""
    def bundle(text):
        letters = " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())
        codes, out = [ord(c) for c in f" {letters} "] if letters else [], np.zeros(langid.DIMENSIONS)
        for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
            out += langid.letter_vector(a).astype(int) * np.roll(langid.letter_vector(b), 1) * np.roll(langid.letter_vector(c), 2)
        return out

    prototypes = {}
    for text, lang in train:
        if text and lang is not None:
            prototypes[lang] = prototypes.get(lang, 0) + bundle(text)
    out = []
    for text in texts:
        v = bundle(text or "")
        cosine = {k: float(v @ p / (np.linalg.norm(v) * np.linalg.norm(p) or 1)) for k, p in prototypes.items()}
        out.append(max(sorted(cosine), key=cosine.get) if v.any() else "und")
    return out


def test_query_equals_the_definition_on_a_sample_of_its_own(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    short = docs.select("doc_id", docs.text.substr(1, 200).alias("text"), "lang", "source", "n_chars").limit(80).collect()
    spark.createDataFrame(short, docs.schema).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.lang_pred for r in registry.QUERIES["op2_language_id"](spark, str(tmp_path)).collect()}
    held = lambda r: zlib.crc32(str(r.doc_id).encode()) % 4 == 2
    want = brute_prediction([r.text for r in short], [(r.text, r.lang) for r in short if not held(r)])
    assert got == {r.doc_id: w for r, w in zip(short, want, strict=True)}


def test_stage_without_labels_and_with_clashing_columns(spark):
    rows = [(1, "some text", None, 1, "a", 2.5, "x"), (2, "42", None, 2, "b", 3.5, "y"), (3, None, "en", 3, "c", 4.5, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, `__text` int, k0 string, Score double, `a.b` string")
    got = langid.with_languages(df)
    assert got.columns == df.columns and [tuple(r) for r in got.collect()] == [rows[0]]
    named = spark.createDataFrame([(1, "der und die das", "und"), (2, "der die", None)], "doc_id long, text string, lang string")
    assert sorted(tuple(r) for r in langid.with_languages(named).collect()) == [(1, "der und die das", "und"), (2, "der die", "und")]
    assert langid.with_languages(df.limit(0)).count() == 0
