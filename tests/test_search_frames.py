"""Search through trigrams equals the scan; answers of frames within frames."""

import random

import pytest

from rowloom.operators import search


def test_indexed_search_equals_the_scan(spark, tmp_path):
    r = random.Random(4)
    words = ["alpha", "Beta", "gamma.x", "api_key=abc123", "straße", "K", "to\tken", "aaa", "(x)"]
    files = spark.createDataFrame([(f"f{i}", "\r\n".join(" ".join(r.choices(words, k=r.randrange(6))) for _ in range(r.randrange(5)))) for i in range(120)] + [("null", None), ("empty", "")], "file string, value string")
    search.write_postings(files, f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    for needle, is_regex, fold in (
        ("alpha beta", False, True), ("ALPHA", False, False), ("beta", False, False), ("aß", False, True), ("gamma.x", False, True), ("gamma.x", True, True), ("a", False, True), ("", False, True),
        (r"api_key=\w+", True, True), (r"(alpha|beta) gamma", True, True), (r"al?pha", True, True), (r"^beta\b", True, True), ("to\tken", False, True), (r"aaa aaa|alpha alpha", True, False), (r"[(]x[)] k", True, True), ("zzzz", False, True),
    ):
        rows = lambda df: sorted((x.file, x.line_no, x.text) for x in df.collect())
        want = rows(search.matching_lines(files, needle, is_regex, fold))
        assert rows(search.search_indexed(files, index, needle, is_regex, fold)) == want, needle
    assert rows(search.matching_lines(files, "alpha beta"))


def test_what_matches_need(spark):
    assert search.required_texts("Some text") == ["some text"] and search.required_texts("ab") == []
    assert search.required_texts(r"foo\d+barbaz(?:x|y)end", True) == ["foo", "barbaz", "end"]
    assert search.required_texts("(?x) foo bar", True) == [] and search.required_texts(r"a|b", True) == []
    with pytest.raises(ValueError, match="not a valid pattern"):
        search.matching_lines(spark.createDataFrame([("a", "b")], "file string, value string"), "(", True)


def test_a_lookup_leaves_few_files(spark, tmp_path):
    files = spark.createDataFrame([(i, f"line {i} of many") for i in range(1000)], "file int, value string")
    index = search.postings(files)
    assert sorted(r.file for r in search.candidate_files(index, "line 77 of").collect()) == [77, 777]
    assert search.candidate_files(index, "77") is None
    plan = search.candidate_files(index, "line 77 of")._jdf.queryExecution().optimizedPlan().toString()
    assert "gram" in plan


def test_frame_trees(spark):
    rows = [("top", None, ""), ("a", "top", ""), ("b", "a", "B"), ("c", "top", ""), ("d", "c", "D"), ("alone", "gone", "A"), ("x", "y", "X"), ("y", "x", "Y"), ("self", "self", "S"), ("in", "self", "I")]
    rows += [(f"n{i}", f"n{i - 1}" if i else None, "deep" if i == 150 else "") for i in range(200)]
    frames = spark.createDataFrame(rows, "frame string, parent string, answer string")
    tree = {r.frame: (r.page, r.nesting) for r in search.frame_tree(frames).collect()}
    assert {k: v for k, v in tree.items() if not k.startswith("n")} == {"top": ("top", 0), "a": ("top", 1), "b": ("top", 2), "c": ("top", 1), "d": ("top", 2), "alone": ("alone", 0)}
    assert all(tree[f"n{i}"] == ("n0", i) for i in range(200))
    best = {r.page: r.answer for r in search.lifted(frames, ["answer"]).collect()}
    assert best == {"top": "B", "alone": "A", "n0": "deep"}


def test_pages_are_parsed_once_for_their_frames(spark, monkeypatch):
    from rowloom.plans import documents

    frame = type(spark.range(0))
    ran, real = [], frame.mapInArrow
    monkeypatch.setattr(frame, "mapInArrow", lambda self, *a, **k: ran.append(real(self, *a, **k)) or ran[-1])
    found = documents.frames_of_pages(spark, "/root/testdata/sf0.001")
    assert len(ran) == 1 and "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_postings_are_dealt_once(spark, tmp_path, monkeypatch):
    """Repeated rows of a file give a posting once, and what is written has passed one exchange."""
    files = spark.createDataFrame([("a", "one two"), ("a", "one two"), ("b", "two")], "file string, value string")
    from pyspark.sql.readwriter import DataFrameWriter

    plans, real = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: plans.append(self._df._jdf.queryExecution().executedPlan().toString()) or real(self, *a, **k))
    search.write_postings(files, f"{tmp_path}/once")
    rows = [(r.gram, r.file) for r in spark.read.parquet(f"{tmp_path}/once").collect()]
    assert sorted(rows) == sorted((r.gram, r.file) for r in search.postings(files).collect()) and len(rows) == len(set(rows)) == 6
    assert plans[0].count("Exchange ") == 1
