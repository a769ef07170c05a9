import io
import os
import subprocess
import sys
import zipfile

from pyspark.sql import functions as F

from rowloom.operators.search import frames_first, search_text
from rowloom.plans.emit import emit_script
from rowloom.plans.recipe import read_recipe
from rowloom.sinks import runs


def test_rows_cursors_and_cache(spark, tmp_path):
    root = str(tmp_path)
    for run in ("a", "b"):
        runs.save_rows(spark.createDataFrame([(1, run)], "i int, v string"), root, run)
    assert [r.v for r in runs.read_rows(spark, root, "b").collect()] == ["b"]
    runs.save_cursor(spark, root, "a", 0, "s1")
    runs.save_cursor(spark, root, "a", 1, "s2")
    runs.save_cursor(spark, root, "b", 3, "s9", done=True)
    assert [(r.run_id, r.step_id) for r in runs.incomplete_runs(spark.read.parquet(f"{root}/cursors")).collect()] == [("a", "s2")]
    cache = spark.range(130).select(F.col("id").cast("string").alias("key"), F.col("id").alias("last_used"))
    assert runs.evict(cache, most=100, batch=50).count() == 80 and runs.evict(cache, most=200).count() == 130
    assert runs.merge_answers(cache, cache.limit(1).withColumn("last_used", F.lit(999))).where("last_used = 999").count() == 1
    keys = spark.range(1).select(*(runs.cache_key(F.lit("u"), f, F.lit("p"), F.lit("m"), F.lit(None).cast("string"), F.lit("d")).alias(n) for n, f in (("x", ["b", "a"]), ("y", ["a", "b"]), ("z", ["a"])))).first()
    assert keys.x == keys.y != keys.z
    assert zipfile.ZipFile(io.BytesIO(runs.zip_store({"b.txt": b"2", "a.txt": b"1"}))).namelist() == ["a.txt", "b.txt"]


def test_search_and_frames(spark, tmp_path):
    (tmp_path / "x.js").write_text("one\nTwo(a)\n")
    (tmp_path / "y.md").write_text("two(a)\r\n")
    assert [(r.file[-4:], r.line_no) for r in search_text(spark, str(tmp_path), "two(").collect()] == [("x.js", 2), ("y.md", 1)]
    assert search_text(spark, str(tmp_path), "t.o", is_regex=True, ignore_case=False, file_filter=".md").count() == 1
    frames = spark.createDataFrame([(1, 0, False), (1, 2, True), (1, 1, True), (2, 0, False), (2, 1, False)], "page int, frame int, ok boolean")
    assert sorted((r.page, r.frame) for r in frames_first(frames, "page", "frame", "ok").collect()) == [(1, 1), (2, 0)]


def test_emitted_script_runs(spark, tmp_path):
    recipe = read_recipe({"name": 'my "x"', "steps": [{"type": "LOOP", "config": {"selector": "li"}, "children": [{"type": "EXTRACT", "config": {"apiKey": "s3cret", "fields": [{"name": "t", "selector": "a"}]}}]}, {"type": "EXPORT", "config": {"format": "csv"}}]})
    script, warnings = emit_script(recipe)
    assert "s3cret" not in script and not warnings
    spark.createDataFrame([("https://s.test/", "<ul><li><a>x</a><li><a>y</a></ul>")], "url string, html string").write.parquet(str(tmp_path / "pages"))
    (tmp_path / "run.py").write_text(script)
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    done = subprocess.run([sys.executable, str(tmp_path / "run.py"), str(tmp_path / "pages"), str(tmp_path / "out")], env=os.environ | {"PYTHONPATH": root, "SECRET_1": "k"}, capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]
    assert sorted(r.t for r in spark.read.option("header", True).csv(str(tmp_path / "out/csv")).collect()) == ["x", "y"]
