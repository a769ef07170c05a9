"""Runs that are taken up again, paused and stopped, and buffers of streamed rows."""

import pytest
from pyspark.sql import functions as F

from rowloom.plans.compiler import RecipeError, Sources
from rowloom.plans.recipe import read_recipe
from rowloom.plans.runs import ask, prefix_keys, run_recipe
from rowloom.sinks.runs import incomplete_runs
from rowloom.streaming import buffer

STEPS = [
    {"type": "WEBSITE", "config": {"url": "https://s.test/1"}}, {"type": "PAGE_JSON", "config": {"mode": "text"}},
    {"type": "API", "config": {"url": "https://s.test/api", "rowsPath": "data"}}, {"type": "EXTRACT", "config": {"fields": [{"name": "t", "selector": "p"}]}},
]


def tables(spark, folder, fail=False):
    pages = spark.createDataFrame([("https://s.test/1", "<p>me@x.org</p>")], "url string, html string")
    responses = spark.createDataFrame([("r", 1, '{"data":[{"id":1},{"id":2}]}', 200, None)], "run string, seq int, body string, status int, link string")
    pages.write.mode("ignore").parquet(f"{folder}/pages")
    read = spark.read.parquet(f"{folder}/pages")
    if fail:
        responses = responses.withColumn("body", F.raise_error(F.lit("the server went away")).cast("string"))
    return Sources(pages=read, responses=responses)


def values(run):
    return sorted(str(r.record or r.row or r.t) for r in run.result.rows.collect())


def test_a_run_is_taken_up_where_it_failed(spark, tmp_path):
    root, recipe = f"{tmp_path}/run", {"steps": STEPS}
    with pytest.raises(Exception, match="went away"):
        run_recipe(spark, recipe, tables(spark, tmp_path, fail=True), root, "a")
    cursors = spark.read.parquet(f"{root}/cursors")
    assert [(r.run_id, r.step_index) for r in incomplete_runs(cursors).collect()] == [("a", 1)]
    run = run_recipe(spark, recipe, tables(spark, tmp_path), root, "a")
    assert run.state == "done" and values(run) == ["me@x.org", "me@x.org", '{"id":1}', '{"id":2}']
    assert run.warning == "2 of Email"
    assert incomplete_runs(spark.read.parquet(f"{root}/cursors")).count() == 0
    # Done, it reads no source at all; another run has rows of its own.
    files = run_recipe(spark, recipe, tables(spark, tmp_path), root, "a").result.rows.inputFiles()
    assert files and all("/run/steps/a/" in f for f in files)
    assert run_recipe(spark, recipe, tables(spark, tmp_path), root, "b").state == "done"


def test_finished_steps_do_not_read_their_sources(spark, tmp_path):
    root = f"{tmp_path}/run"
    first = run_recipe(spark, {"steps": STEPS[:2]}, tables(spark, tmp_path), root, "a")
    assert first.state == "done" and values(first) == ["me@x.org"]
    more = run_recipe(spark, {"steps": STEPS[:3]}, tables(spark, tmp_path), root, "a")
    assert not any("/pages/" in f for f in more.result.rows.inputFiles()) and len(values(more)) == 3
    # A change before the cursor begins anew there.
    changed = [STEPS[0], {"type": "PAGE_JSON", "config": {"mode": "flat"}}, STEPS[2]]
    assert prefix_keys(read_recipe({"steps": changed}), "a")[0] == prefix_keys(read_recipe({"steps": STEPS}), "a")[0]
    assert any("{" in v for v in values(run_recipe(spark, {"steps": changed}, tables(spark, tmp_path), root, "a")))


def test_pause_stop_and_gates(spark, tmp_path):
    root = f"{tmp_path}/run"
    ask(spark, root, "a", "pause")
    run = run_recipe(spark, {"steps": STEPS}, tables(spark, tmp_path), root, "a")
    assert (run.state, run.step, run.result.rows) == ("paused", 0, None)
    ask(spark, root, "a", "run")
    assert run_recipe(spark, {"steps": STEPS[:2]}, tables(spark, tmp_path), root, "a").state == "done"
    ask(spark, root, "a", "stop")
    stopped = run_recipe(spark, {"steps": STEPS}, tables(spark, tmp_path), root, "a")
    assert (stopped.state, stopped.step) == ("stopped", 2) and values(stopped) == ["me@x.org"]
    assert incomplete_runs(spark.read.parquet(f"{root}/cursors")).count() == 0
    with pytest.raises(ValueError, match="no state"):
        ask(spark, root, "a", "rest")
    with pytest.raises(RecipeError, match="Captchas"):
        run_recipe(spark, {"steps": [{"type": "SOLVE_CAPTCHA"}]}, tables(spark, tmp_path), root, "c")


def test_a_replayed_batch_adds_no_row(spark, tmp_path):
    root, schema = f"{tmp_path}/buffer", "id bigint, v string"
    rows = lambda a, b: spark.range(a, b).select("id", F.lit("x").alias("v"))
    write = buffer.flush(root, "r 1", cap=25, order=["id"])
    for number, part in enumerate((rows(0, 10), rows(10, 20), rows(20, 40))):
        write(part, number)
        write(part, number)
    write(rows(10, 20), 1)
    counts = {r.batch: (r.rows, r.dropped) for r in buffer.flushes(spark, root, "r 1").collect()}
    assert counts == {0: (10, 0), 1: (10, 0), 2: (5, 15)}
    assert sorted(r.id for r in buffer.buffered(spark, root, "r 1", schema).collect()) == list(range(25))
    assert buffer.flushes(spark, root, "other").count() == 0


def test_a_stream_is_buffered_and_goes_on(spark, tmp_path):
    source, root = f"{tmp_path}/in", f"{tmp_path}/buffer"
    one = lambda a, b: spark.range(a, b).write.mode("append").parquet(source)
    one(0, 30)
    stream = lambda: spark.readStream.schema("id bigint").parquet(source)
    buffer.buffer_rows(stream(), root, "r", f"{tmp_path}/c", every=None).awaitTermination()
    one(30, 45)
    buffer.buffer_rows(stream(), root, "r", f"{tmp_path}/c", every=None).awaitTermination()
    assert sorted(r.id for r in buffer.buffered(spark, root, "r", "id bigint").collect()) == list(range(45))
    assert sorted(r.rows for r in buffer.flushes(spark, root, "r").collect()) == [15, 30]
