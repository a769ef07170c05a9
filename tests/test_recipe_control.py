"""What steps of a recipe do to those after them: memory between runs, empty pages, optional steps, stored results."""

import pytest

from rowloom.plans.compiler import RecipeError, Sources, compile_recipe


def site(spark, items, first=1):
    html = ["<ul>" + "".join(f"<li>{x}</li>" for x in part) + "</ul>" for part in items]
    return spark.createDataFrame([(f"https://s.test/{i}", h) for i, h in enumerate(html, first)], "url string, html string")


ONE = {"type": "PAGE_JSON", "config": {"mode": "text"}}


def names(done, column="record"):
    return sorted(r[column] for r in done.rows.collect())


def test_forever_remembers_earlier_runs(spark):
    recipe = {"steps": [{"type": "WEBSITE"}, {"type": "DEDUPE", "config": {"fields": "record", "scope": "forever"}}, ONE]}
    first = compile_recipe(spark, recipe, Sources(pages=site(spark, [["a", "b"], ["b"]])))
    assert names(first) == ["a", "b"] and first.seen.count() == 2
    second = compile_recipe(spark, recipe, Sources(pages=site(spark, [["a", "c"], ["b", "c"]]), seen=first.seen))
    assert names(second) == ["c"] and second.seen.count() == 3
    run = {"steps": [{"type": "WEBSITE"}, {"type": "DEDUPE", "config": {"fields": "record"}}, ONE]}
    again = compile_recipe(spark, run, Sources(pages=site(spark, [["a"]]), seen=first.seen))
    assert names(again) == ["a"] and again.seen is None


def test_url_pagination_stops_at_the_first_page_without_new_rows(spark):
    loop = {"type": "LOOP", "config": {"type": "paginate-url", "url": "https://s.test/{page}", "start": 1, "max": 12}, "children": [ONE]}
    pages = site(spark, [["a"], ["b"], ["a", "b"], ["c"]])
    gate = {"type": "DEDUPE", "config": {"fields": "record"}}
    assert names(compile_recipe(spark, {"steps": [gate, loop]}, Sources(pages=pages))) == ["a", "b"]
    assert names(compile_recipe(spark, {"steps": [loop]}, Sources(pages=pages))) == ["a", "a", "b", "b", "c"]
    on = {**loop, "config": {**loop["config"], "stopWhenEmpty": False}}
    assert names(compile_recipe(spark, {"steps": [gate, on]}, Sources(pages=pages))) == ["a", "b", "c"]
    # Without any rows before, an empty page stops nothing; a page the table lacks is an empty one.
    assert names(compile_recipe(spark, {"steps": [loop]}, Sources(pages=site(spark, [["a"], ["b"]], first=3)))) == ["a", "b"]
    gap = site(spark, [["a"]]).union(site(spark, [["b"]], first=3))
    assert names(compile_recipe(spark, {"steps": [loop]}, Sources(pages=gap))) == ["a"]
    # What follows the loop is not compared with pages that it never opened.
    after = compile_recipe(spark, {"steps": [gate, loop, {"type": "WEBSITE", "config": {"url": "https://s.test/4"}}, ONE]}, Sources(pages=pages))
    assert names(after) == ["a", "b", "c"]


def test_optional_steps_and_stored_results(spark):
    pages = site(spark, [["a"]])
    api = {"type": "API", "config": {"url": "https://s.test", "optional": True}}
    must = {"type": "ASSERT", "config": {"assertion": "exists", "selector": ".zz", "optional": True}}
    assert names(compile_recipe(spark, {"steps": [api, must, ONE]}, Sources(pages=pages))) == ["a"]
    with pytest.raises(RecipeError, match="needs a table of recorded responses"):
        compile_recipe(spark, {"steps": [{"type": "API", "config": {"url": "https://s.test"}}]}, Sources(pages=pages))
    # What an optional step has not stored is empty in later templates.
    for stored in ("{{token.id}}", "{{extracted.x}}", "{{ api[0].id }}"):
        steps = [{**api, "config": {**api["config"], "storeAs": "token"}}, {"type": "WEBSITE", "config": {"url": f"https://s.test/1{stored}"}}, ONE]
        assert names(compile_recipe(spark, {"steps": steps}, Sources(pages=pages))) == ["a"]


CARDS = "<div class=g><ul><li><a href=/1>a</a><i>1</i></li><li><a href=/2>b</a></li></ul></div><div class=g><ul><li><a href=/3>c</a><i>3</i></li></ul></div><div class=g></div>"
LABEL = {"type": "EXTRACT", "config": {"fields": [{"name": "label", "selector": ":scope a"}]}}


def cards(spark, n=1):
    return spark.createDataFrame([(f"https://s.test/{i}", CARDS) for i in range(n)], "url string, html string")


def loop(selector, *children, **config):
    return {"type": "LOOP", "config": {"selector": selector, **config}, "children": list(children)}


def test_loops_within_loops_and_branches_of_records(spark):
    run = lambda *steps: compile_recipe(spark, {"steps": [{"type": "WEBSITE"}, *steps]}, Sources(pages=cards(spark, 2)))
    assert names(run(loop("div.g", loop("li", LABEL))), "label") == ["a", "a", "b", "b", "c", "c"]
    numbered = {"type": "EXTRACT", "config": {"fields": [{"name": "number", "selector": ":scope i"}]}}
    branch = {"type": "IF_ELSE", "config": {"condition": "exists", "selector": ":scope i"}, "ifBranch": [numbered], "elseBranch": [LABEL]}
    rows = run(loop("div.g", loop("li", branch))).rows.collect()
    assert sorted((r.number or "", r.label or "") for r in rows) == [("", "b"), ("", "b"), ("1", ""), ("1", ""), ("3", ""), ("3", "")]
    # A branch around an inner loop keeps the records of the outer one.
    outer = {"type": "IF_ELSE", "config": {"condition": "exists", "selector": ":scope i"}, "ifBranch": [loop("li", LABEL)], "elseBranch": []}
    assert names(run(loop("div.g", outer)), "label") == ["a", "a", "b", "b", "c", "c"]
    last = {"type": "IF_ELSE", "config": {"condition": "text-contains", "selector": ":scope i", "value": "3"}, "ifBranch": [loop("li", LABEL)]}
    assert names(run(loop("div.g", last)), "label") == ["c", "c"]
    text = {"type": "PAGE_JSON", "config": {"mode": "text"}}
    assert names(run(loop("li", text)))[:2] == ["1", "1"]


def test_failing_records_are_skipped_or_stop_the_run(spark):
    must = {"type": "ASSERT", "config": {"assertion": "exists", "selector": ":scope i"}}
    run = lambda **config: compile_recipe(spark, {"steps": [{"type": "WEBSITE"}, loop("li", must, LABEL, **config)]}, Sources(pages=cards(spark)))
    assert names(run(onFail="skip"), "label") == names(run(), "label") == ["a", "c"]
    assert names(run(max=2), "label") == ["a"]
    with pytest.raises(Exception, match="nothing on the page matches"):
        run(onFail="stop").rows.collect()


def test_next_links_and_page_links(spark):
    page = lambda i, nxt: (f"https://s.test/{i}", f"<p>{i}</p>" + (f'<a class=n href="/{nxt}">next</a>' if nxt else "") + '<b><a href="/7">x</a><a href="/8">y</a><a href="/7">z</a></b>')
    pages = spark.createDataFrame([page(1, 2), page(2, 3), page(3, 1), page(7, None), page(8, None)], "url string, html string")
    text = {"type": "EXTRACT", "config": {"fields": [{"name": "t", "selector": "p"}]}}
    start = {"type": "WEBSITE", "config": {"url": "https://s.test/1"}}
    run = lambda *steps: compile_recipe(spark, {"steps": [start, *steps]}, Sources(pages=pages))
    assert names(run({"type": "PAGINATE", "config": {"selector": "a.n"}}, text), "t") == ["1", "2", "3"]
    assert names(run({"type": "PAGINATE", "config": {"selector": "a.n", "maxPages": 2}}, text), "t") == ["1", "2"]
    assert names(run({"type": "LOOP", "config": {"type": "paginate", "selector": "a.n"}, "children": [text]}), "t") == ["1", "2", "3"]
    assert names(run({"type": "LOOP", "config": {"type": "paginate-links", "selector": "b a"}, "children": [text]}), "t") == ["1", "7", "8"]
    with pytest.raises(RecipeError, match="selector of the link"):
        run({"type": "PAGINATE"}, text)


def test_lists_beyond_the_cap_are_noted(spark, monkeypatch):
    from rowloom.plans import compiler

    monkeypatch.setattr(compiler, "LOOP_CAP", 2)
    looped = {"type": "LOOP", "config": {"type": "list", "list": "1\n2\n3"}, "children": [{"type": "NAVIGATE", "config": {"url": "https://s.test/{{item.value}}"}}, ONE]}
    done = compile_recipe(spark, {"steps": [looped]}, Sources(pages=site(spark, [["a"], ["b"], ["c"]])))
    assert names(done) == ["a", "b"] and "1 of 3 items" in done.notes[0]


def test_exports_are_written(spark, tmp_path):
    from rowloom.plans.compiler import run_exports

    steps = [{"type": "WEBSITE"}, loop("li", LABEL), {"type": "EXPORT", "config": {"format": "csv", "filename": "first.csv"}}, {"type": "EXPORT", "config": {"format": "jsonl", "filename": "all.jsonl", "append": True}}, loop("li", LABEL), {"type": "EXPORT", "config": {"format": "json", "filename": "both.json"}}]
    done = compile_recipe(spark, {"steps": steps}, Sources(pages=cards(spark)))
    read = lambda name: spark.read.text(f"{tmp_path}/out/{name}").count()
    assert [r.get("added") for r in run_exports(done, f"{tmp_path}/out", f"{tmp_path}/sets")] == [None, 3, None]
    assert read("first.csv") >= 4 and read("all.jsonl") == 3 and spark.read.json(f"{tmp_path}/out/both.json", multiLine=True).count() == 6
    run_exports(done, f"{tmp_path}/out", f"{tmp_path}/sets")
    assert read("all.jsonl") == 6
    stored = done.upto(1).limit(1).unionByName(spark.createDataFrame([("https://s.test/0", 9, 0, "z", "x")], "url string, _record int, _row int, label string, _step string"), allowMissingColumns=True)
    run_exports(done, f"{tmp_path}/more", f"{tmp_path}/sets", stored)
    assert spark.read.option("header", True).csv(f"{tmp_path}/more/first.csv").count() == 4
    with pytest.raises(RecipeError, match="cannot be appended to"):
        compile_recipe(spark, {"steps": [{"type": "EXPORT", "config": {"format": "xml", "append": True}}]}, Sources(pages=cards(spark)))


def test_counters_and_the_warning_of_a_run(spark):
    from rowloom.operators.pii_scan import run_warning
    from rowloom.plans.compiler import counters

    done = compile_recipe(spark, {"steps": [{"type": "DEDUPE", "config": {"fields": "record"}}, {"type": "WEBSITE"}, ONE]}, Sources(pages=site(spark, [["me@x.org", "b"], ["b", "you@x.org"]])))
    assert counters(done) == {"rows": 3, "dropped": 1}
    assert run_warning(done.rows, ["record"]) == "2 of Email" and run_warning(done.rows.where("record = 'b'"), ["record"]) is None
    assert counters(compile_recipe(spark, {"steps": [{"type": "WEBSITE"}]}, Sources(pages=site(spark, [])))) == {"rows": 0, "dropped": 0}
