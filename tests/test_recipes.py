import json

import pytest
from pyspark.sql import functions as F

from rowloom.plans import recipe as R
from rowloom.plans import steps as ST
from rowloom.plans import templates as TP
from rowloom.plans.compiler import RecipeError, Sources, compile_recipe, file_manifest, paginate_until_empty

SHOP = '<ul>{}</ul><p class="note">n</p>'
CARD = '<li><a href="/p/{0}">Item {0}</a><b>${1}</b></li>'


def shop(spark):
    html = [SHOP.format("".join(CARD.format(i, p) for i, p in part)) for part in ([(1, "1,299.00"), (2, "5.50")], [(2, "5.50"), (3, "none")], [])]
    return spark.createDataFrame([(i, f"https://s.test/list?p={i}", h) for i, h in enumerate(html, 1)], "page_id int, url string, html string")


FIELDS = [{"name": "name", "selector": "a"}, {"name": "price", "selector": "b", "transform": ["trim", "number"]}, {"name": "link", "selector": "a", "type": "attribute", "attribute": "href", "transform": "url"}]


def test_loop_extract_dedupe_export(spark):
    recipe = {"name": "x", "steps": [{"type": "website"}, {"type": "DEDUPE", "config": {"fields": "name"}}, {"type": "LOOP", "config": {"selector": "li"}, "children": [{"type": "EXTRACT", "config": {"fields": FIELDS}}]}, {"type": "EXPORT", "config": {"format": "jsonl"}}]}
    done = compile_recipe(spark, json.dumps(recipe), Sources(pages=shop(spark)))
    assert sorted((r.name, r.price, r.link) for r in done.rows.collect()) == [("Item 1", 1299.0, "https://s.test/p/1"), ("Item 2", 5.5, "https://s.test/p/2"), ("Item 3", None, "https://s.test/p/3")]
    assert done.exports[0]["filename"] == "export.jsonl"


def test_branches_assertions_and_url_pagination(spark):
    take = lambda name: [{"type": "EXTRACT", "config": {"fields": [{"name": name, "selector": "a"}]}}]
    recipe = {"steps": [{"type": "IF_ELSE", "config": {"condition": "exists", "selector": "li"}, "ifBranch": take("full"), "elseBranch": take("empty")}]}
    rows = compile_recipe(spark, recipe, Sources(pages=shop(spark))).rows.collect()
    assert sorted((r.page_id, r.full is not None) for r in rows) == [(1, True), (1, True), (2, True), (2, True), (3, False)]
    paged = {"steps": [{"type": "LOOP", "config": {"type": "paginate-url", "url": "https://s.test/list?p={page}", "start": 1, "max": 2}, "children": take("n")}]}
    assert compile_recipe(spark, paged, Sources(pages=shop(spark))).rows.count() == 4
    must = lambda sel: {"steps": [{"type": "ASSERT", "config": {"assertion": "exists", "selector": sel}}, *take("n")]}
    assert compile_recipe(spark, must(".note"), Sources(pages=shop(spark))).rows.count() == 5
    with pytest.raises(Exception, match='nothing on the page matches ".zz"'):
        compile_recipe(spark, must(".zz"), Sources(pages=shop(spark))).rows.collect()


def test_other_sources(spark):
    responses = spark.createDataFrame([("r", 1, '{"d":[{"a":1},{"a":2}],"n":"x"}', 200, None), ("r", 2, '{"d":[{"a":3}]}', 200, None)], "run string, seq int, body string, status int, link string")
    captures = spark.createDataFrame([("https://s.test/api/x", "GET", "json"), ("https://s.test/a.png", "GET", "")], "url string, method string, type string")
    recipe = {"steps": [{"type": "API", "config": {"url": "https://s.test", "rowsPath": "d", "pagination": {"mode": "cursor", "cursorPath": "n"}}}, {"type": "API_SNIFFER", "config": {"urlFilter": "s.test"}}, {"type": "WAIT"}]}
    rows = compile_recipe(spark, recipe, Sources(responses=responses, captures=captures)).rows
    assert rows.where("row IS NOT NULL").count() == 3 and rows.where("method = 'GET'").count() == 1
    files = {"steps": [{"type": "DOWNLOAD_FILE", "config": {"selector": "a", "filename": "{{file.host}}/{{file.index}}-{{file.stem}}"}}, {"type": "PAGE_JSON", "config": {"mode": "text"}}, {"type": "PAGE_DATA"}, {"type": "AUTO_EXTRACT", "config": {"schema": "title"}}]}
    rows = compile_recipe(spark, files, Sources(pages=shop(spark).limit(1))).rows
    assert "s.test/1-1" in {r.path for r in rows.where("path IS NOT NULL").collect()}
    looped = {"steps": [{"type": "LOOP", "config": {"type": "list", "list": "https://s.test/list?p=1\n\nhttps://s.test/list?p=3"}, "children": [{"type": "NAVIGATE", "config": {"url": "{{item.value}}"}}, {"type": "EXTRACT", "config": {"fields": [{"name": "t", "selector": ".note"}]}}]}]}
    assert compile_recipe(spark, looped, Sources(pages=shop(spark))).rows.count() == 2
    looped["steps"][0]["children"][1]["config"]["fields"][0]["selector"] = "li:nth-child({{loop.index}})"
    assert sorted(r.t or "" for r in compile_recipe(spark, looped, Sources(pages=shop(spark))).rows.collect()) == ["", "Item 1$1,299.00"]


@pytest.mark.parametrize("step", [{"type": "CLICK"}, {"type": "NOPE"}, {}, {"type": "LOOP", "config": {"type": "count", "count": 0}}, {"type": "LOOP", "config": {"type": "paginate"}}, {"type": "EXPORT", "config": {"format": "xls"}}, {"type": "API"}, {"type": "LOOP"}])
def test_refusals(spark, step):
    with pytest.raises(ValueError):
        compile_recipe(spark, {"steps": [step]}, Sources(pages=shop(spark)))


def test_a_gate_drops_rows_alike_in_every_way(spark):
    captures = spark.createDataFrame([("https://s.test/a", "GET", "json")] * 3 + [("https://s.test/b", "GET", "json")], "url string, method string, type string")
    recipe = {"steps": [{"type": "API_SNIFFER"}, {"type": "DEDUPE"}, {"type": "API_SNIFFER"}]}
    assert compile_recipe(spark, recipe, Sources(captures=captures)).rows.count() == 6


def test_file_manifest(spark):
    df = spark.createDataFrame([("https://h.test/a/b%20c.jpg?x", 1), ("https://h.test/", 2), ("data:image/svg+xml,x", 3), ("https://h.test/%2e%2e%2fpasswd", 4)], "url string, index int")
    assert [r.path for r in file_manifest(df, "pics/{{file.name}}").orderBy("index").collect()] == ["pics/b c.jpg", "pics/file-2", "pics/file-3.svg", "pics/passwd"]


def test_reading_and_reports():
    assert R.read_recipe([]).errors and R.read_recipe({"steps": 1}).errors and R.read_recipe({"steps": [{}]}).errors == ["Step 1 is missing a type"]
    r = R.read_recipe({"targetOrigin": "https://a.test/x", "steps": [{"type": "LOOP", "config": {"count": 4}, "children": [{"type": "api", "id": "k", "config": {"url": "https://evil.test/", "headers": '{"Authorization":"z"}', "apiKey": "q", "t": "{{item.x}}"}}]}, {"type": "SESSION"}, {"type": "FILL", "config": {"selector": "#password", "text": "pw"}}]})
    report = R.capabilities(r)
    assert report["verdict"] == "blocked" and report["thirdParty"] == ["https://evil.test"] and report["declared"] == ["https://a.test"]
    clean, found = R.redact(r)
    assert len(found) == 3 and "pw" not in str(clean) and '"z"' not in str(clean) and r.steps[2].config["text"] == "pw"
    assert [t["template"] for t in R.unresolved_templates(r)] == ["{{item.x}}"]
    assert R.count_requests(r.steps, ("API",)) == 4 and {g["code"] for g in R.gates(r)} == {"ORIGIN", "FORM_FILL"}
    assert [t for _, t, _ in R.unrunnable(r)] == ["SESSION", "FILL"] and [t for _, t, _ in R.unexportable(r)] == ["SESSION"]
    assert R.capabilities(R.read_recipe({"steps": [{"type": "EXPORT"}]}))["verdict"] == "allow"
    assert R.gates(R.read_recipe({"steps": [{"type": "WEBSITE", "config": {"url": "https://a.test/x/1"}}]}), [("*", "/x", False)])[0]["code"] == "ROBOTS"
    assert R.filename_template("a/{{file.stem}}-{{loop.index}}.x") == ([[("lit", "a")], [("var", "file.stem"), ("lit", "-"), ("lit", ".x")]], ["{{loop.index}}"])
    assert R.origin_of("HTTPS://A.test:443/x") == "https://a.test" and R.origin_of("{{item.url}}") is None and R.origin_of("ftp://x") is None


def test_steps():
    assert len(ST.USER_STEPS) == 29 and len(ST.INTERNAL_STEPS) == 9
    assert (ST.retry_count({"retries": "9"}), ST.retry_count({}), ST.retry_delay_ms({"retryDelayMs": 1e9}), ST.retry_delay_ms({"retryDelayMs": -1})) == (5, 0, 30_000, 500)
    with pytest.raises(ValueError):
        ST.default_config("NOPE")


def test_templates(spark):
    context = {"a": {"b": [{"c": 5.0}]}, "t": True, "n": None}
    assert TP.render({"x": ["{{a.b[0].c}}|{{a.b.0.c}}|{{a.zz}}|{{ t }}|{{n}}"]}, context) == {"x": ["5|5||true|"]}
    df = spark.createDataFrame([(1, {"k": "v"}, [2.5]), (2, None, None)], "i int, m map<string,string>, l array<double>")
    got = [r[0] for r in df.select(TP.compile_template(df, "<{{i}}-{{m.k}}-{{l[0]}}-{{out}}>", {"out": "o"})).collect()]
    assert got == ["<1-v-2.5-o>", "<2---o>"]
    pages = spark.createDataFrame([(1, 0), (2, 3), (3, 0), (4, 5)], "page int, kept int")
    assert sorted(r.page for r in paginate_until_empty(pages, "page", "kept").select("page").collect()) == [1, 2, 3]
    assert pages.agg(F.count("page")).first()[0] == 4
