"""Loops as rows of one plan, results of steps in later templates, and next links by doubling."""

import random

import pytest
from pyspark.sql import functions as F

from rowloom.plans import context
from rowloom.plans.compiler import RecipeError, Sources, compile_recipe, follow_links, list_lines

SITE = "https://s.test"


def site(spark, **bodies):
    return spark.createDataFrame([(f"{SITE}/{k}", v) for k, v in bodies.items()], "url string, html string")


def run(spark, pages, *steps, **sources):
    return compile_recipe(spark, {"steps": list(steps)}, Sources(pages=pages, **sources))


def step(kind, *children, **config):
    return {"type": kind, "config": config} | ({"children": list(children)} if children else {})


def loop(kind, *children, **config):
    return step("LOOP", *children, type=kind, **config)


def fields(**selectors):
    return step("EXTRACT", fields=[{"name": k, "selector": v} for k, v in selectors.items()])


def placed(done, *columns):
    """Rows in the order of the run."""
    return [tuple(r[c] for c in columns) for r in done.upto(None, placed=True).orderBy("_seq").collect()]


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow")


def test_ten_thousand_items_are_one_plan(spark):
    pages = site(spark, p="<ol>" + "".join(f"<li>{i}</li>" for i in range(12)) + "</ol>")
    items = "\n".join(str(i) for i in range(10_000))
    body = (
        step("ASSERT", assertion="text-contains", selector="li:nth-child({{item.index}})", value="1"),
        fields(n="li:nth-child({{loop.index}})"),
        step("PAGE_JSON", mode="text", selector="li:nth-child({{item.index}})"),
    )
    done = run(spark, pages, step("WEBSITE", url=f"{SITE}/p"), loop("list", *body, list=items))
    rows = done.rows
    assert scans(rows) <= 5
    # Items whose element is not there, or has no 1 in it, are skipped.
    assert sorted(((r.n, r.record) for r in rows.collect()), key=str) == sorted([("1", None), ("10", None), ("11", None), (None, "1"), (None, "10"), (None, "11")], key=str)


def test_a_list_as_a_table_opens_a_page_for_each_item(spark):
    pages = spark.range(300).select(F.concat(F.lit(f"{SITE}/"), F.col("id")).alias("url"), F.concat(F.lit("<b>"), F.col("id") * 2, F.lit("</b><i>x</i>")).alias("html"))
    table = spark.range(0, 200).select(F.col("id").alias("index0"), (F.col("id") * 3).alias("key"), F.lit("b").alias("tag"))
    body = (step("NAVIGATE", url=SITE + "/{{item.key}}"), fields(v="{{item.tag}}"))
    done = run(spark, pages, loop("list", *body, source="context", contextPath="keys"), lists={"keys": table})
    assert placed(done, "v") == [(str(6 * i),) for i in range(100)]
    some = run(spark, pages, loop("list", *body, source="context", contextPath="keys", max=7), lists={"keys": table})
    assert len(placed(some, "v")) == 7
    assert run(spark, pages, loop("list", *body, source="context", contextPath="other")).notes


def test_nested_loops_and_counters(spark):
    pages = site(spark, a="<p>A</p>", b="<p>B</p>")
    inner = loop("count", fields(t="p", n="em"), step("PAGE_JSON", mode="text"), count=2)
    done = run(spark, pages, loop("list", step("NAVIGATE", url=SITE + "/{{item.value}}"), inner, list="b\na\nzz"))
    assert placed(done, "t", "record") == [("B", None), (None, "B"), ("B", None), (None, "B"), ("A", None), (None, "A"), ("A", None), (None, "A")]
    flags = loop("list", step("IF_ELSE", condition="text-equals", selector="p", value="{{item}}{{item.value}}") | {"ifBranch": [fields(same="p")], "elseBranch": [fields(other="p")]}, list="A\nB")
    done = run(spark, pages, step("WEBSITE"), flags)
    assert sorted((r.same or "", r.other or "") for r in done.rows.collect()) == [("", "A"), ("", "B"), ("A", ""), ("B", "")]
    with pytest.raises(RecipeError, match="differs from row to row"):
        run(spark, pages, step("WEBSITE"), loop("list", loop("count", fields(t="p"), count="{{item.value}}"), list="1"))
    with pytest.raises(RecipeError, match="the same for all"):
        run(spark, pages, step("WEBSITE"), loop("list", step("EXPORT", format="csv", filename="{{item.value}}"), list="1"))
    with pytest.raises(RecipeError, match="count of at least 1"):
        run(spark, pages, step("WEBSITE"), loop("count", fields(t="p"), count=0))


def test_records_that_open_pages(spark):
    card = '<li data-k="{0}"><a href="/{0}">{0}</a></li>'
    pages = site(spark, home="<ul>" + "".join(card.format(x) for x in "cab") + '</ul><ul><li><a href="/a">again</a></li></ul>', a="<h1>A</h1>", b="<h1>B</h1>", c="<h1>C</h1><ul><li>x</li></ul>")
    home = step("WEBSITE", url=f"{SITE}/home")
    done = run(spark, pages, home, loop("elements", fields(label=""), step("NAVIGATE", url="{{item.href}}"), fields(title="h1"), selector="li a"), fields(first="a"))
    assert placed(done, "label", "title", "first") == [
        ("c", None, None), (None, "C", None), ("a", None, None), (None, "A", None), ("b", None, None), (None, "B", None), ("again", None, None), (None, "A", None),
        (None, None, "c"), (None, None, "a"), (None, None, "b"), (None, None, "again"),
    ]
    # Facts of a record in the configuration of a step on the page itself, numbered within the outer record.
    done = run(spark, pages, home, loop("elements", loop("elements", fields(n="li:nth-child({{loop.index}}) a"), selector="li"), selector="ul"))
    assert [r[0] for r in placed(done, "n")] == ["c", "a", "b", "again"]
    done = run(spark, pages, home, loop("elements", step("DOWNLOAD_FILE", selector="a", filename="{{item.text}}-{{loop.index}}-{{file.name}}"), selector="li", max=2))
    assert sorted(r.path for r in done.rows.collect()) == ["a-2-a", "c-1-c"]


def test_values_of_earlier_rows(spark):
    pages = site(spark, start="<p>x</p><p>b</p><em> 7,5 </em>", b='<p>B</p><a href="/c">on</a>', c="<p>C</p>")
    first = step("EXTRACT", fields=[{"name": "where", "selector": "p"}, {"name": "n", "selector": "em", "transform": ["trim", "number"]}])
    on = step("EXTRACT", fields=[{"name": "to", "selector": "a", "type": "attribute", "attribute": "href"}])
    steps = (step("WEBSITE", url=f"{SITE}/start"), first, step("WEBSITE", url=SITE + "/{{extracted.where}}"), on, step("WEBSITE", url=SITE + "{{extracted.to}}{{extracted.none}}"), fields(p="p", n2="{{extracted.where}}"))
    done = run(spark, pages, *steps)
    assert placed(done, "where", "n", "to", "p") == [("x", 7.5, None, None), ("b", 7.5, None, None), (None, None, "/c", None), (None, None, None, "C")]
    # A plain address carries the results of the last page; a loop's do not leave it.
    carried = (step("WEBSITE", url=f"{SITE}/start"), first, step("WEBSITE", url=f"{SITE}/b"), step("ASSERT", assertion="exists", selector="p"), step("IF_ELSE", condition="text-contains", selector="p", value="{{extracted.n}}") | {"ifBranch": [fields(no="p")], "elseBranch": [fields(yes="p")]})
    assert placed(run(spark, pages, *carried), "yes")[-1] == ("B",)
    kept = (step("WEBSITE", url=f"{SITE}/b"), on, loop("count", fields(to="p"), count=2), step("NAVIGATE", url=SITE + "{{extracted.to}}"), fields(p="p"))
    assert placed(run(spark, pages, *kept), "p")[-1] == ("C",)


def test_stored_page_data(spark):
    html = '<script type="application/ld+json">{"@type":"Product","name":"%s","offers":{"price":"%s"},"sku":["a","b"]}</script><h2>%s</h2>'
    pages = site(spark, p=html % ("Pot", "3.50", "3.50"), q=html % ("Pan", "9", "8"), Pot="<p>pot page</p>")
    data = step("PAGE_DATA", source="jsonld", storeAs="shop")
    check = step("IF_ELSE", condition="text-equals", selector="h2", value="{{shop.records[0].offers.price}}") | {"ifBranch": [fields(same="h2")], "elseBranch": [fields(other="h2")]}
    done = run(spark, pages, step("WEBSITE"), data, check)
    assert sorted((r.same or "", r.other or "") for r in done.rows.where("record IS NULL").collect()) == [("", ""), ("", "8"), ("3.50", "")]
    done = run(spark, pages, step("WEBSITE", url=f"{SITE}/p"), step("PAGE_DATA", source="jsonld"), step("NAVIGATE", url=SITE + "/{{extracted.name}}"), fields(t="p"))
    assert placed(done, "t")[-1] == ("pot page",)
    skus = loop("list", fields(t="h2"), step("PAGE_JSON", mode="text", selector="h2", storeAs="seen"), source="context", contextPath="shop.records[0].sku")
    assert len(placed(run(spark, pages, step("WEBSITE", url=f"{SITE}/p"), data, skus), "t")) == 5


def test_results_of_requests(spark):
    responses = spark.createDataFrame([("r", 1, '{"data":[{"id":"a"},{"id":"b"}],"next":"2"}', 200, None), ("r", 2, '{"data":[{"id":"c"}],"next":null,"home":"b"}', 200, None)], "run string, seq int, body string, status int, link string")
    pages = site(spark, a="<p>A</p>", b="<p>B</p>", c="<p>C</p>")
    ask = step("API", url=f"{SITE}/api", rowsPath="data", storeAs="got", pagination={"mode": "cursor", "cursorPath": "next"})
    done = run(spark, pages, ask, loop("list", step("NAVIGATE", url=SITE + "/{{item.id}}"), fields(t="p"), source="context", contextPath="got.rows"), responses=responses)
    assert [x for x in placed(done, "t") if x[0]] == [("A",), ("B",), ("C",)]
    done = run(spark, pages, ask, step("WEBSITE", url=SITE + "/{{got.body.home}}"), fields(t="p", u="{{api.status}}"), responses=responses)
    assert placed(done, "t")[-1] == ("B",)
    done = run(spark, pages, ask, loop("list", step("NAVIGATE", url=SITE + "/{{item.id}}"), fields(t="p"), source="context", contextPath="got.body.data"), responses=responses)
    assert placed(done, "t")[-1] == ("C",) and len(placed(done, "t")) == 4
    exposed = {**ask, "config": {**ask["config"], "exposeBodyAsExtracted": True}}
    done = run(spark, pages, exposed, step("WEBSITE", url=SITE + "/{{extracted.home}}"), fields(t="p"), responses=responses)
    assert placed(done, "t")[-1] == ("B",)


def test_next_links_by_doubling(spark):
    rng = random.Random(3)
    for n, most in ((40, 1000), (40, 7), (1, 5), (300, 1000)):
        nxt = {i: rng.randrange(n + 2) for i in range(n) if rng.random() < 0.95}
        starts = [rng.randrange(n) for _ in range(3)]
        want = {}
        for s in starts:
            at, d = s, 0
            while at is not None and d < most and want.get(at, most) > d:
                want[at] = d
                at, d = nxt.get(at), d + 1
        links = spark.createDataFrame([(str(a), str(b)) for a, b in nxt.items()], "url string, next string")
        got = follow_links(spark.createDataFrame([(str(s),) for s in starts], "url string"), links, most)
        assert {int(r.url): r._page for r in got.collect()} == want


def test_a_chain_of_ten_thousand_pages(spark, monkeypatch):
    from rowloom.plans import compiler

    rounds = []
    real = compiler.cut_lineage
    monkeypatch.setattr(compiler, "cut_lineage", lambda df, name: rounds.append(name) or real(df, name))
    links = spark.range(10_000).select(F.col("id").cast("string").alias("url"), (F.col("id") + 1).cast("string").alias("next"))
    got = follow_links(spark.createDataFrame([("0",)], "url string"), links, 10_000)
    assert got.count() == 10_000 and got.agg(F.max("_page")).first()[0] == 9999
    assert rounds.count("followed") <= 15


def test_marks_and_lists():
    found = []
    marked = context.mark({"a": ["x{{item.b}}", 3], "c": "plain"}, found)
    assert found == ["x{{item.b}}"] and context.fill(marked, ["xy"]) == {"a": ["xy", 3], "c": "plain"} and context.fill(marked, None) == marked
    assert context.keys("a.b[2].c") == ["a", "b", "2", "c"] and context.heads({"x": ["{{ a.b }}", "{{c[0]}}"]}) == {"a", "c"}
    assert list_lines(" a \n\nb") == ["a", "b"]
    assert list_lines('u,n\n1,"x, y"\n2', ",", True) == [{"u": "1", "n": "x, y", "value": "1", "text": '1,"x, y"'}, {"u": "2", "n": "", "value": "2", "text": "2"}]


def test_records_are_the_scope_of_data_steps(spark):
    shop = '<div class=c><div itemscope itemtype="https://schema.org/Product"><b itemprop=name>{0}</b></div><h2>{0}</h2><i class=price>$ {1}.00</i></div>'
    pages = site(spark, p=shop.format("Pot", 3) + shop.format("Pan", 4) + "<div class=c>none</div>")
    home = step("WEBSITE", url=f"{SITE}/p")
    done = run(spark, pages, home, loop("elements", step("PAGE_DATA", source="microdata"), selector="div.c"))
    assert [(r, "Pot" in d, "Pan" in d) for r, d in placed(done, "_record", "record")] == [(0, True, False), (1, False, True)]
    done = run(spark, pages, home, loop("elements", step("AUTO_EXTRACT", schema="name"), selector="div.c"))
    assert [n for (n,) in placed(done, "name")][:2] == ["Pot", "Pan"]
    done = run(spark, pages, home, loop("elements", step("PAGE_DATA", source="microdata", type="{{item.none}}Product"), selector="div.c:nth-child(2)"))
    assert len(placed(done, "record")) == 1 and "Pan" in placed(done, "record")[0][0]
