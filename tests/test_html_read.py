import json

import pytest

from rowloom.html import read
from rowloom.html.select import scoped, select
from rowloom.html.tree import parse
from rowloom.sources import pages as S

LIST = """<html><head><title> T  x </title></head><body><nav><a href="/n">n</a></nav>
<ul class="list"><li class="item a" data-k="1"><h2>One</h2><span class="price">1</span></li><li class="item"><h2>Two</h2></li><li class="item b"><h2>Three</h2><span class="price">3</span></li></ul>
<p id="x">para <b>bold</b></p><div id=host><template shadowrootmode="open"><em class=deep>hidden</em></template></div></body></html>"""


@pytest.mark.parametrize(
    "selector,want",
    [
        ("li.item", 3), ("li:nth-child(2) h2", "Two"), ("li:nth-child(odd)", 2), ("li:last-child > h2", "Three"), ("li:not(.a)", 2), ("li:has(.price)", 2), ("[data-k='1'] h2", "One"), ("h2, .price", 5), ("ul > li + li", 2), ("li ~ li:first-of-type", 0),
        ("#x b", "bold"), (".list [class~=b] h2", "Three"), ("a[href^='/']", 1), ("li:nth-of-type(3n)", 1), ("//li[2]/h2", "Two"), ("//li[@data-k]", 1), ("//li[contains(., 'Three')]/span", "3"), ("(//h2)[last()]", "Three"), ("//li[not(span)]", 1),
        ("xpath=//p[@id='x' and contains(@id,'x')]/b", "bold"), (".//li[h2='Two']", 1), ("//h2/../span", 2), ("#host >>> em", "hidden"), ("em.deep", "hidden"), ("li:::", 0), ("(", 0), (":is(h2, b)", 4), ("li:nth-last-child(1)", 1), ("//li[position()<3]", 2), ("//h2/following-sibling::span", 2),
    ],
)
def test_selectors(selector, want):
    found = select(parse(LIST), selector)
    assert (len(found) if isinstance(want, int) else [n.text() for n in found]) == (want if isinstance(want, int) else [want])


def test_scoping():
    doc = parse(LIST)
    second = select(doc, "li")[1]
    assert [n.text() for n in scoped(doc, "h2", second)] == ["Two"]
    assert [n.text() for n in scoped(doc, ".price", second)] == ["1", "3"]
    assert scoped(doc, ":scope > .price", second) == [] and [n.text() for n in scoped(doc, "1", second)] == ["Two"]
    assert scoped(doc, "", second) == [second] and scoped(doc, "", None) == []


def test_row_assembly(spark):
    pages = spark.createDataFrame([(1, "https://s.test/a", LIST), (2, "https://s.test/b", "<p>none</p>")], "page_id int, url string, html string")
    fields = [{"name": "title", "selector": "h2"}, {"name": "price", "selector": ".price"}, {"name": "page", "selector": "title"}, {"name": "n", "selector": "ul", "type": "count", "countSelector": "li"}, {"name": "link", "selector": "nav a", "type": "attribute", "attribute": "href"}]
    rows = sorted(S.extract(pages, fields).collect())
    assert [(r.title, r.price, r.page, r.n, r.link) for r in rows if r.page_id == 1] == [("One", "1", "T  x", "3", "/n"), ("Two", "3", "T  x", "3", "/n"), ("Three", None, "T  x", "3", "/n")]
    assert [tuple(r)[4:] for r in rows if r.page_id == 2] == [(None,) * 5]
    looped = S.extract(pages, [{"name": "t", "selector": "h2"}, {"name": "p", "selector": ".price"}], loop="li", fallback=False)
    assert sorted((r._record, r.t, r.p) for r in looped.collect()) == [(0, "One", "1"), (1, "Two", None), (2, "Three", "3")]
    assert S.extract(pages, []).count() == 0
    for bad in ({"type": "attribute"}, {"type": "count"}, {"type": "count", "countSelector": "(("}, {"type": "x"}):
        with pytest.raises(ValueError):
            S.extract(pages, [{"name": "f", "selector": "p"} | bad])


def test_value_reader():
    doc = parse('<input value=v><input type=checkbox value=y checked><input type=radio value=z><textarea> t </textarea><select><option value=1>a<option selected>b</select><select multiple><option selected value=1>a<option selected>b</select><img src="/i.png"><a href="/l"> </a><video><source src="v.mp4"></video><div><i>x</i>y</div>')
    text = {"type": "text"}
    got = [read.value_of(n, text, "https://s.test/p/") for n in doc.elements()]
    assert got == ["v", "y", "", " t ", "b", "1, b", "https://s.test/i.png", "https://s.test/l", "https://s.test/p/v.mp4", "xy"]
    assert read.value_of(doc.elements()[-1], {"type": "html"}) == "<i>x</i>y"


LD = """<html><head><title>P</title><meta property="og:image" content="/i.png"><meta name="description" content=" d  e "><meta name="x" content="no">
<script type="application/ld+json">{"@context":"c","@graph":[{"@type":"Product","name":"W","offers":{"price":9.5,"tags":["a","b"]}},{"@type":["Thing","Book"]}]}</script>
<script type="application/ld+json">{bad</script></head><body><div itemscope itemtype="https://schema.org/Event"><span itemprop=name>E</span></div></body></html>"""


def test_page_data():
    d = read.page_data(parse(LD), "https://s.test/")
    assert [r.get("@type") for r in d["records"]] == ["Product", ["Thing", "Book"]] and d["sources"] == ["json-ld", "meta"] and len(d["warnings"]) == 1
    assert d["meta"] == {"og:image": "https://s.test/i.png", "description": "d e"}
    assert [r["name"] for r in read.page_data(parse(LD), None, "microdata")["records"]] == ["E"]
    assert len(read.page_data(parse(LD), None, kind="book")["records"]) == 1
    assert read.page_data(parse(LD), None, flat=True)["records"][0] == {"@type": "Product", "name": "W", "offers.price": 9.5, "offers.tags": "a, b"}
    assert not read.page_data(parse("<p>x</p>"), None)["found"]
    micro = '<div itemscope itemtype="https://schema.org/Product"><span itemprop=name>A</span><i itemprop=tag>x</i><i itemprop=tag>y</i><time itemprop=d datetime=2024>now</time><a itemprop=u href=/p>l</a><div itemprop=offer itemscope itemtype=x/Offer><b itemprop=price content=5>five</b></div></div>'
    assert read.microdata(parse(micro), "https://s.test/") == [{"@type": "Product", "name": "A", "tag": ["x", "y"], "d": "2024", "u": "https://s.test/p", "offer": {"@type": "Offer", "price": "5"}}]


def test_page_json():
    tree = read.page_json(parse(LIST), None)["tree"]
    assert tree["tag"] == "body" and tree["children"][0]["children"][0]["attrs"]["href"] == "/n"
    flat = read.page_json(parse(LIST), "https://s.test/", "flat", "ul")["rows"]
    assert flat[1]["path"] == "li.item" and flat[2]["text"] == "One"
    assert read.page_json(parse(LIST), None, "text", "#x")["text"] == ["para", "bold"]
    short = read.page_json(parse(LIST), None, "flat", max_nodes=3)
    assert short["truncated"] and "more than 3" in short["reason"] and len(short["rows"]) == 3
    assert "deeper than 1" in read.page_json(parse(LIST), None, max_depth=1)["reason"]
    assert not read.page_json(parse(LIST), None, selector=".zz")["found"] and "cannot be parsed" in read.page_json(parse(LIST), None, selector="((")["reason"]


def test_page_operators(spark):
    pages = spark.createDataFrame([(1, "https://s.test/", LD), (2, "https://s.test/", LIST), (3, None, None)], "page_id int, url string, html string")
    data = {r.page_id: r.data for r in S.page_data(pages).collect()}
    assert json.loads(data[1].records[0])["name"] == "W" and data[2].found is False and data[3].found is False
    assert {r.page_id: r["count"] for r in S.query_count(pages, "li").collect()} == {1: 0, 2: 3, 3: 0}
    items = sorted(S.loop_items(pages, "li").collect(), key=lambda r: r.loop["index"])
    assert [(r.item["data-k"] if "data-k" in r.item else None, r.loop.first, r.loop.last, r.loop["count"]) for r in items] == [("1", True, False, 3), (None, False, False, 3), (None, False, True, 3)]
    nodes = S.node_table(pages.where("page_id = 2"))
    ul = nodes.where("tag = 'ul'").first()
    assert nodes.where(f"pre > {ul.pre} AND pre <= {ul.post} AND tag = 'h2'").count() == 3
    texts = S.page_json(pages, "text").where("page_id = 2").first().page.text
    assert texts[:3] == ["n", "One", "1"]
    from pyspark.sql import functions as F

    flat = spark.createDataFrame([('{"a":{"b":[1,2.0,true]},"c":null}',), ("nope",), (None,)], "j string").select(S.flatten_json(F.col("j")).alias("m")).collect()
    assert [r.m for r in flat] == [{"a.b": "1, 2, true"}, None, None]
