"""Selectors over node arrays find what the tree's own find, on all pages."""

import pytest
from pyspark.sql import functions as F

from rowloom.html import nodes
from rowloom.html.select import SelectorError, select
from rowloom.html.tree import parse
from rowloom.sources import pages

SELECTORS = [
    "a", "*", "nav > ul > li", "nav a", "body div p", "li:nth-child(2n+1)", "li:nth-child(2) ~ li a", "h1 + p, h1 ~ div", "li:first-child", "li:last-child > a", "a[href]", "a[href^='/']", "a[href*='e' i]",
    "p:not(.x)", "ul li:nth-last-child(-n+2)", "div:has(> p)", "article:has(b)", "p:nth-of-type(2)", ".a.b > i", "#k i:only-child", "[class~=b]", "[lang|=en]", "p:empty, :root > body", "div p i:is(.z, .y)", "i:nth-of-type(odd)",
    "template b", "b b", "div div > p ~ i",
    "//a", "//nav/ul/li[2]/a", "//li[last()]", "//div[@class='x']//b", "//b/..", "//b/ancestor::div", "//li[position()<3]", "//p[contains(text(), 'a')]", "//a[starts-with(@href,'/a')]", "//i[@class and not(@id)]",
    "xpath=/html/body/*", "//h1/following-sibling::p", "//p/preceding-sibling::h1 | //b", "//ul//a[@href]", "//p[text()='two']", "//b/parent::p", "//*[@id='k' or @class='q']", "//i/ancestor-or-self::*",
]

HARD = """<html lang=en-GB><body><div id=k class="a b"><p>one<i class=z>1</i></p><p class=x>two</p><p></p><i class="y a b">3<i>4</i></i></div>
<div class=q><div><p>a</p><i></i><p>b<b>c<b>d</b></b></p><i id=i class=z></i></div></div><template><b>t</b></template>
<ul><li><a href=/a1>x</a><li><a href=b>y</a><li>z</ul><h1>t</h1><p>a</p><p>b</p><div class=x><p><b>deep</b></p></div></body></html>"""


def found(spark, df, selectors):
    rows = pages.select_all(df, {f"s{i}": s for i, s in enumerate(selectors)}).collect()
    return {r.url: [[n.pre for n in r[f"s{i}"]] for i in range(len(selectors))] for r in rows}


def wanted(html, selectors):
    tree = parse(html)
    order = {id(n): i for i, n in enumerate(list(tree.walk())[1:])}
    return [[order[id(n)] for n in select(tree, s)] for s in selectors]


@pytest.mark.parametrize("part", [0, 1, 2])
def test_all_pages_and_hard_ones(spark, part):
    own = SELECTORS[part::3]
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("url", "html").withColumn("url", F.concat("url", F.lit(" "), F.xxhash64("html").cast("string")))
    hard = spark.createDataFrame([("hard", HARD), ("empty", ""), ("text", "just text"), ("two", "<p>x</p><p>two</p><b>y</b>")], "url string, html string")
    both = table.unionByName(hard)
    got = found(spark, both, own)
    for r in both.collect():
        assert got[r.url] == wanted(r.html or "", own), r.url


def test_one_parse_and_no_shuffle(spark):
    df = spark.createDataFrame([("u", HARD)], "url string, html string")
    plan = pages.select_all(df, {"a": "div p", "b": "//b/..", "c": "li + li"})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan


def test_what_needs_whole_texts_is_refused(spark):
    for bad in ("//p[contains(., 'x')]", "//p[@a][2]", "p:has(a b)", "p::before", "//p[count(b)=1]", "div >", "", "//a/following::b"):
        with pytest.raises(SelectorError):
            nodes.matches(F.col("nodes"), bad)


def test_node_table(spark):
    df = spark.createDataFrame([("u", "<div><p>a</p><p>b</p></div>")], "url string, html string")
    rows = pages.node_table(df).orderBy("pre").collect()
    assert [(r.tag, r.post - r.pre, r.own_text) for r in rows if r.tag in ("div", "p")] == [("div", 2, ""), ("p", 0, "a"), ("p", 0, "b")]
    for r in rows:
        assert r.post >= r.pre and (r.parent is None or r.parent < r.pre)
