"""Queries that take every row of their tables, where an earlier one has a filter or cap in its oracle."""

import os
import sys
from html.parser import HTMLParser
from urllib.parse import quote, urljoin, urlsplit

sys.path[:0] = [os.path.dirname(__file__), os.path.dirname(os.path.dirname(os.path.abspath(__file__)))]
from helpers import SF, compare  # noqa: E402

from rowloom.plans.catalogue import ORACLES, QUERIES  # noqa: E402


class Hrefs(HTMLParser):
    def __init__(self, html):
        super().__init__()
        self.found = []
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        self.found += [v for k, v in attrs if k == "href"]


def resolved(base, href):
    u = urlsplit(urljoin(base, href))
    return f"{u.scheme}://{u.netloc.lower()}{quote(u.path or '/', safe="/%:@!$&'()*+,;=~-._")}" + f"?{u.query}" * bool(u.query) + f"#{u.fragment}" * bool(u.fragment)


def test_every_href_is_resolved(spark, tmp_path):
    made = [(1, "https://A.test/x/y?q=1#f", '<a href="/für">1</a><p><a href="/the,">2</a></p><a href="z.">3</a><link href="?page=2">'), (2, "http://b.test", '<nav><a href="//c.test/é(1)!">1</a><a href="/p?a=1&b=2#top">2</a></nav>'), (3, "http://b.test/", "<p>none</p>")]
    spark.createDataFrame(made, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    for folder in (str(tmp_path), SF):
        pages = spark.read.parquet(f"{folder}/pages.parquet").collect()
        want = sorted((p.page_id, h, resolved(p.url, h)) for p in pages for h in Hrefs(p.html).found)
        got = sorted(map(tuple, QUERIES["tf_url_every_href"](spark, folder).collect()))
        assert got == want


def test_stores_and_tables_take_every_order(spark):
    orders = {r.o_orderkey: r.o_custkey for r in spark.read.parquet(f"{SF}/orders.parquet").collect()}
    merged = QUERIES["export_merge_all_orders"](spark, SF).collect()
    assert {r.o_custkey for r in merged} == set(orders.values()) and {r.o_orderkey for r in merged} >= {k for k in orders if k % 3 == 0}
    sizes = {}
    for c in orders.values():
        sizes[c] = sizes.get(c, 0) + 1
    found = {r.o_custkey: r.n for r in QUERIES["detect_table_customers"](spark, SF).collect()}
    assert found == {c: n if n >= 3 else 0 for c, n in sizes.items()}
    for name in ("export_merge_all_orders", "detect_table_customers"):
        compare(QUERIES[name](spark, SF), ORACLES[name])


def test_flagship_finds_addresses_in_long_texts(spark, tmp_path):
    texts = ["word " * 5_000 + "jo@mail.test end", "x" * 300_000 + " a@b.test", "@x.test ..a.b@c-d.e.org, z@z", "none" + "@" * 50, "a@b a%b@c.de@f.gh", "short me@here.test 5"]
    rows = [(i, t, "en", "s") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.email for r in QUERIES["flagship_clean_dedupe_jsonl"](spark, str(tmp_path)).collect()}
    assert got == {0: "jo@mail.test", 1: "a@b.test", 2: "..a.b@c-d.e.org", 3: None, 4: "a%b@c.de", 5: "me@here.test"}
