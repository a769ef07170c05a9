"""Small literal cases of value functions, each with its known answer."""

import zlib

from pyspark.sql import functions as F

from rowloom.functions import grounding as G
from rowloom.functions import similarity as S
from rowloom.functions import transforms as T
from rowloom.sinks import render
from rowloom.sources import api, lists, pdf


def test_numbers(spark):
    want = {"1.234,56 €": 1234.56, "€ 9,99": 9.99, "1.4E7": 1.4e7, "3 EUR": 3, "Out of stock": None, "$25.50": 25.5, "1,234 reviews": 1234, "1,234,567.89": 1234567.89, "-5": -5, "": None, "9e999": 9, "1 299,00": 1299, "2,5e3": 2500}
    rows = spark.createDataFrame([(v,) for v in want], "v string").select("v", T.number(F.col("v")).alias("n")).collect()
    assert {r.v: r.n for r in rows if r.n != want[r.v]} == {}


def test_schema_mapping(spark):
    nodes = spark.createDataFrame([(1, "datePublished,headline,author"), (2, "productName,price,originalPrice,sku"), (3, "@type,zzz")], "node int, keys string")
    each = nodes.select("node", F.explode(S.map_to_schema(F.split("keys", ","), ["published date", "title", "price"])).alias("m")).select("node", "m.field", "m.key")
    assert {(r.node, r.field): r.key for r in each.collect() if r.key} == {(1, "published date"): "datePublished", (2, "price"): "price"}


def test_schema_rows_by_distinct_key_sets(spark):
    rows = spark.createDataFrame([(1, '{"Name":"a","x":1}'), (2, '{"name":null,"name ":"b"}'), (3, None), (4, "[1]"), (5, '{"name":{"first":"c"}}'), (6, '{"Name":"d","x":2}')], "i int, j string")
    for sent in (10, 0):
        got = {r.i: r.name for r in S.schema_rows(rows, "j", ["name"], sent).collect()}
        assert got == {1: "a", 2: "b", 3: None, 4: None, 5: '{"first":"c"}', 6: "d"} or got == {1: "a", 2: None, 3: None, 4: None, 5: '{"first":"c"}', 6: "d"}


def test_grounding(spark):
    page = "Acme Ltd v Bloggs. The price was £1,299.00 in total, on /p/9 of the file. Contract law; property"
    want = {"Acme Ltd": "exact", "1299": "number", "Grace Hopper 2026": "missing", "9": "unproven", "https://shop.test/p/9": "url", "https://shop.test/p/77": "missing", "contract, fraud": "missing", "Contract, Property": "parts", "": "exact", "zq": "unproven"}
    rows = spark.createDataFrame([(v,) for v in want], "v string").select("v", G.ground(F.col("v"), G.corpus(F.lit(page))).alias("how")).collect()
    assert {r.v: r.how for r in rows} == want


def test_provenance_and_confidence(spark):
    rows = [(1, "A", 98, "json-ld:headline", "exact"), (2, "B", 85, "meta:og:title", None), (3, "C", 70, "llm", "number"), (4, "5", 60, "llm", "unproven"), (5, None, 0, None, None), (6, "D", 40, "heuristic", None)]
    df = spark.createDataFrame(rows, "i int, v string, conf int, src string, how string")
    record = G.provenance("f", *(F.col(c) for c in ("v", "conf", "src", "how")))
    got = {r.i: r.c for r in df.select("i", G.provenance_column(F.array(record)).alias("c")).collect()}
    assert got == {1: "f=json-ld(headline):98", 2: "f=meta(og:title):85", 3: "f=llm:70 verified", 4: "f=llm:60", 5: "f=none", 6: "f=heuristic:40"}
    sure = spark.createDataFrame([(90, 80, None), (0, 0, 0), (95, 95, 95)], "a int, b int, c int")
    mean = G.weighted_confidence({"name": F.col("a"), "price": F.col("b"), "images": F.col("c")}, S.PRODUCT_WEIGHTS)
    assert [r.m for r in sure.select(mean.alias("m")).collect()] == [67, 0, 95]


def test_judged_selectors_and_their_history(spark):
    seen = [(1, ".t", "Widget", 1, " widget ", None), (2, ".t", "Widget", 2, "x", None), (3, ".t", "Widget", 0, None, None), (4, "div > p", "W", 1, "V", None), (5, "..", "W", None, None, "bad"), (6, ".t", None, 1, "x", None)]
    df = spark.createDataFrame(seen, "i int, selector string, expected string, n int, text string, error string")
    judged = df.withColumn("status", G.judge_selector(*(F.col(c) for c in ("selector", "expected", "n", "text", "error"))))
    assert {r.i: r.status for r in judged.collect()} == {1: "verified", 2: "ambiguous", 3: "not-found", 4: "wrong-value", 5: "bad-selector", 6: None}
    runs = [("f", "p:nth-child(2)", "verified")] * 5 + [("f", ".t", "verified")] * 2 + [("f", ".t", "not-found")] + [("f", "#b", "verified"), ("f", "#b", "wrong-value"), ("g", ".x", "not-found")]
    parts = [spark.createDataFrame(runs[k::2], "field string, selector string, status string") for k in (0, 1)]
    merged = G.merge_histories(*(G.selector_history(p, ["field"]) for p in parts), ["field"])
    whole = G.selector_history(parts[0].unionByName(parts[1]), ["field"])
    assert sorted(map(tuple, merged.collect())) == sorted(map(tuple, whole.collect()))
    assert [tuple(r) for r in G.learnt_selectors(merged, ["field"]).collect()] == [("f", ".t", False, 2, 3)]


def test_header_order(spark):
    texts = spark.createDataFrame([(1, "a=1"), (2, "b=2,a=3"), (3, "c=,b=1")], "seq int, text string")
    rows = texts.select("seq", F.str_to_map("text", F.lit(","), F.lit("=")).alias("row"))
    assert {r.key: (r.seq, r.pos) for r in render.header_order(rows, "seq").collect()} == {"a": (1, 0), "b": (2, 0), "c": (3, 0)}


def test_pages_of_recorded_responses(spark):
    bodies = ['{"data":[{"id":1},{"id":2}],"next_cursor":"b"}', '{"data":[{"id":3}],"next_cursor":"c"}', '{"data":[{"id":4}]}', '{"data":[{"id":5}]}']
    more = ['</2>; rel="next"', '</3>; rel="last", </3>; rel=next', '</1>; rel="prev"', None]
    df = spark.createDataFrame([("r", i + 1, b, 200, m) for i, (b, m) in enumerate(zip(bodies, more, strict=True))], "run string, seq int, body string, status int, link string")
    for mode, ids in (("cursor", [1, 2, 3, 4]), ("page", [1, 2, 3, 4, 5]), ("link", [1, 2, 3, 4]), ("none", [1, 2])):
        rows = api.rows_at(api.recorded_pages(df, mode, "data", "next_cursor"), "body", "data")
        assert sorted(r.id for r in rows.select(F.get_json_object("row", "$.id").cast("int").alias("id")).collect()) == ids


def test_retries(spark):
    asked = [(1, 503, 1, 0, None, 1000), (2, 503, 3, 3000, None, 4000), (3, 429, 1, 0, 90, 60000), (4, 404, 1, 0, None, None), (5, 500, 4, 7000, None, None), (6, 500, 2, 59500, 2, 500), (7, 200, 1, 0, None, None)]
    df = spark.createDataFrame(asked, "i int, status int, attempt int, waited_ms int, retry_after_s int, want int")
    assert all(r.wait_ms == r.want for r in api.retry_schedule(df).collect())


def test_pasted_lists(spark):
    lines = spark.createDataFrame(list(enumerate(["url,sku", '"Smith, John",42,"x"', "", '12" pipe,steel', '"a ""b""",c'])), "n int, line string")
    items, left = lists.parse_list(lines, "n", delimiter=",", has_header=True)
    assert [(r["index"], r.cols["url"], r.cols["sku"]) for r in items.orderBy("index").collect()] == [(1, "Smith, John", "42"), (2, '12" pipe', "steel"), (3, 'a "b"', "c")] and left == 0


def test_compressed_price_lists(spark):
    rows = [("Name", "Price"), ("Widget", "10.00"), ("Gadget", "20.00")]
    text = " ".join(f"BT 1 0 0 1 72 {700 - 20 * i} Tm ({a}) Tj ET BT 1 0 0 1 200 {700 - 20 * i} Tm ({b}) Tj ET" for i, (a, b) in enumerate(rows)).encode()
    body = zlib.compress(text)
    content = b"%PDF-1.4\n1 0 obj\n<< /Filter /FlateDecode /Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream\nendobj\n"
    each = pdf.extract_pdf(spark.createDataFrame([("a.pdf", bytearray(content))], "path string, content binary")).select("path", F.explode("pages").alias("p")).select("path", "p.page", "p.items")
    got = pdf.tables(each).select(F.get_json_object("record", "$.Name").alias("name"), F.get_json_object("record", "$.Price").alias("price")).collect()
    assert sorted(map(tuple, got)) == sorted(rows[1:])
