from rowloom.functions import text_schema as TS
from rowloom.html import autoextract as A
from rowloom.html.tree import parse
from rowloom.sources import pages as S

LD = '<script type="application/ld+json">{"@type":"Product","name":" W ","offers":[{"price":9.5,"priceCurrency":"EUR","availability":"https://schema.org/InStock"}],"image":["a.png",{"url":"b.png"}],"brand":{"name":"B"},"sku":"S1","aggregateRating":{"ratingValue":4.5,"ratingCount":7}}</script>'
MICRO = '<div itemscope itemtype="https://schema.org/Product"><b itemprop=name>M</b><span itemtype="x/Offer"><i itemprop=price content="3.00">3</i></span></div>'
OG = '<meta property="og:title" content="O"><meta property="og:image" content="/o.png">'
PLAIN = '<body><nav><h1>no</h1></nav><h1 class="product-title">Widget</h1><span class="sale-price">$25.50</span><s class="old-price">$30</s><div class="brand">Acme</div><img src="/w.png"><img src="/logo.png"><p class="product-description">Fine.</p></body>'


def test_layers():
    method, record = A.structured(parse(OG + MICRO + LD))
    assert method == "json-ld" and record["price"] == "9.5" and record["images"] == ["a.png", "b.png"] and record["availability"] == "In Stock" and record["reviewCount"] == "7" and record["name"] == "W"
    assert A.structured(parse(OG + MICRO)) [0] == "microdata" and A.structured(parse(OG + MICRO))[1]["price"] == "3.00"
    assert A.structured(parse(OG))[0] == "og-meta" and A.structured(parse("<p>x</p>")) is None
    values, sure = A.heuristics(parse(PLAIN), "https://s.test/")
    assert (values["name"], values["price"], values["originalPrice"], values["brand"], values["currency"], values["images"]) == ("Widget", "$25.50", "$30", "Acme", "USD", ["https://s.test/w.png"])
    assert sure["price"] == 100 and sure["currency"] == 70
    both = A.merged(A.structured(parse(OG)), (values, sure))
    assert both["from"]["name"] == "og-meta" and both["from"]["price"] == "heuristic" and both["confidence"]["name"] == 90


def test_schema_and_model(spark):
    article = '<html><head><meta property="og:section" content="News"><script type="application/ld+json">{"@type":"Article","headline":"H","datePublished":"2024-01-02","author":{"name":"Ann"},"keywords":["a","b"]}</script></head><body><p>Price is 1,299.00 today by Grace Hopper.</p></body></html>'
    pages = spark.createDataFrame([(1, "https://s.test/", article, '```json\n{"cost": "1299", "editor": "Nobody Here"}\n```'), (2, "https://s.test/", PLAIN, None), (3, None, None, None)], "page_id int, url string, html string, answer string")
    rows = {r.page_id: r for r in S.auto_extract(pages, ["published date", "author", "section", "cost", "editor"], model_col="answer").collect()}
    one = rows[1]
    assert (one["published date"], one.author, one.section, one.cost, one.editor) == ("2024-01-02", "Ann", "News", "1299", None)
    assert "published date=json-ld(datePublished):95" in one._provenance and "cost=llm:60 verified" in one._provenance and "editor=none" in one._provenance and one._needs_model
    assert rows[3]._extractionMethod == "none" and rows[3]._confidence == 0
    product = {r.page_id: r for r in S.auto_extract(pages.drop("answer")).collect()}
    assert product[2].name == "Widget" and product[2]._extractionMethod == "heuristic" and product[2].images == "https://s.test/w.png"


def test_python_and_column_schema_mapping_agree(spark):
    from pyspark.sql import functions as F

    from rowloom.functions import similarity as SIM

    node = {"datePublished": 1, "headline": "x", "authorName": "y", "price": None, "originalPrice": 3}
    fields = ["published date", "title", "author", "price", "original price"]
    values, matched = TS.map_node(node, fields)
    usable = [k for k in node if TS.flat_value(node[k]) is not None]
    got = spark.range(1).select(SIM.map_to_schema(F.array(*map(F.lit, node)), fields, F.array(*map(F.lit, usable)))).first()[0]
    assert {r.field: r.key for r in got if r.key} == matched and set(values) == set(matched)


def test_model_answers_and_simplified_text():
    assert A.parse_model_answer('```json\n{"a": 1}\n```') == {"a": 1} and A.parse_model_answer('sure: {"a": 2} ok') == {"a": 2}
    assert A.parse_model_answer("[1]") is None and A.parse_model_answer(None) is None
    scored = '{"name": " W ", "price": 5.0, "images": ["a", null, "b"], "brand": "", "confidence": {"name": "95", "price": 140, "brand": 70}}'
    assert A.model_cells(scored, ["name", "price", "images", "brand", "sku"], False) == [("W", 95), ("5", 80), ("a, b", 80), (None, 70), (None, 0)]
    assert A.model_cells(scored, ["name", "price", "sku"], True) == [("W", 95), ("5", 100), (None, 0)] and A.model_cells("no", ["x"], True) == [(None, 0)]
    assert A.simplified_text(parse(PLAIN)).startswith("Widget$25.50")
