"""Queries over the steps and stores of runs: each on whole tables, with pages, captures and files made of them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowloom.functions import grounding as G
from rowloom.functions import predicates as P
from rowloom.html.nodes import matches
from rowloom.operators import search
from rowloom.plans.catalogue import query, table
from rowloom.plans.compiler import Sources, compile_recipe, counters
from rowloom.plans.runs import run_recipe
from rowloom.session import shared_dir
from rowloom.sinks import runs
from rowloom.sources import lists, pages, pdf
from rowloom.streaming import buffer, pacing


def _scratch(spark, name):
    return f"{shared_dir(spark)}/rowloom/{name}-{uuid.uuid4().hex}"


def _parts(spark, sf_dir, html):
    """A page for each part."""
    address = F.concat(F.lit("https://s.test/p/"), F.col("p_partkey").cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", address.alias("url"), html.alias("html"))


def _ld(kind="Product", extra=""):
    record = F.concat(F.lit(f'{{"@type":"{kind}","name":"'), "p_name", F.lit('","brand":{"name":"'), "p_brand", F.lit('"},"offers":{"price":"'), F.col("p_size").cast("string"), F.lit(f'.50","priceCurrency":"EUR"}}{extra}}}'))
    return F.concat(F.lit('<script type="application/ld+json">'), record, F.lit("</script>"))


# ---- structured data ------------------------------------------------------------------------------------------------


@query("page_data_auto", "SELECT p_partkey, p_name AS name, CASE p_partkey % 3 WHEN 0 THEN 'json-ld' WHEN 1 THEN 'microdata' ELSE 'json-ld' END AS source FROM part")
def page_data_auto(spark, sf_dir):
    """JSON-LD before microdata, which counts only where there is no JSON-LD."""
    micro = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Product"><b itemprop="name">'), F.when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise("other"), F.lit("</b></div>"))
    html = F.concat(F.when(F.col("p_partkey") % 3 != 1, _ld()).otherwise(""), F.when(F.col("p_partkey") % 3 > 0, micro).otherwise(""))
    data = pages.page_data(_parts(spark, sf_dir, html)).select("p_partkey", F.explode("data.records").alias("r"), F.col("data.sources")[0].alias("source"))
    return data.select("p_partkey", F.get_json_object("r", "$.name").alias("name"), "source")


@query("page_data_type", "SELECT p_partkey, p_name AS name FROM part WHERE p_size % 2 = 0")
def page_data_type(spark, sf_dir):
    """Only records of the type that is asked for, by a recipe."""
    html = F.when(F.col("p_size") % 2 == 0, _ld("Book")).otherwise(_ld("Product"))
    recipe = {"steps": [{"type": "WEBSITE"}, {"type": "PAGE_DATA", "config": {"source": "jsonld", "type": "book"}}]}
    rows = compile_recipe(spark, recipe, Sources(pages=_parts(spark, sf_dir, html))).rows
    return rows.select("p_partkey", F.get_json_object("record", "$.name").alias("name"))


@query("page_json_tree", "SELECT p_partkey, 'div' AS tag, p_name AS text FROM part")
def page_json_tree(spark, sf_dir):
    html = F.concat(F.lit("<body><div class=x><p>"), "p_name", F.lit("</p></div></body>"))
    found = pages.page_json(_parts(spark, sf_dir, html), "tree", selector="div.x")
    return found.select("p_partkey", F.regexp_extract("page.tree", '"tag": ?"([a-z]+)"', 1).alias("tag"), F.regexp_extract("page.tree", '"text": ?"([^"]+)"', 1).alias("text"))


@query("auto_extract_schema", "SELECT p_partkey, p_name AS title, p_brand AS maker, CASE WHEN p_size % 2 = 0 THEN p_type END AS kind, p_size % 2 = 1 AS needs FROM part")
def auto_extract_schema(spark, sf_dir):
    """Fields of one's own, out of JSON-LD and meta tags; a page without an answer to one needs a model."""
    record = F.concat(F.lit('<script type="application/ld+json">{"@type":"Thing","title":"'), "p_name", F.lit('"}</script>'))
    tags = F.concat(F.lit('<meta name="maker" content="'), "p_brand", F.lit('">'), F.when(F.col("p_size") % 2 == 0, F.concat(F.lit('<meta name="kind" content="'), "p_type", F.lit('">'))).otherwise(""))
    html = F.concat(F.lit("<head>"), record, tags, F.lit("</head>"))
    found = pages.auto_extract(_parts(spark, sf_dir, html), ["title", "maker", "kind"])
    return found.select("p_partkey", "title", "maker", "kind", F.col("_needs_model").alias("needs"))


@query("auto_extract_heuristic", "SELECT p_partkey, p_name AS name, '$ ' || p_size || '.50' AS price, 'USD' AS currency FROM part")
def auto_extract_heuristic(spark, sf_dir):
    """Products read off class names and money signs, on pages without structured data."""
    html = F.concat(F.lit('<main><h1 class="product-title">'), "p_name", F.lit('</h1><span class="price">$ '), F.col("p_size").cast("string"), F.lit(".50</span></main>"))
    found = pages.auto_extract(_parts(spark, sf_dir, html))
    return found.select("p_partkey", "name", "price", "currency")


@query("auto_extract_model", "SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_type END AS kind FROM part")
def auto_extract_model(spark, sf_dir):
    """A model's answers: what the page's text bears out fills empty fields, what it does not is dropped."""
    html = F.concat(F.lit('<script type="application/ld+json">{"@type":"Thing","title":"'), "p_name", F.lit('"}</script><p>It is '), "p_type", F.lit(" of its kind.</p>"))
    answer = F.concat(F.lit('```json\n{"title":"made up by a model","kind":"'), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).otherwise("invented thing"), F.lit('","confidence":{"title":50,"kind":70}}\n```'))
    made = _parts(spark, sf_dir, html).join(table(spark, sf_dir, "part").select("p_partkey", answer.alias("said")), "p_partkey")
    return pages.auto_extract(made, ["title", "kind"], model_col="said").select("p_partkey", "title", "kind")


@query("provenance_summary", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '1 from the page, 1 empty.' WHEN p_size % 3 = 1 THEN '1 from the page, 1 from a model (1 verified).' ELSE '1 from the page, 1 from a model.' END AS summary FROM part")
def provenance_summary(spark, sf_dir):
    first = G.provenance("name", F.col("p_name"), F.lit(98), F.lit("json-ld:name"), F.lit("exact"))
    how = F.when(F.col("p_size") % 3 == 1, "exact").otherwise("unproven")
    second = G.provenance("kind", F.when(F.col("p_size") % 3 > 0, F.col("p_type")), F.lit(60), F.when(F.col("p_size") % 3 > 0, "llm"), how)
    return table(spark, sf_dir, "part").select("p_partkey", G.provenance_summary(F.array(first, second)).alias("summary"))


@query("shadow_roots", "SELECT p_partkey, p_name AS light, CAST(p_size AS VARCHAR) AS deep, 1 AS bolds FROM part")
def shadow_roots(spark, sf_dir):
    """Elements in declarative shadow roots: pierced by name, and left alone by a selector that the light tree answers."""
    html = F.concat(F.lit("<div id=host><b>"), "p_name", F.lit('</b><template shadowrootmode=open><i class=v>'), F.col("p_size").cast("string"), F.lit("</i><b>shadow</b></template></div>"))
    specs = [{"name": "light", "selector": "b"}, {"name": "deep", "selector": "#host >>> i.v"}]
    read = pages.extract(_parts(spark, sf_dir, html), specs).select("p_partkey", "light", "deep")
    counted = pages.with_nodes(_parts(spark, sf_dir, html)).select("p_partkey", F.size(matches(F.col("nodes"), "b")).alias("bolds"))
    return read.join(counted, "p_partkey")


# ---- conditions -----------------------------------------------------------------------------------------------------


@query(
    "assertions_all",
    """SELECT c_custkey, CAST(c_nationkey % 3 > 0 AS INT) AS e, CAST(c_nationkey % 3 = 0 AS INT) AS n, CAST(c_nationkey % 3 = 2 AS INT) AS eq, CAST(c_nationkey % 3 >= 1 AS INT) AS least,
    CAST(c_nationkey % 3 <= 1 AS INT) AS most, CAST(c_nationkey % 3 > 0 AND contains(c_name, '7') AS INT) AS has, CAST(c_nationkey % 3 > 0 AND c_mktsegment = 'BUILDING' AS INT) AS same FROM customer""",
)
def assertions_all(spark, sf_dir):
    """All seven assertions about what was counted and read for each customer."""
    count = F.col("c_nationkey") % 3
    held = lambda kind, text, **options: P.assertion(kind, count, text, "b", **options).isNull().cast("int")
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", held("exists", name).alias("e"), held("not-exists", name).alias("n"), held("count-equals", name, wanted="2").alias("eq"), held("count-at-least", name, wanted=1).alias("least"),
        held("count-at-most", name, wanted=F.lit("1")).alias("most"), held("text-contains", name, value="7").alias("has"), held("text-equals", segment, value=F.lit(" BUILDING ")).alias("same"),
    )


@query("looks_empty_rows", "SELECT doc_id, (text IS NULL OR text = '') AND (lang IS NULL OR lang = '') AS nothing FROM documents")
def looks_empty_rows(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", search.looks_empty(["text", "lang"]).alias("nothing"))


# ---- steps ----------------------------------------------------------------------------------------------------------


@query("api_sniffer_step", "SELECT event_id FROM events WHERE event_type IN ('view', 'purchase') AND event_id % 5 < 3")
def api_sniffer_step(spark, sf_dir):
    """A recipe's sniffer over captures made of events: by part of the address, method and kind of content."""
    kind = F.when(F.col("event_id") % 5 == 3, "image/png").when(F.col("event_id") % 5 == 4, "text/css").otherwise("application/json")
    address = F.concat(F.lit("https://s.test/API/"), "event_type", F.lit("?k="), F.col("user_id").cast("string"))
    method = F.when(F.col("event_type") == "view", "get").when(F.col("event_type") == "purchase", "Post").otherwise("DELETE")
    captures = table(spark, sf_dir, "events").select("event_id", address.alias("url"), method.alias("method"), kind.alias("type"))
    step = {"type": "API_SNIFFER", "config": {"urlFilter": "/api/view, /api/p", "methods": "GET post"}}
    return compile_recipe(spark, {"steps": [step]}, Sources(captures=captures)).rows.select("event_id")


@query("pdf_text", "SELECT p_partkey, p_name || ' ' || p_brand AS text FROM part")
def pdf_text(spark, sf_dir):
    """The text of a PDF file for each part, by a recipe."""
    words = F.concat(F.lit("BT 1 0 0 1 72 700 Tm ("), "p_name", F.lit(") Tj 0 -14 Td ("), "p_brand", F.lit(") Tj ET"))
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Length "), F.length(words).cast("string"), F.lit(" >>\nstream\n"), words, F.lit("\nendstream\nendobj\n"))
    files = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    rows = compile_recipe(spark, {"steps": [{"type": "PDF_EXTRACTION", "config": {"mode": "text"}}]}, Sources(files=files)).rows
    return rows.select(F.substring_index("path", ".", 1).cast("long").alias("p_partkey"), "text")


@query("recipe_numbered_pages", "SELECT c_custkey AS k FROM customer WHERE c_custkey BETWEEN 1 AND 1001 AND c_custkey % 2 = 1 AND c_custkey < coalesce((SELECT min(c_custkey) FROM customer WHERE c_custkey BETWEEN 1 AND 1001 AND c_custkey % 2 = 1 AND c_nationkey = 24 AND c_custkey > (SELECT min(c_custkey) FROM customer WHERE c_custkey % 2 = 1 AND c_nationkey <> 24)), 2000) AND c_nationkey <> 24")
def recipe_numbered_pages(spark, sf_dir):
    """Every second customer's page by its number, until one has no rows: customers of one nation have none."""
    key = F.col("c_custkey").cast("string")
    html = F.when(F.col("c_nationkey") == 24, F.lit("<p></p>")).otherwise(F.concat(F.lit("<ul><li>"), key, F.lit("</li></ul>")))
    made = table(spark, sf_dir, "customer").select(F.concat(F.lit("https://s.test/"), key).alias("url"), html.alias("html"))
    loop = {"type": "LOOP", "config": {"type": "paginate-url", "urlTemplate": "https://s.test/{page}", "startPage": 1, "pageStep": 2, "max": 501}, "children": [{"type": "PAGE_JSON", "config": {"mode": "text"}}]}
    return compile_recipe(spark, {"steps": [loop]}, Sources(pages=made)).rows.select(F.col("record").cast("long").alias("k"))


@query("recipe_page_links", "SELECT c_custkey AS k, c_custkey % 20 AS n FROM customer")
def recipe_page_links(spark, sf_dir):
    """Every twentieth customer's page links to the next nineteen; all of them are opened from there."""
    web = "https://s.test/c/"
    address = F.concat(F.lit(web), F.col("c_custkey").cast("string"))
    links = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(19)), lambda i: F.concat(F.lit(f'<a class="n" href="{web}'), (F.col("c_custkey") + i).cast("string"), F.lit('">x</a>'))), "")
    html = F.concat(F.lit("<b>"), F.col("c_custkey").cast("string"), F.lit("</b>"), F.when(F.col("c_custkey") % 20 == 0, links).otherwise(""))
    made = table(spark, sf_dir, "customer").select(address.alias("url"), html.alias("html"))
    loop = {"type": "LOOP", "config": {"type": "paginate-links", "selector": "a.n", "max": 20}, "children": [{"type": "EXTRACT", "config": {"fields": [{"name": "k", "selector": "b"}]}}]}
    listed = {"type": "IF_ELSE", "config": {"condition": "exists", "selector": "a.n"}, "ifBranch": [loop]}
    rows = compile_recipe(spark, {"steps": [{"type": "WEBSITE"}, listed]}, Sources(pages=made)).rows
    return rows.select(F.col("k").cast("long").alias("k"), F.col("_page").alias("n"))


@query("run_counters", "SELECT count(DISTINCT p_brand) AS rows, count(*) - count(DISTINCT p_brand) AS dropped FROM part")
def run_counters(spark, sf_dir):
    recipe = {"steps": [{"type": "WEBSITE"}, {"type": "DEDUPE", "config": {"fields": "brand"}}, {"type": "EXTRACT", "config": {"fields": [{"name": "brand", "selector": "b"}]}}]}
    made = _parts(spark, sf_dir, F.concat(F.lit("<b>"), "p_brand", F.lit("</b>")))
    told = counters(compile_recipe(spark, recipe, Sources(pages=made)))
    return table(spark, sf_dir, "part").limit(1).select(F.lit(told["rows"]).cast("long").alias("rows"), F.lit(told["dropped"]).cast("long").alias("dropped"))


# ---- stores ---------------------------------------------------------------------------------------------------------


@query("run_resumed", "SELECT p_partkey, p_name AS name, p_brand AS brand FROM part")
def run_resumed(spark, sf_dir):
    """A run of two steps, taken up again with a third: the rows of the first come from its store."""
    made = _parts(spark, sf_dir, F.concat(F.lit("<b>"), "p_name", F.lit("</b><i>"), "p_brand", F.lit("</i>")))
    field = lambda name, selector: {"type": "EXTRACT", "config": {"fields": [{"name": name, "selector": selector}]}}
    steps, root = [{"type": "WEBSITE"}, field("name", "b"), field("brand", "i")], _scratch(spark, "run")
    run_recipe(spark, {"steps": steps[:2]}, Sources(pages=made), root, "one")
    rows = run_recipe(spark, {"steps": steps}, Sources(pages=made), root, "one").result.rows
    return rows.groupBy("p_partkey").agg(F.max("name").alias("name"), F.max("brand").alias("brand"))


@query("stored_runs", "SELECT event_id, event_type FROM events WHERE user_id % 3 = 1")
def stored_runs(spark, sf_dir):
    """Rows of three runs in one store, of which one is read."""
    events, root = table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), _scratch(spark, "store")
    for k in range(3):
        runs.save_rows(events.where(F.col("user_id") % 3 == k).select("event_id", "event_type"), root, f"run {k}")
    return runs.read_rows(spark, root, "run 1")


@query("cache_keys", "SELECT doc_id, sha256('doc ' || doc_id || ' a,b openai  ' || ' ' || coalesce(text, '')) AS key FROM documents")
def cache_keys(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    key = runs.cache_key(F.concat(F.lit("doc "), F.col("doc_id").cast("string")), ["b", "a"], F.lit("openai"), F.lit(None).cast("string"), F.lit(""), F.col("text"))
    return docs.select("doc_id", key.alias("key"))


@query("row_buffer", "SELECT event_type, count(*) AS n FROM (SELECT event_type FROM events ORDER BY event_id LIMIT 8000) GROUP BY 1")
def row_buffer(spark, sf_dir):
    """Events as a stream into a run's buffer, which holds the first 8,000."""
    kind, root = table(spark, sf_dir, "events").schema, _scratch(spark, "buffer")
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    buffer.buffer_rows(stream, root, "run", f"{root}/checkpoint", every=None, cap=8000, order=["event_id"], file_rows=10_000).awaitTermination()
    return buffer.buffered(spark, root, "run", kind).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("stream_deduplicated", "SELECT user_id, event_type FROM events GROUP BY ALL")
def stream_deduplicated(spark, sf_dir):
    """Keep-first over a stream of events."""
    kind, root = table(spark, sf_dir, "events").schema, _scratch(spark, "stream")
    stream = spark.readStream.schema(kind).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    pacing.append_stream(pacing.dedupe_stream(stream, ["user_id", "event_type"]), f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(kind).parquet(f"{root}/out").select("user_id", "event_type")


@query("due_schedules", """SELECT c_custkey AS name, greatest(0, (1000000000 // (60000 * (c_custkey % 50 + 1))) - 1) AS missed FROM customer WHERE c_nationkey % 4 <> 0 AND c_custkey % 11 <> 5""")
def due_schedules(spark, sf_dir):
    """Customers' schedules that are due, without those switched off and those whose last run has not ended."""
    customers = table(spark, sf_dir, "customer")
    schedules = customers.select(F.col("c_custkey").alias("name"), (F.col("c_custkey") % 50 + 1).alias("every_minutes"), (F.col("c_nationkey") % 4 != 0).alias("enabled"), F.lit(1000).cast("long").alias("last_run_ms"))
    running = customers.where("c_custkey % 11 = 5").select(F.col("c_custkey").alias("name"))
    return pacing.due(schedules, running, F.lit(1_000_001_000).cast("long")).select("name", "missed")


@query("proxies_by_country", "SELECT o_orderkey, 'p' || (o_custkey % 5) || '.test' AS host FROM orders")
def proxies_by_country(spark, sf_dir):
    """A proxy list made of nations, and the one for each order's country."""
    lines = table(spark, sf_dir, "nation").where("n_nationkey < 5").select(F.concat(F.lit("http://p"), F.col("n_nationkey").cast("string"), F.lit(".test:80")).alias("value"))
    listed = lists.parse_proxies(lines).withColumn("country", F.substring("host", 2, 1))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_custkey") % 5).cast("string").alias("land"))
    return lists.assign_proxies(orders, listed, "o_orderkey", "geo", country="land").select("o_orderkey", "host")


@query("pdf_pages", "SELECT p_partkey // 50 AS block, count(*) AS rows FROM part GROUP BY 1")
def pdf_pages(spark, sf_dir):
    """Files of several pages: how many rows their tables hold in all."""
    blocks = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 50).alias("block"), F.floor(F.col("p_partkey") / 10).alias("page")).agg(F.array_sort(F.collect_list("p_partkey")).alias("keys"))
    cell = lambda x, y, text: F.concat(F.lit(f"BT 1 0 0 1 {x} "), y.cast("string"), F.lit(" Tm ("), text, F.lit(") Tj ET "))
    row = lambda y, a, b: F.concat(cell(72, y, a), cell(200, y, b))
    drawn = F.concat(row(F.lit(700), F.lit("Key"), F.lit("Code")), F.array_join(F.transform("keys", lambda k, i: row(F.lit(680) - 20 * i, k.cast("string"), F.concat(F.lit("c"), k.cast("string")))), ""))
    stream = F.concat(F.lit("1 0 obj\n<< /Length "), F.length(drawn).cast("string"), F.lit(" >>\nstream\n"), drawn, F.lit("\nendstream\nendobj\n"))
    made = blocks.select("block", "page", stream.alias("stream")).groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "stream"))), lambda s: s["stream"]), "").alias("body"))
    files = made.select(F.col("block").cast("string").alias("path"), F.encode(F.concat(F.lit("%PDF-1.4\n"), "body"), "UTF-8").alias("content"))
    each = pdf.extract_pdf(files).select("path", F.explode("pages").alias("p")).select("path", "p.page", "p.items")
    return pdf.tables(each).groupBy(F.col("path").cast("long").alias("block")).agg(F.count(F.lit(1)).alias("rows"))
