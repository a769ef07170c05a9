"""Queries over pages, JSON, API responses, recipes, pacing, detection and PDF."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import functions as F

from rowloom.functions import transforms as T
from rowloom.operators import search
from rowloom.plans import templates
from rowloom.plans.catalogue import query, table
from rowloom.plans.compiler import Sources, compile_recipe, file_manifest, follow_links, paginate_until_empty, run_exports
from rowloom.session import cut_lineage, shared_dir
from rowloom.sinks import render, runs
from rowloom.sources import api, lists, pages, pdf
from rowloom.streaming import pacing

# The driver's pages are regular enough for regular expressions; the oracles read them so.
_TITLE = "regexp_extract(html, '<title>([^<]*)</title>', 1)"
_LINKS = "regexp_extract_all(html, '<li><a href=\"([^\"]*)\">', 1)"
_TEXTS = "regexp_extract_all(html, '<li><a href=\"[^\"]*\">([^<]*)</a>', 1)"


@query("extract_broadcast_zip", f"WITH l AS (SELECT page_id, html, {_LINKS} AS h, {_TEXTS} AS t FROM pages), r AS (SELECT page_id, html, h, t, unnest(generate_series(1, len(h))) AS i FROM l) SELECT page_id, CAST(i - 1 AS INTEGER) AS place, h[i] AS href, t[i] AS label, html LIKE '%<footer>%' AS has_footer FROM r")
def extract_zip(spark, sf_dir):
    fields = [{"name": "href", "selector": "nav a", "type": "attribute", "attribute": "href"}, {"name": "label", "selector": "nav a"}, {"name": "footer", "selector": "footer", "type": "count", "countSelector": "p"}]
    rows = pages.extract(table(spark, sf_dir, "pages"), fields)
    return rows.select("page_id", F.col("_row").alias("place"), "href", "label", F.col("footer").isNotNull().alias("has_footer"))


@query("extract_title_h1", f"SELECT page_id, {_TITLE} = regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS same, len(regexp_extract_all(html, '<p[ >]')) AS paragraphs FROM pages")
def extract_title_h1(spark, sf_dir):
    fields = [{"name": "title", "selector": "title"}, {"name": "h1", "selector": "//h1"}, {"name": "n", "selector": "html", "type": "count", "countSelector": "p"}]
    rows = pages.extract(table(spark, sf_dir, "pages"), fields)
    return rows.select("page_id", (F.col("title") == F.col("h1")).alias("same"), F.col("n").cast("long").alias("paragraphs"))


@query("query_count", f"SELECT page_id, len({_LINKS}) AS n FROM pages")
def query_count(spark, sf_dir):
    return pages.query_count(table(spark, sf_dir, "pages"), "nav li > a").select("page_id", F.col("count").cast("long").alias("n"))


@query("loop_elements", f"WITH l AS (SELECT page_id, {_LINKS} AS h, {_TEXTS} AS t FROM pages), r AS (SELECT *, unnest(generate_series(1, len(h))) AS i FROM l) SELECT page_id, CAST(i AS INTEGER) AS place, i = 1 AS first, i = len(h) AS last, t[i] AS label FROM r")
def loop_elements(spark, sf_dir):
    return pages.loop_items(table(spark, sf_dir, "pages"), "nav a").select("page_id", F.col("loop.index").alias("place"), "loop.first", "loop.last", F.col("item")["text"].alias("label"))


@query("loop_elements_scope", f"WITH l AS (SELECT page_id, {_TEXTS} AS t FROM pages), r AS (SELECT *, unnest(generate_series(1, len(t))) AS i FROM l) SELECT page_id, CAST(i - 1 AS INTEGER) AS record, t[i] AS label FROM r")
def loop_scope(spark, sf_dir):
    return pages.extract(table(spark, sf_dir, "pages"), [{"name": "label", "selector": "a"}], loop="nav li", fallback=False).select("page_id", F.col("_record").alias("record"), "label")


@query("node_table_descendants", "SELECT page_id, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, '<a ')) AS links FROM pages")
def node_table(spark, sf_dir):
    nodes = pages.node_table(table(spark, sf_dir, "pages"))
    nav = nodes.where("tag = 'nav'").select("page_id", F.col("pre").alias("from_pre"), F.col("post").alias("to_pre"))
    inside = nodes.join(nav, "page_id").where("pre > from_pre AND pre <= to_pre")
    return inside.groupBy("page_id").agg(F.count_if(F.col("tag") == "li").alias("items"), F.count_if(F.col("tag") == "a").alias("links"))


@query("page_json_flat", f"SELECT page_id, len({_LINKS}) AS links, html LIKE '%<div class=\"ad\">%' AS has_ad FROM pages")
def page_json_flat(spark, sf_dir):
    rows = pages.page_json(table(spark, sf_dir, "pages"), "flat").select("page_id", F.explode("page.rows").alias("r"))
    return rows.groupBy("page_id").agg(F.count_if(F.col("r.tag") == "a").alias("links"), F.bool_or(F.coalesce(F.col("r.class") == "ad", F.lit(False))).alias("has_ad"))


@query("page_json_text")
def page_json_text(spark, sf_dir):
    return pages.page_json(table(spark, sf_dir, "pages"), "text").select("page_id", F.posexplode("page.text").alias("place", "line"))


@query("page_data_none", "SELECT page_id, false AS found FROM pages")
def page_data_none(spark, sf_dir):
    """The driver's pages publish no structured data; that this is said of each is what is checked."""
    return pages.page_data(table(spark, sf_dir, "pages")).select("page_id", "data.found")


@query("page_data_json_ld", "SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def page_data_json_ld(spark, sf_dir):
    """Product pages made of the part table, read back through their JSON-LD."""
    record = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), F.struct(F.col("p_size").alias("value")).alias("size")))
    html = F.concat(F.lit('<html><head><script type="application/ld+json">{"@context":"x","@graph":['), record, F.lit("]}</script></head></html>"))
    made = table(spark, sf_dir, "part").select("p_partkey", F.lit("https://s.test/").alias("url"), html.alias("html"))
    flat = pages.page_data(made, flat=True).select("p_partkey", F.explode("data.records").alias("r"))
    return flat.select("p_partkey", F.get_json_object("r", "$.name").alias("name"), F.get_json_object("r", "$['size.value']").alias("size"))


@query("auto_extract_products", "SELECT p_partkey, p_name AS name, CAST(p_retailprice AS DOUBLE) AS price, 'EUR' AS currency, 'json-ld' AS method FROM part")
def auto_extract_products(spark, sf_dir):
    offer = F.struct(F.col("p_retailprice").alias("price"), F.lit("EUR").alias("priceCurrency"))
    record = F.to_json(F.struct(F.lit("Product").alias("@type"), F.col("p_name").alias("name"), offer.alias("offers")))
    html = F.concat(F.lit('<script type="application/ld+json">'), record, F.lit("</script><h1>other</h1>"))
    made = table(spark, sf_dir, "part").select("p_partkey", F.lit("https://s.test/").alias("url"), html.alias("html"))
    return pages.auto_extract(made).select("p_partkey", "name", F.col("price").cast("double").alias("price"), "currency", F.col("_extractionMethod").alias("method"))


@query("detect_table", "SELECT o_orderpriority, o_orderkey // 64 AS block, CASE WHEN count(*) >= 3 THEN count(*) ELSE 0 END AS n, count(*) >= 3 AS named FROM orders GROUP BY ALL")
def detect_table(spark, sf_dir):
    """Tables made of all orders, one for each priority and block of keys, found again with their headers."""
    blocks = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.floor(F.col("o_orderkey") / 64).alias("block")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_custkey"))).alias("o"))
    body = F.array_join(F.transform("o", lambda x: F.concat(F.lit("<tr><td>"), x["o_orderkey"].cast("string"), F.lit("</td><td>c"), (x["o_custkey"] + x["o_orderkey"]).cast("string"), F.lit("</td></tr>"))), "")
    html = F.concat(F.lit("<table><thead><tr><th>Order</th><th>Customer</th></tr></thead><tbody>"), body, F.lit("</tbody></table>"))
    made = blocks.select("o_orderpriority", "block", F.lit("u").alias("url"), html.alias("html"))
    named = F.contains("fields", F.lit('"order"')) & F.contains("fields", F.lit('"customer"'))
    found = pages.detect_tables(made).where("rank = 1").select("o_orderpriority", "block", F.col("count").cast("long").alias("found"), named.alias("both"))
    each = made.select("o_orderpriority", "block").join(found, ["o_orderpriority", "block"], "left")
    return each.select("o_orderpriority", "block", F.coalesce("found", F.lit(0)).cast("long").alias("n"), F.coalesce("both", F.lit(False)).alias("named"))


@query("detect_table_customers", "SELECT o_custkey, CASE WHEN count(*) >= 3 THEN count(*) ELSE 0 END AS n, count(*) >= 3 AS named FROM orders GROUP BY 1")
def detect_table_customers(spark, sf_dir):
    """A table of all orders of each customer, found again; fewer than three rows are no set of records to the detector."""
    orders = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("o"))
    body = F.array_join(F.transform("o", lambda x: F.concat(F.lit("<tr><td>"), x.cast("string"), F.lit("</td><td>c"), (x + F.col("o_custkey")).cast("string"), F.lit("</td></tr>"))), "")
    html = F.concat(F.lit("<table><thead><tr><th>Order</th><th>Code</th></tr></thead><tbody>"), body, F.lit("</tbody></table>"))
    made = orders.select("o_custkey", F.lit("u").alias("url"), html.alias("html"))
    found = pages.detect_tables(made).where("rank = 1").select("o_custkey", F.col("count").cast("long").alias("found"), (F.contains("fields", F.lit('"order"')) & F.contains("fields", F.lit('"code"'))).alias("both"))
    each = made.select("o_custkey").join(found, "o_custkey", "left")
    return each.select("o_custkey", F.coalesce("found", F.lit(0)).cast("long").alias("n"), F.coalesce("both", F.lit(False)).alias("named"))


@query("detect_table_pages")
def detect_table_pages(spark, sf_dir):
    return pages.detect_tables(table(spark, sf_dir, "pages")).select("page_id", "rank", "selector", "count", "score")


@query("pdf_grid", "SELECT CAST(p_partkey AS VARCHAR) AS name, 'EUR ' || p_size AS price FROM part")
def pdf_grid(spark, sf_dir):
    """Price lists of all parts as PDF files of up to twenty lines, read back as tables."""
    blocks = table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 20).alias("block")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", "p_size"))).alias("rows"))
    shown = lambda x, y, text: F.concat(F.lit(f"BT 1 0 0 1 {x} "), y.cast("string"), F.lit(" Tm ("), text, F.lit(") Tj ET "))
    line = lambda y, a, b: F.concat(shown(72, y, a), shown(200, y, b))
    lines = F.transform("rows", lambda r, i: line(F.lit(680) - 20 * i, r["p_partkey"].cast("string"), F.concat(F.lit("EUR "), r["p_size"].cast("string"))))
    text = F.concat(line(F.lit(700), F.lit("Name"), F.lit("Price")), F.array_join(lines, ""))
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Length "), F.length(text).cast("string"), F.lit(" >>\nstream\n"), text, F.lit("\nendstream\nendobj\n"))
    files = blocks.select(F.concat(F.col("block").cast("string"), F.lit(".pdf")).alias("path"), F.encode(body, "UTF-8").alias("content"))
    each = pdf.extract_pdf(files).select("path", F.explode("pages").alias("p")).select("path", "p.page", "p.items")
    return pdf.tables(each).select(F.get_json_object("record", "$.Name").alias("name"), F.get_json_object("record", "$.Price").alias("price"))


@query("tf_url_absolute", """WITH h AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS site, unnest(regexp_extract_all(html, '<li><a href="([^"]*)">', 1)) AS href FROM pages)
SELECT page_id, href, lower(site) || replace(replace(url_encode(href), '%2F', '/'), '%2C', ',') AS link FROM h""")
def tf_url(spark, sf_dir):
    """Every link of every page's navigation as an absolute address."""
    rows = pages.extract(table(spark, sf_dir, "pages").withColumn("base", F.col("url")), [{"name": "href", "selector": "nav a", "type": "attribute", "attribute": "href"}])
    return rows.where("href IS NOT NULL").select("page_id", "href", T.url(F.col("href"), F.col("base")).alias("link"))


@query("tf_url_every_href")
def tf_url_every_href(spark, sf_dir):
    """Every address of every page, with whatever it holds; SQL cannot encode them, so tests compare with urllib."""
    rows = pages.extract(table(spark, sf_dir, "pages").withColumn("base", F.col("url")), [{"name": "href", "selector": "[href]", "type": "attribute", "attribute": "href"}])
    return rows.where("href IS NOT NULL").select("page_id", "href", T.url(F.col("href"), F.col("base")).alias("link"))


# ---- JSON and APIs --------------------------------------------------------------------------------------------------


@query("json_path", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", api.value_at(F.col("props"), "k", "int").alias("k"), api.value_at(F.col("props"), "z.y[0]").alias("missing"))


_BODY = "'{\"data\":{\"items\":[' || props || ',{\"k\":' || user_id || '}]}}'"


@query("json_explode", "SELECT event_id, 0 AS row_no, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events UNION ALL SELECT event_id, 1, user_id FROM events")
def json_explode(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.expr(_BODY).alias("body"))
    return api.rows_at(events, "body", "data.items").select("event_id", "row_no", F.get_json_object("row", "$.k").cast("long").alias("k"))


@query("json_flatten", "SELECT event_id, CAST(json_extract(props, '$.k') AS VARCHAR) AS first, CAST(user_id AS VARCHAR) AS second FROM events")
def json_flatten(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.expr(_BODY).alias("body"))
    return events.select("event_id", pages.flatten_json(F.col("body")).alias("m")).select("event_id", F.col("m")["data.items.0.k"].alias("first"), F.col("m")["data.items.1.k"].alias("second"))


# Each user's events as three recorded responses; those of odd users say that a second one follows, those of even ones a third.
_MORE = "seq < 2 + user_id % 2"
_ANSWERS = f"WITH a AS (SELECT user_id, event_id % 3 AS seq, list(event_id) AS ids FROM events GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq) AS n, {_MORE} AS more FROM a)"


def _responses(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 3).alias("seq")).agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    records = F.array_join(F.transform("ids", lambda i: F.concat(F.lit('{"id":'), i.cast("string"), F.lit("}"))), ",")
    cursor = F.when(F.expr(_MORE), F.concat(F.lit(',"next_cursor":"'), (F.col("seq") + 1).cast("string"), F.lit('"'))).otherwise("")
    link = F.when(F.expr(_MORE), F.lit('</1>; rel="prev", </2>; rel=next')).otherwise('</1>; rel="prev"')
    return rows.select(F.col("user_id").cast("string").alias("run"), "seq", F.concat(F.lit('{"data":['), records, F.lit("]"), cursor, F.lit("}")).alias("body"), F.lit(200).alias("status"), link.alias("link"))


def _api_query(mode: str, kept: str) -> None:
    @query(f"api_pages_{mode}", f"{_ANSWERS}, s AS (SELECT *, min(CASE WHEN NOT more THEN n END) OVER (PARTITION BY user_id) AS stop FROM n) SELECT unnest(ids) AS id FROM s WHERE {kept}")
    def run(spark, sf_dir):
        read = api.recorded_pages(_responses(spark, sf_dir), mode, "data", "next_cursor")
        return api.rows_at(read, "body", "data").select(F.get_json_object("row", "$.id").cast("long").alias("id"))


for _mode, _kept in (("cursor", "n <= coalesce(stop, 10)"), ("page", "true"), ("link", "n <= coalesce(stop, 10)"), ("none", "n = 1")):
    _api_query(_mode, _kept)

_ASKED = {
    "status": "CASE event_type WHEN 'error' THEN 503 WHEN 'signup' THEN 429 WHEN 'purchase' THEN 500 WHEN 'view' THEN 404 ELSE 200 END", "attempt": "CAST(event_id % 5 + 1 AS INT)",
    "waited_ms": "CAST(event_id % 7 * 9900 AS INT)", "retry_after_s": "CASE WHEN event_id % 4 = 0 THEN CAST(event_id % 90 AS INT) END",
}


@query(
    "retry_schedule",
    f"""WITH a AS (SELECT event_id, {", ".join(f"{sql} AS {name}" for name, sql in _ASKED.items())} FROM events)
    SELECT event_id, CASE WHEN (status = 429 OR status BETWEEN 500 AND 599) AND attempt < 4 AND waited_ms < 60000
      THEN greatest(0, least(coalesce(retry_after_s * 1000, 1000 * (1 << (attempt - 1))), 60000 - waited_ms))::BIGINT END AS wait_ms FROM a""",
)
def retry_schedule(spark, sf_dir):
    """How long each event, taken as a failed request, waits for its next attempt."""
    asked = table(spark, sf_dir, "events").select("event_id", *(F.expr(sql).alias(name) for name, sql in _ASKED.items()))
    return api.retry_schedule(asked).select("event_id", F.col("wait_ms").cast("long").alias("wait_ms"))


@query("list_items", """SELECT place, url, sku FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS place, c_name || ', "x"' AS url, CAST(c_custkey AS VARCHAR) AS sku FROM customer WHERE c_nationkey <> 3) WHERE place <= 10000""")
def list_items(spark, sf_dir):
    """A pasted list of customers with a header, quoted cells and blank lines; a list holds 10,000 items."""
    cells = F.concat(F.lit('"'), "c_name", F.lit(', ""x""",'), F.col("c_custkey").cast("string"), F.lit(",more"))
    lines = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1).alias("n"), F.when(F.col("c_nationkey") == 3, "  ").otherwise(cells).alias("line"))
    head = lines.agg(F.min("n").alias("n")).select((F.col("n") - 1).alias("n"), F.lit("url,sku").alias("line"))
    items, _ = lists.parse_list(head.unionByName(lines), "n", delimiter=",", has_header=True)
    return items.select(F.col("index").cast("long").alias("place"), F.col("cols")["url"].alias("url"), F.col("cols")["sku"].alias("sku"))


@query("output_rows", "SELECT event_id FROM events WHERE event_id % 2 = 0")
def output_rows(spark, sf_dir):
    lines = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise(F.concat(F.lit("log "), F.col("props"))).alias("value"))
    return lists.output_rows(lines)[0].select("event_id")


# ---- templates, files, recipes --------------------------------------------------------------------------------------


@query("template_render", "SELECT c_custkey, 'No ' || c_custkey || ': ' || c_name || ' of ' || c_nationkey || ', run 7, ' AS line FROM customer")
def template_render(spark, sf_dir):
    customers = table(spark, sf_dir, "customer")
    return customers.select("c_custkey", templates.compile_template(customers, "No {{c_custkey}}: {{c_name}} of {{ c_nationkey }}, run {{run.id}}, {{zz}}", {"run": {"id": 7}}).alias("line"))


@query("file_manifest", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) || '/' || CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*/[a-z]+/([^/?#]*)', 1) LIKE '%.html' THEN regexp_extract(url, '([0-9]+)[.]html', 1) ELSE regexp_extract(url, '^[a-z]+://[^/?#]*/[a-z]+/([^/?#]*)', 1) END || CASE WHEN url LIKE '%.html%' THEN '.html' ELSE '' END AS path FROM pages")
def manifest(spark, sf_dir):
    files = table(spark, sf_dir, "pages").select("page_id", "url", F.col("page_id").alias("index"))
    return file_manifest(files, "{{file.host}}/{{file.stem}}").select("page_id", "path")


@query("recipe_run", f"WITH t AS (SELECT unnest({_TEXTS}) AS label FROM pages) SELECT lower(label) AS label FROM t GROUP BY 1")
def recipe_run(spark, sf_dir):
    recipe = {"steps": [{"type": "WEBSITE"}, {"type": "DEDUPE", "config": {"fields": "label"}}, {"type": "LOOP", "config": {"selector": "nav li"}, "children": [{"type": "EXTRACT", "config": {"fields": [{"name": "label", "selector": "a", "transform": ["trim", "lower"]}]}}]}, {"type": "EXPORT"}]}
    return compile_recipe(spark, recipe, Sources(pages=table(spark, sf_dir, "pages"))).rows.select("label")


_EACH = f"WITH t AS (SELECT page_id, unnest({_TEXTS}) AS label FROM pages)"
_LABEL = {"type": "EXTRACT", "config": {"fields": [{"name": "label", "selector": "a"}]}}


def _recipe(spark, sf_dir, *steps):
    return compile_recipe(spark, {"steps": [{"type": "WEBSITE"}, *steps]}, Sources(pages=table(spark, sf_dir, "pages"))).rows


@query("recipe_nested_loops", f"{_EACH} SELECT page_id, label FROM t")
def recipe_nested_loops(spark, sf_dir):
    """A loop within the records of a loop."""
    inner = {"type": "LOOP", "config": {"selector": "li"}, "children": [_LABEL]}
    return _recipe(spark, sf_dir, {"type": "LOOP", "config": {"selector": "nav ul"}, "children": [inner]}).select("page_id", "label")


@query("recipe_branch_in_loop", f"{_EACH} SELECT page_id, CASE WHEN contains(label, 'e') THEN label END AS label, CASE WHEN NOT contains(label, 'e') THEN label END AS other FROM t")
def recipe_branch_in_loop(spark, sf_dir):
    """Each record of a loop takes its own branch."""
    other = {"type": "EXTRACT", "config": {"fields": [{"name": "other", "selector": "a"}]}}
    branch = {"type": "IF_ELSE", "config": {"condition": "text-contains", "selector": "a", "value": "e"}, "ifBranch": [_LABEL], "elseBranch": [other]}
    return _recipe(spark, sf_dir, {"type": "LOOP", "config": {"selector": "nav li"}, "children": [branch]}).select("page_id", "label", "other")


@query("recipe_skip_failing_records", f"{_EACH} SELECT page_id, label FROM t WHERE contains(label, 'e')")
def recipe_skip_failing_records(spark, sf_dir):
    must = {"type": "ASSERT", "config": {"assertion": "text-contains", "selector": "a", "value": "e"}}
    return _recipe(spark, sf_dir, {"type": "LOOP", "config": {"selector": "nav li", "onFail": "skip"}, "children": [must, _LABEL]}).select("page_id", "label")


_CHAIN = """WITH RECURSIVE w(k, n) AS (SELECT 1::BIGINT, 0::BIGINT UNION ALL SELECT w.k + 1, n + 1 FROM w JOIN customer ON w.k = c_custkey WHERE c_custkey % 400 <> 0 AND n + 1 < 10000)
SELECT k, n FROM w WHERE k IN (SELECT c_custkey FROM customer)"""


def _customer_pages(spark, sf_dir):
    """A page for each customer, with the key, the segment, a link to the next (but every 400th), and the balance of those in credit."""
    key, web = F.col("c_custkey"), "https://s.test/c/"
    link = F.when(key % 400 != 0, F.concat(F.lit(f'<a class="next" href="{web}'), (key + 1).cast("string"), F.lit('">more</a>'))).otherwise("")
    credit = F.when(F.col("c_acctbal") > 0, F.concat(F.lit("<i>"), "c_mktsegment", F.lit("</i>"))).otherwise("")
    html = F.concat(F.lit("<b>"), key.cast("string"), F.lit("</b><em>"), "c_name", F.lit("</em>"), credit, link)
    return table(spark, sf_dir, "customer").select(F.concat(F.lit(web), key.cast("string")).alias("url"), html.alias("html"), "c_custkey", "c_nationkey")


@query("recipe_next_links", _CHAIN)
def recipe_next_links(spark, sf_dir):
    """Customers' pages, each with a link to the next, followed from the first through a chain of hundreds."""
    steps = [{"type": "WEBSITE", "config": {"url": "https://s.test/c/1"}}, {"type": "PAGINATE", "config": {"selector": "a.next", "maxPages": 10000}}, {"type": "EXTRACT", "config": {"fields": [{"name": "k", "selector": "b"}]}}]
    rows = compile_recipe(spark, {"steps": steps}, Sources(pages=_customer_pages(spark, sf_dir))).rows
    return rows.select(F.col("k").cast("long").alias("k"), F.col("_page").alias("n"))


@query("next_links_all_starts", """WITH RECURSIVE w(start, k, n) AS (
  SELECT c_custkey, c_custkey, 0::BIGINT FROM customer WHERE c_nationkey = 7
  UNION ALL SELECT start, k + 1, n + 1 FROM w WHERE k % 400 <> 0 AND n + 1 < 64 AND k + 1 IN (SELECT c_custkey FROM customer))
SELECT start, max(n) AS links, max(k) AS last FROM w GROUP BY start""")
def next_links_all_starts(spark, sf_dir):
    """Chains from every customer of a nation, each a run of its own: links followed, and the page where each ends."""
    pages_ = _customer_pages(spark, sf_dir)
    key = lambda c: F.substring_index(c, "/", -1).cast("long")
    start = pages_.where("c_nationkey = 7").select(F.col("c_custkey").alias("start"), "url")
    reached = follow_links(start, pages.follow(pages_, "a.next").select("url", "next"), 64, ["start"]).join(pages_.select("url"), "url")
    return reached.groupBy("start").agg(F.max("_page").alias("links"), F.max(key("url")).alias("last"))


@query("recipe_list_loop", "SELECT c_custkey AS k, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_acctbal > 0")
def recipe_list_loop(spark, sf_dir):
    """A loop over a list of all customers: each opens its page, is skipped if it is not in credit, and is read."""
    items = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("index0"), F.col("c_custkey").alias("key"), F.lit("em").alias("tag"))
    must = {"type": "ASSERT", "config": {"assertion": "text-contains", "selector": "b", "value": "{{item.key}}"}}
    credit = {"type": "ASSERT", "config": {"assertion": "count-equals", "selector": "i", "count": 1}}
    read = {"type": "EXTRACT", "config": {"fields": [{"name": "k", "selector": "b"}, {"name": "name", "selector": "{{item.tag}}"}, {"name": "segment", "selector": "i"}]}}
    loop = {"type": "LOOP", "config": {"type": "list", "source": "context", "contextPath": "customers"}, "children": [{"type": "NAVIGATE", "config": {"url": "https://s.test/c/{{item.key}}"}}, must, credit, read]}
    rows = compile_recipe(spark, {"steps": [loop]}, Sources(pages=_customer_pages(spark, sf_dir), lists={"customers": items})).rows
    return rows.select(F.col("k").cast("long").alias("k"), "name", "segment")


@query("recipe_count_loop", "SELECT c_custkey AS k, unnest([c_custkey::VARCHAR, c_name, CASE WHEN c_acctbal > 0 THEN c_mktsegment WHEN c_custkey % 400 <> 0 THEN 'more' END]) AS v FROM customer")
def recipe_count_loop(spark, sf_dir):
    """Three rounds over every page, each reading the element of its number, as one plan."""
    read = {"type": "EXTRACT", "config": {"fields": [{"name": "k", "selector": "b"}, {"name": "v", "selector": "b:nth-child({{loop.index}}), em:nth-child({{loop.index}}), i:nth-child({{loop.index}}), a:nth-child({{loop.index}})"}]}}
    loop = {"type": "LOOP", "config": {"type": "count", "count": 3}, "children": [read]}
    rows = compile_recipe(spark, {"steps": [{"type": "WEBSITE"}, loop]}, Sources(pages=_customer_pages(spark, sf_dir))).rows
    return rows.select(F.col("k").cast("long").alias("k"), "v")


@query("recipe_extracted", "SELECT a.c_custkey AS k, b.c_name AS next_name FROM customer a JOIN customer b ON b.c_custkey = a.c_custkey + 1 WHERE a.c_custkey % 400 <> 0")
def recipe_extracted(spark, sf_dir):
    """Values that a step read on each page are the address that the next step opens."""
    link = {"type": "EXTRACT", "config": {"fields": [{"name": "to", "selector": "a.next", "type": "attribute", "attribute": "href"}, {"name": "k", "selector": "b"}]}}
    on = {"type": "NAVIGATE", "config": {"url": "{{extracted.to}}"}}
    name = {"type": "EXTRACT", "config": {"fields": [{"name": "next_name", "selector": "em"}, {"name": "n", "selector": "b"}]}}
    rows = compile_recipe(spark, {"steps": [{"type": "WEBSITE"}, link, on, name]}, Sources(pages=_customer_pages(spark, sf_dir))).rows
    return rows.where("next_name IS NOT NULL").select((F.col("n").cast("long") - 1).alias("k"), "next_name")


@query("recipe_records_open_pages", "SELECT r.r_regionkey AS region, n.n_name AS name FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey JOIN customer c ON c.c_nationkey = n.n_nationkey AND c.c_custkey % 2 = 1")
def recipe_records_open_pages(spark, sf_dir):
    """Each region's page lists its odd customers; every record's link is opened, and the page behind it says the nation."""
    nation, odd = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer").where("c_custkey % 2 = 1")
    customers = odd.join(F.broadcast(nation), odd.c_nationkey == nation.n_nationkey)
    address = F.concat(F.lit("https://s.test/c/"), F.col("c_custkey").cast("string"))
    # A region's page holds a link for each block of customers, a table of contents; a block holds the customers.
    block = F.concat(F.lit("https://s.test/b/"), F.col("n_regionkey").cast("string"), F.lit("/"), F.floor(F.col("c_custkey") / 100).cast("string"))
    item = lambda c: F.concat(F.lit('<li><a href="'), c, F.lit('">go</a></li>'))
    blocks = customers.groupBy(block.alias("url"), "n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(item(address))), "").alias("html"))
    own = customers.select(address.alias("url"), F.concat(F.lit("<h1>"), "n_name", F.lit("</h1><p>"), F.col("n_regionkey").cast("string"), F.lit("</p>")).alias("html"))
    site = blocks.select("url", "html").unionByName(own)
    opened = {"type": "LOOP", "config": {"type": "elements", "selector": "li a"}, "children": [
        {"type": "NAVIGATE", "config": {"url": "{{item.href}}"}}, {"type": "EXTRACT", "config": {"fields": [{"name": "name", "selector": "h1"}, {"name": "region", "selector": "p"}]}}]}
    rows = compile_recipe(spark, {"steps": [{"type": "WEBSITE"}, opened]}, Sources(pages=site)).rows
    return rows.select(F.col("region").cast("int").alias("region"), "name")


@query("select_all_counts", f"""SELECT page_id, len({_TEXTS}) AS items, greatest(len({_TEXTS}) - 1, 0) AS later, CAST(len(list_filter({_LINKS}, lambda x: starts_with(x, '/t'))) AS INT) AS t_links,
CAST(({_LINKS})[2] AS VARCHAR) AS second, 1 AS titles, CAST(len({_TEXTS}) > 0 AS INT) AS lists FROM pages""")
def select_all_counts(spark, sf_dir):
    """Six selectors over every page, all served by one parse."""
    chosen = {
        "items": "nav > ul > li", "later": "nav li + li", "t_links": "nav a[href^='/t']", "second": "//nav/ul/li[2]/a", "titles": "head title:first-of-type", "lists": "//nav//li/parent::ul",
    }
    found = pages.select_all(table(spark, sf_dir, "pages").select("page_id", "html"), chosen)
    sizes = [F.size(c).alias(c) for c in ("items", "later", "t_links", "titles", "lists")]
    return found.select("page_id", *sizes, F.get("second", F.lit(0))["attrs"]["href"].alias("second"))


@query("export_deduplicated_in_order", f"""WITH t AS (SELECT url, page_id, unnest({_TEXTS}) AS label, generate_subscripts({_TEXTS}, 1) AS i FROM pages),
f AS (SELECT min((url, page_id, i, label)) AS r FROM t GROUP BY lower(label))
SELECT row_number() OVER (ORDER BY r) - 1 AS n, to_json({{'url': r[1], 'page_id': r[2], 'label': r[4]}})::VARCHAR AS value FROM f""")
def export_deduplicated_in_order(spark, sf_dir):
    """The labels of all pages, each once, exported by a recipe and read back line by line."""
    steps = [{"type": "WEBSITE"}, {"type": "DEDUPE", "config": {"fields": "label"}}, {"type": "LOOP", "config": {"selector": "nav li"}, "children": [_LABEL]}, {"type": "EXPORT", "config": {"format": "jsonl", "filename": "labels.jsonl"}}]
    done = compile_recipe(spark, {"steps": steps}, Sources(pages=table(spark, sf_dir, "pages").select("url", "page_id", "html")))
    out = f"{shared_dir(spark)}/rowloom/run-{uuid.uuid4().hex}"
    run_exports(done, out, f"{out}/sets")
    return render.read_document(spark, f"{out}/labels.jsonl", "jsonl")


@query("page_data_microdata", "SELECT p_partkey, p_name AS name, CAST(p_size AS VARCHAR) AS size FROM part")
def page_data_microdata(spark, sf_dir):
    """Product pages made of the part table, read back through their microdata."""
    html = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Product"><h1 itemprop="name">'), "p_name", F.lit('</h1><meta itemprop="size" content="'), F.col("p_size").cast("string"), F.lit('"></div>'))
    made = table(spark, sf_dir, "part").select("p_partkey", F.lit("https://s.test/").alias("url"), html.alias("html"))
    each = pages.page_data(made, source="microdata").select("p_partkey", F.explode("data.records").alias("r"))
    return each.select("p_partkey", F.get_json_object("r", "$.name").alias("name"), F.get_json_object("r", "$.size").alias("size"))


@query("page_data_meta", "SELECT p_partkey, p_name AS title, p_brand AS brand FROM part")
def page_data_meta(spark, sf_dir):
    html = F.concat(F.lit('<head><meta property="og:title" content="'), "p_name", F.lit('"><meta property="product:brand" content="'), "p_brand", F.lit('"></head>'))
    made = table(spark, sf_dir, "part").select("p_partkey", F.lit("https://s.test/").alias("url"), html.alias("html"))
    return pages.page_data(made, source="meta").select("p_partkey", F.col("data.meta")["og:title"].alias("title"), F.col("data.meta")["product:brand"].alias("brand"))


@query("paginate_url_stop_empty", "WITH p AS (SELECT o_orderkey // 500 AS page, count(*) FILTER (WHERE o_totalprice > 499000) AS kept FROM orders GROUP BY 1), s AS (SELECT page, kept, kept = 0 AND coalesce(sum(kept) OVER (ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) > 0 AS stop FROM p) SELECT page, kept FROM s WHERE page <= coalesce((SELECT min(page) FROM s WHERE stop), 1000000)")
def paginate_url(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").groupBy(F.floor(F.col("o_orderkey") / 500).alias("page")).agg(F.count_if(F.col("o_totalprice") > 499000).alias("kept"))
    return paginate_until_empty(orders, "page", "kept")


# ---- pacing ---------------------------------------------------------------------------------------------------------


@query(
    "rate_limit_grants",
    """WITH n AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)
    SELECT event_id, greatest(t, max(t - k * 3600000000) OVER (PARTITION BY user_id ORDER BY k) + (k + 1 - 3) * 3600000000) AS grant_us FROM n""",
)
def rate_grants(spark, sf_dir):
    """Three at once, then one an hour, for each user."""
    granted = pacing.grants(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "user_id", "ts", burst=3, per_second=1 / 3600, order="event_id")
    return granted.select("event_id", F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', grant_time)").alias("grant_us"))


@query(
    "missed_windows",
    """WITH l AS (SELECT event_id, epoch_ms(ts) AS now, epoch_ms(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS last FROM events)
    SELECT event_id, CASE WHEN last IS NULL THEN 0 ELSE greatest(0, CAST(floor((now - last) / 3600000.0) AS BIGINT) - 1) END AS missed FROM l""",
)
def missed(spark, sf_dir):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy(F.asc_nulls_last("ts"), F.asc_nulls_last("event_id"))
    us = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
    # Rounded as epoch_ms does, half away from 1970, and counted from before the year 1, as a last run at 0 stands for none.
    ms = F.expr(f"CAST(sign({us}) AS BIGINT) * ((abs({us}) + 500) DIV 1000) + 62135596800001")
    return table(spark, sf_dir, "events").select("event_id", pacing.missed_windows(F.lag(ms).over(w), F.lit(60), ms).alias("missed"))


@query(
    "capture_caps",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, CAST(len(props) AS INTEGER) AS size, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (SELECT event_id, user_id, size, k, size <= 200 AS fits, CASE WHEN size <= 200 THEN size ELSE 0 END AS used, CAST(size <= 200 AS INTEGER) AS n FROM e WHERE k = 1
      UNION ALL SELECT e.event_id, e.user_id, e.size, e.k, r.n < 20 AND r.used + e.size <= 200, r.used + CASE WHEN r.n < 20 AND r.used + e.size <= 200 THEN e.size ELSE 0 END, r.n + CAST(r.n < 20 AND r.used + e.size <= 200 AS INTEGER)
      FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
    SELECT event_id, user_id, size FROM r WHERE fits""",
)
def capture_caps(spark, sf_dir):
    sized = table(spark, sf_dir, "events").select("event_id", "user_id", F.length("props").alias("size"))
    return pacing.cap_captures(sized, "user_id", "event_id", "size", most=20, most_bytes=200)


@query("capture_caps_roomy", "SELECT event_id, user_id, CAST(len(props) AS INTEGER) AS size FROM events")
def capture_caps_roomy(spark, sf_dir):
    return pacing.cap_captures(table(spark, sf_dir, "events").select("event_id", "user_id", F.length("props").alias("size")), "user_id", "event_id", "size")


@query("last_runs", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) <= 5")
def last_runs(spark, sf_dir):
    return pacing.last_runs(table(spark, sf_dir, "events"), "user_id", "ts").select("event_id", "user_id")


@query("fingerprint", "SELECT page_id, sha256(url || '|' || len(html)) AS fingerprint FROM pages")
def fingerprint(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", runs.page_fingerprint(F.col("url"), F.col("html")).alias("fingerprint"))


@query("cache_evict", "SELECT event_id, user_id FROM events QUALIFY row_number() OVER (ORDER BY ts DESC, event_id DESC) <= count(*) OVER () - CAST(ceil((count(*) OVER () - 500) / 50.0) AS BIGINT) * 50")
def cache_evict(spark, sf_dir):
    """A cache of more than 500 entries loses its oldest ones, 50 at a time."""
    return runs.evict(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), "ts", key="event_id").drop("ts")


# ---- search and frames ----------------------------------------------------------------------------------------------

_SEARCHED = {"words": ("Token = ", False), "secret": (r"password=[0-9a-f]{4}[0-9a-f]+\b", True), "nothing": ("q", False)}
_LINES_SQL = "WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS text, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS line_no FROM documents)"


@query("search_indexed_documents", f"""{_LINES_SQL} SELECT 'words' AS name, doc_id, line_no FROM l WHERE contains(lower(text), 'token = ') UNION ALL
SELECT 'secret', doc_id, line_no FROM l WHERE regexp_matches(text, '(?i)password=[0-9a-f]{{4}}[0-9a-f]+\b') UNION ALL SELECT 'nothing', doc_id, line_no FROM l WHERE contains(lower(text), 'q')""")
def search_indexed_documents(spark, sf_dir):
    """Three searches in all documents through one table of trigrams; the last needle is too short for it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    path = f"{shared_dir(spark)}/rowloom/postings-{uuid.uuid4().hex}"
    search.write_postings(docs, path, "doc_id", "text")
    index = spark.read.parquet(path)
    found = [search.search_indexed(docs, index, needle, is_regex, True, "doc_id", "text").withColumn("name", F.lit(name)) for name, (needle, is_regex) in _SEARCHED.items()]
    return reduce(lambda a, b: a.unionByName(b), found).select("name", F.col("file").alias("doc_id"), F.col("line_no").cast("long").alias("line_no"))


@query("frames_of_pages", f"""WITH RECURSIVE p AS (SELECT page_id, len({_TEXTS}) AS items FROM pages), t(frame, top, nesting) AS (
  SELECT page_id, page_id, 0::BIGINT FROM p WHERE page_id % 7 = 0 UNION ALL SELECT p.page_id, top, nesting + 1 FROM t JOIN p ON p.page_id = t.frame + 1 WHERE p.page_id % 7 <> 0)
SELECT top AS page, arg_min(frame, (items = 0, nesting)) AS frame, arg_min(items, (items = 0, nesting))::INT AS items, max(nesting) AS depth FROM t JOIN p ON p.page_id = t.frame GROUP BY top""")
def frames_of_pages(spark, sf_dir):
    """Pages as frames within frames, each holding the next up to seven: the answer of the uppermost that has one, and how deep they go."""
    rows = table(spark, sf_dir, "pages").select("page_id", "html")
    count = F.size("items").alias("items")
    frames = pages.select_all(rows, {"items": "nav li"}).select(F.col("page_id").alias("frame"), F.when(F.col("page_id") % 7 != 0, F.col("page_id") - 1).alias("parent"), count)
    # Pages are parsed here, once; all that follows reads numbers.
    tree = search.frame_tree(cut_lineage(frames, "page-frames").withColumn("has", F.col("items") > 0))
    depth = tree.groupBy("page").agg(F.max("nesting").alias("depth"))
    first = search.lifted_of(tree, "has").select("page", "frame", "items")
    return first.join(depth, "page")
