"""Queries of transforms, predicates, dedupe, PII, similarity, sinks, grounding and robots."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions import grounding as G
from rowloom.functions import predicates as P
from rowloom.functions import similarity as S
from rowloom.functions import transforms as T
from rowloom.functions.js import WS
from rowloom.operators import dedupe as D
from rowloom.operators import pii_scan, robots
from rowloom.plans.catalogue import query, table
from rowloom.session import shared_dir
from rowloom.sinks import datasets, render

# ---- pieces of oracle SQL -------------------------------------------------------------------------------------------


def sql_collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{WS}]+', ' ', 'g'), ' ')"


def sql_number(c: str) -> str:
    """The number transform; RE2 knows the same patterns."""
    sci = f"nullif(regexp_extract({c}, '-?[0-9]+(?:[.,][0-9]+)?[eE][+-]?[0-9]+'), '')"
    body = f"regexp_replace(nullif(regexp_extract({c}, '-?[0-9][0-9.,{WS}]*[0-9]|-?[0-9]'), ''), '[{WS}]', '', 'g')"
    commas, dots = f"(len({body}) - len(replace({body}, ',', '')))", f"(len({body}) - len(replace({body}, '.', '')))"
    mark, tail = f"regexp_extract({body}, '([.,])[0-9]*$', 1)", f"regexp_extract({body}, '[.,]([0-9]*)$', 1)"
    bare = f"replace(replace({body}, ',', ''), '.', '')"
    point = f"replace(replace(left({body}, len({body}) - len({tail})), ',', ''), '.', '') || '.' || {tail}"
    finite = lambda x: f"CASE WHEN isfinite(TRY_CAST({x} AS DOUBLE)) THEN TRY_CAST({x} AS DOUBLE) END"
    text = f"""CASE WHEN {commas} > 0 AND {dots} > 0 THEN CASE WHEN CASE {mark} WHEN ',' THEN {commas} ELSE {dots} END = 1 THEN {point} END
      WHEN {commas} + {dots} = 0 THEN {body} WHEN {commas} + {dots} = 1 AND len({tail}) BETWEEN 1 AND 2 THEN {point} ELSE {bare} END"""
    return f"coalesce({finite(f"replace({sci}, ',', '.')")}, {finite(text)})"


def literals(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int | float) and not isinstance(v, bool) else str(v).upper() if isinstance(v, bool) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) t({names})"


# ---- flagship -------------------------------------------------------------------------------------------------------

EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
#: The same matches, but a long run of such characters without an @ is read once, not from each of its places; so texts of any length can be searched.
EMAIL_LINEAR = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"


@query(
    "flagship_clean_dedupe_jsonl",
    f"""WITH k AS (SELECT min(doc_id) AS doc_id FROM documents WHERE {sql_collapse("text")} <> '' GROUP BY lower({sql_collapse("text")}))
    SELECT d.doc_id, d.lang, nullif(regexp_extract(text, '{EMAIL}'), '') AS email, {sql_number("text")} AS first_number,
      CAST(to_json({{'doc_id': d.doc_id, 'lang': d.lang, 'source': d.source, 'email': nullif(regexp_extract(text, '{EMAIL}'), '')}}) AS VARCHAR) AS line
    FROM documents d JOIN k USING (doc_id)""",
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy, filter, deduplicate on the text, extract, render as JSON lines: the shape of most runs."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    kept = D.keep_first(docs.where(P.condition("not-empty", P.observed(F.col("text")))), "doc_id", ["text"])
    rows = kept.withColumn("email", F.nullif(F.regexp_extract("text", EMAIL_LINEAR, 0), F.lit(""))).withColumn("first_number", T.number(F.col("text")))
    out = rows.select("doc_id", "lang", "source", "email", "first_number")
    return out.withColumn("line", render.line(out.select("doc_id", "lang", "source", "email"), "jsonl")).drop("source")


# ---- transforms -----------------------------------------------------------------------------------------------------


@query("tf_trim", f"SELECT doc_id, {sql_collapse('text')} AS value FROM documents")
def tf_trim(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.apply_transform(F.col("text"), "trim").alias("value"))


@query("tf_lower", "SELECT doc_id, lower(text) AS value FROM documents")
def tf_lower(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.apply_transform(F.col("text"), "lower").alias("value"))


@query("tf_upper", "SELECT p_partkey, upper(p_name) AS value FROM part")
def tf_upper(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.apply_transform(F.col("p_name"), "upper").alias("value"))


# Numbers as sites write them, made of a part's key and size; the same text in both engines.
_WRITTEN = """CASE p_partkey % 12 WHEN 0 THEN '1.' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || ',5 €' WHEN 1 THEN '€ ' || p_partkey || ',' || (p_size + 10) WHEN 2 THEN p_size || 'e3'
  WHEN 3 THEN p_partkey || ' EUR' WHEN 4 THEN 'Out of stock' WHEN 5 THEN '$' || p_partkey || '.50' WHEN 6 THEN '1,' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || ' reviews'
  WHEN 7 THEN '-' || p_size WHEN 8 THEN '' WHEN 9 THEN 'abc ' || p_size || 'e3' WHEN 10 THEN p_size || '-' || p_partkey ELSE '1 ' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || ',00' END"""


@query("tf_number_literals", f"SELECT i, {sql_number('v')} AS value FROM (SELECT p_partkey AS i, {_WRITTEN} AS v FROM part)")
def tf_number_literals(spark, sf_dir):
    """The many ways in which numbers are written."""
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), T.number(F.expr(_WRITTEN)).alias("value"))


@query("tf_number_docs", f"SELECT doc_id, {sql_number('text')} AS value FROM documents")
def tf_number_docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.number(F.col("text")).alias("value"))


@query("tf_regex_group", "SELECT p_partkey, nullif(regexp_extract(p_brand, 'Brand#([0-9]+)', 1), '') AS value FROM part")
def tf_regex_group(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.regex(F.col("p_brand"), r"Brand#(\d+)").alias("value"))


@query("tf_regex_miss_null", f"SELECT doc_id, CASE WHEN len(text) <= 20000 THEN nullif(regexp_extract(text, '{EMAIL}'), '') END AS value FROM documents")
def tf_regex_miss_null(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.regex(F.col("text"), EMAIL).alias("value"))


@query("tf_base64", "SELECT p_partkey, p_name AS value, CAST(NULL AS VARCHAR) AS bad FROM part WHERE len(p_name) >= 3")
def tf_base64(spark, sf_dir):
    parts = table(spark, sf_dir, "part").where(F.length("p_name") >= 3)
    encoded = F.translate(F.regexp_replace(F.base64(F.col("p_name").cast("binary")), "=+$", ""), "+/", "-_")
    return parts.select("p_partkey", T.base64(encoded).alias("value"), T.base64(F.concat(F.lit("Total: "), F.col("p_name"))).alias("bad"))


@query("tf_chain_null_stop", f"SELECT doc_id, {sql_number(sql_collapse('text'))} AS value FROM documents")
def tf_chain(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.apply_transforms(F.col("text"), ["trim", "number"]).alias("value"))


@query(
    "tf_form_fill",
    """SELECT c_custkey, regexp_replace(c_name, '[^0-9+]', '', 'g') AS phone, lower(c_mktsegment) AS low, left(c_name, 100) AS cut, CASE WHEN len(CAST(c_nationkey AS VARCHAR)) < 5 THEN lpad(CAST(c_nationkey AS VARCHAR), 5, '0') ELSE CAST(c_nationkey AS VARCHAR) END AS padded,
    TRY_CAST(regexp_replace(c_name, '[^0-9.\\-]', '', 'g') AS DOUBLE) AS num, lower(c_mktsegment) IN ('yes', 'true', '1', 'y') AS flag FROM customer""",
)
def tf_form_fill(spark, sf_dir):
    f = T.FORM_TRANSFORMS
    name, nation = F.col("c_name"), F.col("c_nationkey").cast("string")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", f["normalize-phone"](name).alias("phone"), f["lowercase"](F.col("c_mktsegment")).alias("low"), f["truncate-100"](name).alias("cut"),
        f["pad-zero-5"](nation).alias("padded"), f["parse-number"](name).alias("num"), f["boolean"](F.col("c_mktsegment")).alias("flag"),
    )


# ---- conditions, assertions, branches -------------------------------------------------------------------------------

_CONDITION_SQL = {
    "exists": "text IS NOT NULL", "not-exists": "text IS NULL", "is-empty": f"text IS NULL OR {sql_collapse('text')} = ''", "not-empty": f"text IS NOT NULL AND {sql_collapse('text')} <> ''",
    "text-equals": f"coalesce({sql_collapse('text')} = 'the', false)", "text-contains": f"coalesce(contains({sql_collapse('text')}, 'en the'), false)", "text-matches": f"coalesce(regexp_matches({sql_collapse('text')}, '^[A-E].*[0-9]{{4}}'), false)",
    "attr-equals": "coalesce(trim(source) = 'src7', false)", "attr-contains": "coalesce(contains(source, '1'), false)", "attr-exists": "text IS NOT NULL AND source IS NOT NULL",
    "number-equals": f"coalesce({sql_number('text')} = 1, false)", "number-gt": f"coalesce({sql_number('text')} > 50, false)", "number-lt": f"coalesce({sql_number('text')} < 50, false)",
}
_CONDITION_VALUE = {"text-equals": "the", "text-contains": " en  the", "text-matches": "^[A-E].*[0-9]{4}", "attr-equals": " src7 ", "attr-contains": "1", "number-equals": "1", "number-gt": "50", "number-lt": " 50 "}


def _condition_query(name: str) -> None:
    @query(f"cond_{name.replace('-', '_')}", f"SELECT doc_id, {_CONDITION_SQL[name]} AS holds FROM documents")
    def run(spark, sf_dir):
        o = P.observed(F.col("text"), attr=F.col("source"))
        return table(spark, sf_dir, "documents").select("doc_id", P.condition(name, o, _CONDITION_VALUE.get(name, "")).alias("holds"))


for _name in P.CONDITIONS:
    _condition_query(_name)


@query("cond_compare_columns", "SELECT l_orderkey, l_linenumber, l_discount < l_tax AS holds, l_returnflag = l_linestatus AS same FROM lineitem")
def cond_compare_columns(spark, sf_dir):
    seen = lambda c: P.observed(F.col(c).cast("string"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", P.condition("number-lt", P.observed_number(F.col("l_discount")), other=P.observed_number(F.col("l_tax"))).alias("holds"), P.condition("text-equals", seen("l_returnflag"), other=seen("l_linestatus")).alias("same"))


@query(
    "assert_counts",
    """SELECT o_orderpriority, count(*) AS n, CASE WHEN count(*) >= 3000 THEN NULL ELSE 'expected at least 3000 elements matching "order", found ' || count(*) END AS too_few,
    CASE WHEN count(*) = 0 THEN NULL ELSE count(*) || CASE WHEN count(*) = 1 THEN ' element' ELSE ' elements' END || ' still match "order", and none were expected' END AS unexpected FROM orders GROUP BY 1""",
)
def assert_counts(spark, sf_dir):
    seen = table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    nothing = F.lit(None).cast("string")
    return seen.select("o_orderpriority", "n", P.assertion("count-at-least", F.col("n"), nothing, "order", wanted=3000).alias("too_few"), P.assertion("not-exists", F.col("n"), nothing, "order").alias("unexpected"))


@query("if_else_branches", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 'then' ELSE 'else' END AS branch, CASE WHEN o_totalprice > 250000 THEN upper(o_orderpriority) ELSE lower(o_orderpriority) END AS value FROM orders")
def if_else_branches(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    test = P.condition("number-gt", P.observed(F.col("o_totalprice").cast("decimal(20,2)").cast("string")), "250000")
    value = F.col("o_orderpriority")
    return orders.select("o_orderkey", F.when(test, "then").otherwise("else").alias("branch"), F.when(test, F.upper(value)).otherwise(F.lower(value)).alias("value"))


@query("sniffer_filter_substr", "SELECT page_id, url FROM pages WHERE contains(lower(url), '/de/') OR contains(lower(url), 'blog.')")
def sniffer_substr(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").where(P.capture_filter(F.col("url"), F.lit("GET"), "/DE/, blog.", "get"))


@query("sniffer_filter_regex", "SELECT event_id, event_type FROM events WHERE upper(event_type) IN ('CLICK', 'VIEW') AND regexp_matches(props, '[1-4]5')")
def sniffer_regex(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", "event_type", "props").where(P.capture_filter(F.col("props"), F.col("event_type"), "re:[1-4]5", "click, view")).drop("props")


@query("sniffer_noise", "SELECT page_id FROM pages WHERE NOT (url = '' OR contains(lower(url), '.png') OR contains(lower(url), '.jpg') OR contains(lower(url), '.css') OR contains(lower(url), '.woff'))")
def sniffer_noise(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url").where(~P.capture_noise(F.col("url"), F.lit("text/html"))).select("page_id")


# ---- dedupe ---------------------------------------------------------------------------------------------------------


@query("dedupe_fields", f"SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT min(doc_id) FROM documents GROUP BY lower({sql_collapse('text')}), text IS NULL)")
def dedupe_fields(spark, sf_dir):
    return D.keep_first(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), "doc_id", ["text"]).select("doc_id", "lang")


@query("dedupe_all_fields", "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type")
def dedupe_all_fields(spark, sf_dir):
    return D.keep_first(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id")


@query("dedupe_gate_after", "SELECT event_id, user_id FROM events WHERE event_id < 5000 OR event_id IN (SELECT min(event_id) FROM events WHERE event_id >= 5000 GROUP BY user_id)")
def dedupe_gate_after(spark, sf_dir):
    return D.keep_first(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", ["user_id"], after=F.col("event_id") >= 5000)


@query("dedupe_forever_anti", "SELECT min(o_orderkey) AS o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1995-01-01') GROUP BY o_custkey")
def dedupe_forever(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    before = orders.where(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp")).select("o_custkey")
    seen = before.select(F.sha2(D.row_key(before, ["o_custkey"]), 256).alias("key"))
    kept, _ = D.keep_unseen(orders.select("o_orderkey", "o_custkey"), "o_orderkey", seen, ["o_custkey"])
    return kept


@query(
    "dedupe_bounded_roomy",
    "SELECT min(event_id) AS event_id, user_id, event_type FROM events GROUP BY user_id, event_type",
)
def dedupe_bounded_roomy(spark, sf_dir):
    """A memory that is large enough forgets nothing and equals keep-first."""
    return D.keep_bounded(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", ["event_type"], 100, "user_id")


@query(
    "dedupe_bounded",
    """WITH RECURSIVE e AS (SELECT event_id, user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    r AS (SELECT event_id, user_id, event_type, k, true AS kept, [event_type] AS known FROM e WHERE k = 1
      UNION ALL SELECT e.event_id, e.user_id, e.event_type, e.k, NOT list_contains(r.known, e.event_type),
        CASE WHEN list_contains(r.known, e.event_type) THEN r.known WHEN len(r.known) < 2 THEN list_append(r.known, e.event_type) ELSE list_append(r.known[2:], e.event_type) END
      FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
    SELECT event_id, user_id, event_type FROM r WHERE kept""",
)
def dedupe_bounded(spark, sf_dir):
    return D.keep_bounded(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), "event_id", ["event_type"], 2, "user_id")


# ---- PII ------------------------------------------------------------------------------------------------------------

_EDGE = r"(?:^|[^0-9A-Za-z_])"
_END = r"(?:$|[^0-9A-Za-z_])"
_PII_SQL = {
    "SSN": rf"{_EDGE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_END}", "CreditCard-Visa": rf"{_EDGE}4[0-9]{{12}}([0-9]{{3}})?{_END}", "CreditCard-Mastercard": rf"{_EDGE}5[1-5][0-9]{{14}}{_END}",
    "CreditCard-Amex": rf"{_EDGE}3[47][0-9]{{13}}{_END}", "Email": r"(?i)[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}",
    "Phone": rf"\b(\+[0-9]{{1,3}})?[{WS}.-]?\(?[0-9]{{3}}\)?[{WS}.-]?[0-9]{{3}}[{WS}.-]?[0-9]{{4}}\b",
}


@query("pii_summary", " UNION ALL ".join(f"SELECT '{t}' AS type, count(*) AS n FROM documents WHERE regexp_matches(text, '{p}') HAVING count(*) > 0" for t, p in _PII_SQL.items()))
def pii_summary(spark, sf_dir):
    return pii_scan.counts_by_type(table(spark, sf_dir, "documents"), ["text"])


@query("pii_scan_rows", " UNION ALL ".join(f"SELECT doc_id AS row_index, 'text' AS field, '{t}' AS type FROM documents WHERE regexp_matches(text, '{p}')" for t, p in _PII_SQL.items()))
def pii_scan_rows(spark, sf_dir):
    return pii_scan.scan_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", limit=None)


@query("pii_scan_first_50", "WITH f AS (" + " UNION ALL ".join(f"SELECT doc_id AS row_index, 'text' AS field, '{t}' AS type, {i} AS k FROM documents WHERE regexp_matches(text, '{p}')" for i, (t, p) in enumerate(_PII_SQL.items())) + ") SELECT row_index, field, type FROM f ORDER BY row_index, k LIMIT 50")
def pii_first(spark, sf_dir):
    return pii_scan.scan_rows(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("pii_has", "SELECT conv_id, turn, " + " OR ".join(f"regexp_matches(text, '{p}')" for p in _PII_SQL.values()) + " AS has_pii FROM conversations")
def pii_has(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", pii_scan.has_pii([F.col("text")]).alias("has_pii"))


# ---- similarity -----------------------------------------------------------------------------------------------------


@query("sim_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, 1 - levenshtein(lower(a.n_name), lower(b.n_name)) / greatest(len(a.n_name), len(b.n_name)) AS sim FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def sim_levenshtein(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    return a.join(b, "n_regionkey").select("a", "b", S.levenshtein_similarity(F.col("a"), F.col("b")).alias("sim"))


_TOKENS = r"list_distinct(list_filter(string_split_regex(lower(regexp_replace({c}, '([a-z])([A-Z])', '\1 \2', 'g')), '[\s_\-./\\\[\]()+,;:]+'), lambda x: x <> ''))"


@query(
    "sim_jaccard",
    f"""WITH t AS (SELECT p_partkey, {_TOKENS.format(c="p_name")} AS a, {_TOKENS.format(c="p_type || ' ring'")} AS b FROM part)
    SELECT p_partkey, CASE WHEN len(list_distinct(a || b)) = 0 THEN 1.0 ELSE CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(a || b)) END AS sim FROM t""",
)
def sim_jaccard(spark, sf_dir):
    a, b = S.tokens(F.col("p_name")), S.tokens(F.concat("p_type", F.lit(" ring")))
    return table(spark, sf_dir, "part").select("p_partkey", S.jaccard(a, b).alias("sim"))


@query(
    "field_match_score",
    f"""WITH t AS (SELECT p_partkey, lower(p_name) AS x, 'red widget' AS y, {_TOKENS.format(c="p_name")} AS a, ['red', 'widget'] AS b FROM part)
    SELECT p_partkey, greatest(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(a || b)), 1 - levenshtein(x, y) / greatest(len(x), len(y))) AS score FROM t""",
)
def field_match(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", S.field_match_score(F.lit("red widget"), F.col("p_name")).alias("score"))


_RECORD = """CASE c_nationkey % 4
  WHEN 0 THEN '{"customerName":"' || c_name || '","acct_balance":' || c_custkey || ',"@id":"x"}' WHEN 1 THEN '{"Name":"' || c_name || '","market segment":"' || c_mktsegment || '"}'
  WHEN 2 THEN '{"name":"","customer-name":"' || c_name || '","account-balance":' || c_custkey || '}' ELSE '[' || c_custkey || ']' END"""


@query(
    "schema_map_greedy",
    """SELECT c_custkey, CASE c_nationkey % 4 WHEN 0 THEN c_name WHEN 2 THEN c_name END AS "customer name", CASE WHEN c_nationkey % 4 IN (0, 2) THEN CAST(c_custkey AS VARCHAR) END AS "account balance",
    CASE c_nationkey % 4 WHEN 1 THEN c_mktsegment END AS "marketSegment" FROM customer""",
)
def schema_map(spark, sf_dir):
    """Fields out of records whose keys are called differently from nation to nation."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.expr(_RECORD).alias("record"))
    return S.schema_rows(rows, "record", ["customer name", "account balance", "marketSegment"]).drop("record")


# ---- sinks ----------------------------------------------------------------------------------------------------------

_CSV = lambda c: f"CASE WHEN regexp_matches({c}, '[\",\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END"
_SINK_SQL = {
    "csv": f"SELECT -1 AS seq, 'doc_id,text,lang' AS line UNION ALL SELECT doc_id, doc_id || ',' || {_CSV('text')} || ',' || {_CSV('lang')} FROM documents",
    "tsv": "SELECT -1 AS seq, 'doc_id' || chr(9) || 'text' || chr(9) || 'lang' AS line UNION ALL SELECT doc_id, doc_id || chr(9) || translate(text, chr(9) || chr(13) || chr(10), '   ') || chr(9) || lang FROM documents",
    "markdown": "SELECT -2 AS seq, '| doc_id | text | lang |' AS line UNION ALL SELECT -1, '| --- | --- | --- |' UNION ALL SELECT doc_id, '| ' || doc_id || ' | ' || regexp_replace(replace(text, '|', '\\|'), '\\r?\\n', ' ', 'g') || ' | ' || lang || ' |' FROM documents",
    "xml": "SELECT -2 AS seq, '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' AS line UNION ALL SELECT -1, '<rows>' UNION ALL SELECT doc_id, '  <row>' || chr(10) || '    <doc_id>' || doc_id || '</doc_id>' || chr(10) || '    <text>' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;') || '</text>' || chr(10) || '    <lang>' || lang || '</lang>' || chr(10) || '  </row>' FROM documents",
    "jsonl": "SELECT c_custkey AS seq, CAST(to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey}) AS VARCHAR) AS line FROM customer",
}


def _sink_query(fmt: str) -> None:
    @query(f"export_{fmt}_lines", _SINK_SQL[fmt])
    def run(spark, sf_dir):
        if fmt == "jsonl":
            rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey")
            return render.render_lines(rows.withColumn("seq", F.col("c_custkey")), fmt, "seq")
        rows = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
        return render.render_lines(rows.withColumn("seq", F.col("doc_id")), fmt, "seq")


for _fmt in _SINK_SQL:
    _sink_query(_fmt)


_PAIR = "n_nationkey || CASE WHEN n_nationkey % 2 = 0 THEN ' ,\"' ELSE '  <&>' END || n_name || '  '"
_FILE_SQL = {
    "csv": f"SELECT 'k,v' AS value UNION ALL SELECT n_nationkey || ',' || {_CSV('v')} FROM n",
    "tsv": "SELECT 'k' || chr(9) || 'v' AS value UNION ALL SELECT n_nationkey || chr(9) || v FROM n",
    "jsonl": "SELECT CAST(to_json({'k': n_nationkey, 'v': v}) AS VARCHAR) AS value FROM n",
    "json": "SELECT '[' AS value UNION ALL SELECT ']' UNION ALL SELECT '  {' FROM n UNION ALL SELECT '    \"k\": ' || n_nationkey || ',' FROM n UNION ALL SELECT '    \"v\": ' || CAST(to_json(v) AS VARCHAR) FROM n UNION ALL SELECT CASE WHEN n_nationkey < (SELECT max(n_nationkey) FROM nation) THEN '  },' ELSE '  }' END FROM n",
    "xml": "SELECT '<?xml version=\"1.0\" encoding=\"UTF-8\"?>' AS value UNION ALL SELECT unnest(['<rows>', '</rows>']) UNION ALL SELECT unnest(['  <row>', '    <k>' || n_nationkey || '</k>', '    <v>' || replace(replace(replace(replace(v, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || '</v>', '  </row>']) FROM n",
    "markdown": "SELECT '| k | v |' AS value UNION ALL SELECT '| --- | --- |' UNION ALL SELECT '| ' || n_nationkey || ' | ' || v || ' |' FROM n",
}


def _file_query(fmt: str) -> None:
    @query(f"export_{fmt}_file", f"WITH n AS (SELECT n_nationkey, {_PAIR} AS v FROM nation) {_FILE_SQL[fmt]}")
    def run(spark, sf_dir):
        """A whole file as it was written, line by line; cells have quotes, marks and white space at their ends."""
        between = F.when(F.col("n_nationkey") % 2 == 0, ' ,"').otherwise("  <&>")
        rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("seq"), F.col("n_nationkey").alias("k"), F.concat(F.col("n_nationkey").cast("string"), between, "n_name", F.lit("  ")).alias("v"))
        path = f"{shared_dir(spark)}/rowloom/export-{uuid.uuid4().hex}"
        render.write_document(rows, fmt, path, order="seq")
        return spark.read.option("lineSep", "\r\n" if fmt == "csv" else "\n").text(path)


for _fmt in _FILE_SQL:
    _file_query(_fmt)


@query("header_union", "SELECT n_nationkey, n_name, n_regionkey, CAST(NULL AS INTEGER) AS r_regionkey, CAST(NULL AS VARCHAR) AS r_name FROM nation UNION ALL SELECT NULL, NULL, NULL, r_regionkey, r_name FROM region")
def header_union(spark, sf_dir):
    return render.union_rows(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"))


_HEADED = "CASE WHEN c_custkey % 7 = 3 THEN 'b=1,a=2' WHEN c_custkey % 5 = 4 THEN 'a=1,n' || c_nationkey || '=2,c=3' ELSE 'a=1' END"


@query(
    "header_order",
    f"""WITH r AS (SELECT c_custkey AS seq, string_split({_HEADED}, ',') AS p FROM customer), k AS (SELECT seq, unnest(range(len(p))) AS pos, string_split(unnest(p), '=')[1] AS key FROM r)
    SELECT key, min((seq, pos))[1] AS seq, min((seq, pos))[2]::INT AS pos FROM k GROUP BY key""",
)
def header_order(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("seq"), F.str_to_map(F.expr(_HEADED), F.lit(","), F.lit("=")).alias("row"))
    return render.header_order(rows, "seq")


@query("dataset_list", "SELECT o_orderpriority AS dataset, count(*) AS rows FROM orders GROUP BY 1")
def dataset_list(spark, sf_dir):
    return datasets.listing(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset")))


@query("dataset_append", "SELECT o_orderkey, o_custkey FROM orders QUALIFY row_number() OVER (ORDER BY o_orderkey % 2, o_orderkey) <= 10000")
def dataset_append(spark, sf_dir):
    """Two appends to one dataset, of which the second overflows its cap."""
    orders, root = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), f"{shared_dir(spark)}/rowloom/sets-{uuid.uuid4().hex}"
    for part in (0, 1):
        datasets.append(orders.where(F.col("o_orderkey") % 2 == part), root, "orders", cap=10_000, order="o_orderkey")
    return datasets.read(spark, root, "orders")


@query("dataset_append_cap", "SELECT o_orderpriority AS dataset, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) <= 500")
def dataset_cap(spark, sf_dir):
    return datasets.capped(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("dataset"), "o_orderkey"), "dataset", "o_orderkey", 500)


@query("export_row_key", "SELECT n_nationkey, '[[\"n_name\",\"' || n_name || '\"],[\"n_nationkey\",' || n_nationkey || ']]' AS key FROM nation")
def export_row_key(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return rows.select("n_nationkey", D.export_key(rows).alias("key"))


@query("coverage_percent", "SELECT doc_id, CAST(floor((CAST(text IS NOT NULL AND text <> '' AS INTEGER) + CAST(lang IS NOT NULL AS INTEGER) + CAST(source = 'src1' AS INTEGER)) * 100 / 3.0 + 0.5) AS INTEGER) AS coverage FROM documents")
def coverage_percent(spark, sf_dir):
    known = F.when(F.col("source") == "src1", F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", G.coverage([F.col("text"), F.col("lang"), known]).alias("coverage"))


@query("export_merge_stores", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT min(o_orderkey), o_custkey FROM orders WHERE o_orderkey % 2 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY o_custkey")
def merge_stores(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    stored = orders.where("o_orderkey % 2 <> 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey", "o_custkey")
    return datasets.merge_stores(orders.where("o_orderkey % 2 = 0"), stored, "o_custkey")


@query("export_merge_all_orders", "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 3 = 0 UNION ALL SELECT min(o_orderkey), o_custkey FROM orders WHERE o_orderkey % 3 <> 0 AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 3 = 0) GROUP BY o_custkey")
def merge_all_orders(spark, sf_dir):
    """The same with every order in one of the two stores."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    stored = orders.where("o_orderkey % 3 <> 0").groupBy("o_custkey").agg(F.min("o_orderkey").alias("o_orderkey")).select("o_orderkey", "o_custkey")
    return datasets.merge_stores(orders.where("o_orderkey % 3 = 0"), stored, "o_custkey")


# ---- grounding and provenance ---------------------------------------------------------------------------------------

_STATED = "p_name || ' by ' || p_brand || '. The price was £1,' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') || '.00 in total, on /p/' || translate(CAST(p_partkey AS STRING), '0123456789', 'abcdefghij') || '/ of the ' || p_type || ' file'"
_CLAIMED = """CASE p_partkey % 9 WHEN 0 THEN upper(p_name) WHEN 1 THEN '1' || lpad(CAST(p_partkey % 1000 AS STRING), 3, '0') WHEN 2 THEN 'Grace Hopper 2026' WHEN 3 THEN 'of' WHEN 4 THEN 'https://shop.test/p/' || translate(CAST(p_partkey AS STRING), '0123456789', 'abcdefghij') || '/'
  WHEN 5 THEN 'https://shop.test/q/x' || p_partkey WHEN 6 THEN p_brand || '; ' || p_type WHEN 7 THEN p_brand || ', fraud' ELSE 'zq' END"""


@query("grounding_verdicts", "SELECT p_partkey AS i, ['exact', 'number', 'missing', 'unproven', 'url', 'missing', 'parts', 'missing', 'unproven'][p_partkey % 9 + 1] AS how FROM part")
def grounding_verdicts(spark, sf_dir):
    """Claims about every part, held against a text about it."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr(_CLAIMED).alias("v"), G.corpus(F.expr(_STATED)).alias("page"))
    return rows.select(F.col("p_partkey").alias("i"), G.ground(F.col("v"), F.col("page")).alias("how"))


@query("grounding_documents", f"SELECT doc_id, CASE WHEN contains(lower({sql_collapse('text')}), 'then the') THEN 'exact' WHEN contains(lower({sql_collapse('text')}), 'then') AND contains(lower({sql_collapse('text')}), 'theanor') THEN 'parts' ELSE 'missing' END AS how FROM documents")
def grounding_documents(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", G.normalise(F.col("text")).alias("folded"), G.numbers_in(F.col("text")).alias("numbers"))
    page = F.struct(F.col("folded").alias("text"), "numbers")
    whole, parts = G.ground(F.lit("Then THE"), page), G.ground(F.lit("then, theanor"), page)
    return docs.select("doc_id", F.when(whole == "exact", "exact").otherwise(parts).alias("how"))


_SOURCES = ["json-ld:headline", "meta:og:title", "llm", "llm", "none", "heuristic", "microdata"]
_HOW = ["exact", "missing", "number", "unproven", "exact", "exact", "parts"]


def _pick(values: list[str], by: str) -> str:
    return f"CASE {by} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"


@query("provenance_column", f"""SELECT p_partkey, 'f=' || CASE WHEN p_partkey % 7 = 4 THEN 'none' ELSE {_pick(["json-ld(headline)", "meta(og:title)", "llm", "llm", "none", "heuristic", "microdata"], "p_partkey % 7")} || ':' || p_size
  || CASE WHEN p_partkey % 7 = 2 THEN ' verified' ELSE '' END END AS col FROM part""")
def provenance_column(spark, sf_dir):
    """Where a part's name came from, and how sure that is."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.expr("CASE WHEN p_partkey % 7 <> 4 THEN p_name END").alias("v"), "p_size", F.expr(_pick(_SOURCES, "p_partkey % 7")).alias("src"), F.expr(_pick(_HOW, "p_partkey % 7")).alias("how"))
    record = G.provenance("f", F.col("v"), F.col("p_size"), F.col("src"), F.col("how"))
    return rows.select("p_partkey", G.provenance_column(F.array(record)).alias("col"))


@query("confidence_merge", "SELECT p_partkey, CAST(floor((30 * p_size + 25 * (p_partkey % 101) + 15 * coalesce(CASE WHEN p_size % 3 > 0 THEN p_size END, 0)) / 70.0 + 0.5) AS INTEGER) AS confidence FROM part")
def confidence_merge(spark, sf_dir):
    sure = {"name": F.col("p_size"), "price": F.col("p_partkey") % 101, "images": F.when(F.col("p_size") % 3 > 0, F.col("p_size"))}
    return table(spark, sf_dir, "part").select("p_partkey", G.weighted_confidence(sure, S.PRODUCT_WEIGHTS).alias("confidence"))


# An observation of a selector in each event: whose field it was, what was found, and what should have been.
_SEEN = {
    "selector": "CASE event_id % 4 WHEN 0 THEN '.price' WHEN 1 THEN 'div > p > b > i' WHEN 2 THEN '' ELSE 'b:nth-child(' || (user_id % 3) || ')' END",
    "expected": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE event_type END", "n": "CAST(CASE WHEN event_id % 13 < 9 THEN 1 ELSE event_id % 4 END AS INT)", "text": "CASE WHEN event_id % 5 < 4 THEN upper(event_type) ELSE 'other' END",
    "error": "CASE WHEN event_id % 17 = 0 THEN 'unreadable' END",
}
_JUDGED = """CASE WHEN selector = '' OR expected IS NULL OR expected = '' THEN NULL WHEN error IS NOT NULL THEN 'bad-selector' WHEN n = 0 THEN 'not-found' WHEN n > 1 THEN 'ambiguous'
  WHEN lower(text) <> lower(expected) THEN 'wrong-value' ELSE 'verified' END"""
_OBSERVED = f"WITH s AS (SELECT event_id, user_id, {', '.join(f'{sql} AS {name}' for name, sql in _SEEN.items())} FROM events), j AS (SELECT *, {_JUDGED} AS status FROM s)"


def _observations(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", *(F.expr(sql).alias(name) for name, sql in _SEEN.items()))
    return rows.withColumn("status", G.judge_selector(*(F.col(c) for c in ("selector", "expected", "n", "text", "error"))))


@query("selector_learning", f"{_OBSERVED} SELECT event_id, status FROM j")
def selector_learning(spark, sf_dir):
    return _observations(spark, sf_dir).select("event_id", "status")


@query(
    "selector_history",
    f"""{_OBSERVED}, h AS (SELECT user_id, selector, count(*) FILTER (WHERE status = 'verified') AS verified, count(*) AS runs, selector <> '.price' AS fragile FROM j WHERE status IS NOT NULL GROUP BY ALL)
    SELECT user_id, selector, verified, runs, fragile FROM h WHERE 2 * verified > runs
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY fragile, floor(verified * 1000000000 / runs) DESC, runs DESC, selector) = 1""",
)
def selector_history(spark, sf_dir):
    """The selector that each user's field is best read by, from the merged histories of two halves of the runs."""
    seen = _observations(spark, sf_dir)
    halves = (G.selector_history(seen.where(F.col("event_id") % 2 == k), ["user_id"]) for k in (0, 1))
    return G.learnt_selectors(G.merge_histories(*halves, ["user_id"]), ["user_id"]).select("user_id", "selector", "verified", "runs", "fragile")


# ---- robots and origins ---------------------------------------------------------------------------------------------

ROBOTS = "User-agent: *\nDisallow: /en/\nAllow: /en/7\nDisallow: /*.html$\nAllow:\n\nUser-agent: other\nDisallow: /\n"


@query(
    "robots_allowed",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, CASE WHEN regexp_matches(path, '^/.*\\.html$') THEN false WHEN starts_with(path, '/en/7') THEN true WHEN starts_with(path, '/en/') THEN false ELSE true END AS allowed FROM p""",
)
def robots_allowed(spark, sf_dir):
    path = F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1)
    return table(spark, sf_dir, "pages").select("page_id", robots.allowed(path, robots.parse_robots(ROBOTS)["rules"]).alias("allowed"))


@query(
    "robots_by_host",
    """WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS path FROM pages)
    SELECT page_id, NOT (starts_with(path, '/en/') AND NOT contains(path, '7')) AS allowed FROM p""",
)
def robots_by_host(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"), F.regexp_extract("url", "^[a-z]+://[^/?#]*([^?#]*)", 1).alias("path"))
    hosts = pages.select("host").distinct()
    rules = hosts.select("host", F.lit("*").alias("agent"), F.explode(F.array(F.struct(F.lit("/en/").alias("path"), F.lit(False).alias("allow")), F.struct(F.lit("/en/*7").alias("path"), F.lit(True).alias("allow")))).alias("r")).select("host", "agent", "r.path", "r.allow")
    return robots.allowed_by_host(pages, rules, key="page_id").select("page_id", "allowed")


@query("origin_allowlist", "SELECT page_id FROM pages WHERE lower(regexp_extract(url, '^([a-z]+://[^/?#]+)', 1)) NOT IN ('https://tionble.example.org', 'http://blog.tionsh.example.com')")
def origin_allowlist(spark, sf_dir):
    return robots.undeclared(table(spark, sf_dir, "pages"), "url", ["https://tionble.example.org", "http://blog.TIONSH.example.com"]).select("page_id")


