"""Operators over tables of pages (a url and html column): one Arrow-batched parse per page, then Catalyst."""

from __future__ import annotations

import json
from collections import Counter

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rowloom.html import read
from rowloom.html.select import scoped, select
from rowloom.html.tree import parse
from rowloom.session import ship_package

BATCH_ROWS = 1000
#: Pages of a batch whose values a task holds as Python objects at once.
HELD_PAGES = 64


def _per_page(df: DataFrame, build, column: str, kind: pa.DataType, spark_type: str, url: str, html: str, scope: str | None = None) -> DataFrame:
    """df's columns but for the html, with build(document, url) as a new column; with a scope column, build(document, url,
    its value); with a column _filled, the keyword filled has its value. Rows of one page that follow each other share its tree."""
    ship_package(df.sparkSession)
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    kept = [c for c in df.columns if c not in (html, column)]
    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept)

    def run(batches):
        known, tree = object(), None
        for b in (whole.slice(at, HELD_PAGES) for whole in batches for at in range(0, whole.num_rows, HELD_PAGES)):
            urls = b.column(url).to_pylist() if url in b.schema.names else [None] * b.num_rows
            more = [b.column(scope).to_pylist()] if scope is not None and scope in b.schema.names else []
            texts = b.column(FILLED).to_pylist() if FILLED in b.schema.names else None
            values = []
            for i, (h, u, *s) in enumerate(zip(b.column(html).to_pylist(), urls, *more, strict=True)):
                if h != known:
                    known, tree = h, parse(h)
                values.append(build(tree, u, *s) if texts is None else build(tree, u, *s, filled=texts[i]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(values, kind)], names=[*kept, column])

    return df.select(*kept, html).mapInArrow(run, f"{fields}, `{column}` {spark_type}")


def assemble_rows(df: DataFrame, values: str, names: list[str], position: str = "_row") -> DataFrame:
    """Rows from lists of values, one list a field: as many as the longest list (at least one); a list of one is broadcast, others are null past their end."""
    lists = [F.col(values)[i] for i in range(len(names))]
    longest = F.greatest(F.lit(1), *(F.size(x) for x in lists)) if lists else F.lit(1)
    dealt = df.withColumn(position, F.explode(F.sequence(F.lit(1), longest)))
    cell = lambda i: F.when(F.size(lists[i]) == 1, lists[i][0]).otherwise(F.try_element_at(lists[i], F.col(position)))
    return dealt.select(*(c for c in df.columns if c != values and c not in names), (F.col(position) - 1).alias(position), *(cell(i).alias(n) for i, n in enumerate(names)))


#: A column with the records of a page that are in scope, each as the numbers of its loops joined by dots; null: all.
SCOPE = "_scope"


#: A column with the texts that a row has for the templates of a step's configuration.
FILLED = "_filled"


def records(document, loops: list[str | tuple[str, int]], scope: list[str] | None = None) -> list[tuple[str, object]]:
    """(place, record) of the innermost of nested loops: each is run within the records of the one around it, up to its
    limit if it comes with one above 0. The place has the record's number in each loop; a scope has places, and only records at or below one of them count."""
    out = [("", None)]
    for depth, loop in enumerate(loops):
        selector, most = (loop, 0) if isinstance(loop, str) else loop
        found = ((place, select(document if node is None else node, selector)[: most or None]) for place, node in out)
        out = [(f"{place}.{i}" if depth else str(i), n) for (place, nodes) in found for i, n in enumerate(nodes)]
    if scope is None:
        return out
    known = set(scope)
    return [(p, n) for p, n in out if any(".".join(p.split(".")[: k + 1]) in known for k in range(p.count(".") + 1))]


def extract(pages: DataFrame, fields: list[dict], loop: str | list[str] | None = None, url: str = "url", html: str = "html", fallback: bool = True) -> DataFrame:
    """Fields to rows. With loop, each match of that selector is a record with its own rows, and fields that a record has no
    match for are read from the whole page (fallback=False leaves them null); a list has loops within loops, and a column
    _scope the records that count. No fields give no rows."""
    if not fields:
        return pages.drop(html).limit(0)
    specs = [read.check_field(f) for f in fields]
    names = [s["name"] for s in specs]

    loops = [loop] if isinstance(loop, str) else list(loop or [])

    def build(document, base, scope=None, filled=None):
        return [{"index0": i, "values": values} for i, values in _record_values(document, base, scope, filled, specs, loops, fallback)]

    kind = pa.list_(pa.struct([("index0", pa.int32()), ("values", pa.list_(pa.list_(pa.string())))]))
    found = _per_page(pages, build, "__found", kind, "array<struct<index0:int,values:array<array<string>>>>", url, html, SCOPE)
    kept = [c for c in found.columns if c not in ("__found", "_record", "_row", SCOPE, FILLED, *names)]
    each = found.select(*kept, F.explode("__found").alias("r")).select(*kept, F.col("r.index0").alias("_record"), F.col("r.values").alias("__values"))
    return assemble_rows(each, "__values", names)


def _record_values(document, base, scope, filled, specs, loops, fallback=True):
    """(number, lists of values) of each record of a page, or of the page as a whole."""
    from rowloom.plans.context import fill

    specs = fill(specs, filled)
    if not loops:
        yield 0, read.field_values(document, specs, base)
        return
    for i, (_, record) in enumerate(records(document, loops, scope)):
        if fallback:
            yield i, read.field_values(document, specs, base, record)
        else:
            yield i, [[read.value_of(n, s, base) for n in (select(record, s["selector"]) if s.get("selector") else [record])] for s in specs]


def last_values(pages: DataFrame, fields: list[dict], loop: list | None = None, url: str = "url", html: str = "html") -> DataFrame:
    """The pages as they are, and in _last the values (an array in the order of the fields) of the last row that extract
    gives for each; null where it gives none."""
    specs, loops = [read.check_field(f) for f in fields], list(loop or [])

    def build(document, base, scope=None, filled=None):
        out = None
        for _, values in _record_values(document, base, scope, filled, specs, loops):
            i = max(1, *map(len, values)) - 1
            out = [v[0] if len(v) == 1 else v[i] if i < len(v) else None for v in values]
        return out

    whole = pages.withColumn("__html", F.col(html))
    return _per_page(whole, build, "_last", pa.list_(pa.string()), "array<string>", url, html, SCOPE).withColumnRenamed("__html", html)


def bind_records(pages: DataFrame, loops: list, url: str = "url", html: str = "html") -> DataFrame:
    """The pages, a row for each record of the innermost loop: the record alone in scope, its facts in __item, its number
    among those of its outer record in __i and their count in __n, and its place, padded, in __place."""

    def build(document, base, scope=None, filled=None):
        found = records(document, loops, scope)
        outer = [p.rpartition(".")[0] for p, _ in found]
        count, number, out = Counter(outer), Counter(), []
        for (place, node), o in zip(found, outer, strict=True):
            item = read.loop_item(node, number[o], base)
            out.append({"place": place, "item": list(item.items()), "i": number[o], "n": count[o]})
            number[o] += 1
        return out

    each = pa.struct([("place", pa.string()), ("item", pa.map_(pa.string(), pa.string())), ("i", pa.int32()), ("n", pa.int32())])
    whole = pages.drop(FILLED).withColumn("__html", F.col(html))
    found = _per_page(whole, build, "__records", pa.list_(each), "array<struct<place:string,item:map<string,string>,i:int,n:int>>", url, html, SCOPE)
    kept = [c for c in found.columns if c not in ("__records", "__html", SCOPE)]
    dealt = found.select(*kept, F.col("__html").alias(html), F.explode("__records").alias("r"))
    padded = F.array_join(F.transform(F.split("r.place", r"\."), lambda p: F.lpad(p, 8, "0")), ".")
    return dealt.select(*kept, html, F.array("r.place").alias(SCOPE), F.col("r.item").alias("__item"), F.col("r.i").alias("__i"), F.col("r.n").alias("__n"), padded.alias("__place"))


def follow(pages: DataFrame, selector: str, url: str = "url", html: str = "html") -> DataFrame:
    """(url, place, next): the addresses of the elements that the selector finds on each page, in order."""
    from rowloom.functions.transforms import absolute_url

    def links(document, base):
        found = (n.attrs.get("href") or "" for n in scoped(document, selector))
        return [u for u in (absolute_url(h, base) for h in found if h) if u]

    found = _per_page(pages.select(url, html), links, "__next", pa.list_(pa.string()), "array<string>", url, html)
    return found.select(F.col(url).alias("url"), F.posexplode("__next").alias("place", "next"))


def query_count(pages: DataFrame, selector: str, url: str = "url", html: str = "html") -> DataFrame:
    return _per_page(pages, lambda d, _: len(scoped(d, selector)), "count", pa.int32(), "int", url, html)


def loop_items(pages: DataFrame, selector: str, url: str = "url", html: str = "html") -> DataFrame:
    """A row for each match, with `item` (MAP) and `loop` (index, index0, first, last, count)."""
    build = lambda d, base: [list(read.loop_item(n, i, base).items()) for i, n in enumerate(scoped(d, selector))]
    found = _per_page(pages, build, "__items", pa.list_(pa.map_(pa.string(), pa.string())), "array<map<string,string>>", url, html)
    kept = [c for c in found.columns if c != "__items"]
    n = F.size("__items")
    dealt = found.select(*kept, n.alias("__n"), F.posexplode("__items").alias("__i", "item"))
    loop = F.struct((F.col("__i") + 1).alias("index"), F.col("__i").alias("index0"), (F.col("__i") == 0).alias("first"), (F.col("__i") + 1 == F.col("__n")).alias("last"), F.col("__n").alias("count"))
    return dealt.select(*kept, "item", loop.alias("loop"))


def page_data(pages: DataFrame, source: str = "auto", kind: str = "", flat: bool = False, url: str = "url", html: str = "html", loops: list | None = None) -> DataFrame:
    """`data`: found, title, records (JSON texts), meta, sources, warnings and reason; in loops, a row for each record
    (_record), read as a document of its own."""
    from rowloom.plans.context import fill

    read.page_data(parse(""), None, source)

    def build(document, base, filled=None):
        d = read.page_data(document, base, source, fill(kind, filled), flat)
        return d | {"records": [json.dumps(r, ensure_ascii=False) for r in d["records"]], "meta": list(d["meta"].items())}

    texts = pa.list_(pa.string())
    arrow = pa.struct([("found", pa.bool_()), ("title", pa.string()), ("records", texts), ("meta", pa.map_(pa.string(), pa.string())), ("sources", texts), ("warnings", texts), ("reason", pa.string())])
    kind_of = "struct<found:boolean,title:string,records:array<string>,meta:map<string,string>,sources:array<string>,warnings:array<string>,reason:string>"
    return _in_records(pages, build, "data", arrow, kind_of, url, html, loops)


def _in_records(pages: DataFrame, build, column: str, arrow: pa.DataType, kind: str, url: str, html: str, loops: list | None, model_col: str | None = None) -> DataFrame:
    """build of each page as a new column; in loops, a row for each record (_record), of which build sees a tree of its own."""
    if not loops:
        return _per_page(pages, build, column, arrow, kind, url, html, model_col)

    def each(document, base, scope=None, filled=None):
        alone = ((lone_tree(document, r)) for _, r in records(document, loops, scope))
        return [build(t, base) if filled is None else build(t, base, filled=filled) for t in alone]

    found = _per_page(pages, each, "__each", pa.list_(arrow), f"array<{kind}>", url, html, SCOPE)
    kept = [c for c in found.columns if c not in ("__each", "_record", SCOPE)]
    return found.select(*kept, F.posexplode("__each").alias("_record", column))


def lone_tree(document, record):
    """A document with a copy of a record as its whole content."""
    import copy

    top = copy.copy(document)
    held = copy.copy(record)
    held.parent, top.children = top, [held]
    return top


def page_json(pages: DataFrame, mode: str = "tree", url: str = "url", html: str = "html", loops: list[str] | None = None, **options) -> DataFrame:
    """`page`: found, nodes, truncated, reason, text (lines), rows (flat) and tree (JSON text); in loops, a row for each record."""
    from rowloom.plans.context import fill

    read.page_json(parse("<p>"), None, mode, **options)

    def build(document, base, record=None, filled=None):
        d = read.page_json(document, base, mode, record=record, **fill(options, filled))
        return d | {"tree": json.dumps(d["tree"], ensure_ascii=False) if d["tree"] else None}

    row = pa.struct([(k, pa.string()) for k in ("tag", "path", "text", "href", "src", "id", "class")])
    arrow = pa.struct([("found", pa.bool_()), ("title", pa.string()), ("nodes", pa.int32()), ("truncated", pa.bool_()), ("reason", pa.string()), ("text", pa.list_(pa.string())), ("rows", pa.list_(row)), ("tree", pa.string())])
    spark_row = "struct<tag:string,path:string,text:string,href:string,src:string,id:string,class:string>"
    spark_page = f"struct<found:boolean,title:string,nodes:int,truncated:boolean,reason:string,text:array<string>,rows:array<{spark_row}>,tree:string>"
    if not loops:
        return _per_page(pages, build, "page", arrow, spark_page, url, html)

    def each(document, base, scope=None, filled=None):
        return [build(document, base, record, filled) for _, record in records(document, loops, scope)]

    found = _per_page(pages, each, "__pages", pa.list_(arrow), f"array<{spark_page}>", url, html, SCOPE)
    kept = [c for c in found.columns if c not in ("__pages", "_record", SCOPE)]
    return found.select(*kept, F.posexplode("__pages").alias("_record", "page"))


def with_nodes(pages: DataFrame, column: str = "nodes", url: str = "url", html: str = "html") -> DataFrame:
    """The pages without their html, and their elements as an array in document order (rowloom.html.nodes.NODE)."""
    from rowloom.html.nodes import NODE

    def build(document, _):
        order = list(document.walk())[1:]
        numbers = {id(n): i for i, n in enumerate(order)}
        out = []
        for i, n in enumerate(order):
            up = numbers.get(id(n.parent))
            above = out[up] if up is not None else None
            kids = n.elements()
            texts = [c for c in n.children if isinstance(c, str)]
            out.append({
                "pre": i, "post": i, "parent": up, "depth": above["depth"] + 1 if above else 0, "tag": n.tag, "id": n.attrs.get("id"), "classes": n.attrs.get("class", "").split(), "attrs": list(n.attrs.items()),
                "own_text": read.clean(n.own_text()), "texts": texts, "path": [*above["path"], up] if above else [], "kids": [numbers[id(k)] for k in kids], "empty": not kids and not any(texts),
                "inside": bool(above and (above["inside"] or above["tag"] == "template")),
            })
        for i in range(len(out) - 1, 0, -1):
            up = out[i]["parent"]
            if up is not None:
                out[up]["post"] = max(out[up]["post"], out[i]["post"])
        for kids in ([n for n in out if n["parent"] is None], *([out[k] for k in n["kids"]] for n in out)):
            of_type, seen = Counter(k["tag"] for k in kids), Counter()
            for i, k in enumerate(kids):
                seen[k["tag"]] += 1
                k |= {"nth": i + 1, "of": len(kids), "nth_type": seen[k["tag"]], "of_type": of_type[k["tag"]]}
        return out

    strings, ints = pa.list_(pa.string()), pa.list_(pa.int32())
    kinds = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": strings, "array<int>": ints, "map<string,string>": pa.map_(pa.string(), pa.string())}
    fields = [(f.name, kinds[f.dataType.simpleString()]) for f in T._parse_datatype_string(NODE).fields]
    return _per_page(pages, build, column, pa.list_(pa.struct(fields)), f"array<{NODE}>", url, html)


def select_all(pages: DataFrame, selectors: dict[str, str], url: str = "url", html: str = "html") -> DataFrame:
    """The pages without their html, and for each name the elements that its selector finds, as an array: one parse for all."""
    from rowloom.html.nodes import matches

    found = with_nodes(pages, "__nodes", url, html)
    return found.withColumns({name: matches(F.col("__nodes"), s) for name, s in selectors.items()}).drop("__nodes")


def node_table(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A row for each element: pre, post, parent, depth, tag, id, classes, attrs, own_text. A descendant has pre between an element's pre and post."""
    found = with_nodes(pages, "__nodes", url, html)
    kept = [c for c in found.columns if c != "__nodes"]
    each = found.select(*kept, F.explode("__nodes").alias("n"))
    return each.select(*kept, *(F.col(f"n.{c}") for c in ("pre", "post", "parent", "depth", "tag", "id", "classes", "attrs", "own_text")))


def flatten_json(c: Column) -> Column:
    """MAP<STRING, STRING> of a JSON text's dotted keys; null where it is not JSON."""
    def one(text):
        try:
            return {k: read._js_text(v) for k, v in read.flatten(json.loads(text)).items()} if text is not None else None
        except ValueError:
            return None

    @F.pandas_udf("map<string,string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return run(c)


def detect_tables(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """A row for each candidate record set of a page, best first: rank, selector, count, matched, score and fields (JSON text)."""
    from rowloom.html.detect import detect

    def build(document, _):
        found = detect(document)["candidates"]
        return [{"rank": i + 1, "selector": c["selector"], "count": c["count"], "matched": c["matched"], "score": c["score"], "fields": json.dumps(c["fields"], ensure_ascii=False)} for i, c in enumerate(found)]

    arrow = pa.list_(pa.struct([("rank", pa.int32()), ("selector", pa.string()), ("count", pa.int32()), ("matched", pa.int32()), ("score", pa.int32()), ("fields", pa.string())]))
    found = _per_page(pages, build, "__sets", arrow, "array<struct<rank:int,selector:string,count:int,matched:int,score:int,fields:string>>", url, html)
    kept = [c for c in found.columns if c != "__sets"]
    return found.select(*kept, F.explode("__sets").alias("s")).select(*kept, "s.*")


def auto_extract(pages: DataFrame, fields: list[str] | None = None, threshold: int = 70, model_col: str | None = None, url: str = "url", html: str = "html", loops: list | None = None) -> DataFrame:
    """One row a page (in loops, a record): the fields, then _confidence, _extractionMethod, _provenance, _needs_model and _warnings.

    Without fields, the default product fields; with fields, the page's JSON-LD answers first, then its meta tags, then
    product heuristics. model_col names a column with a model's JSON answers: a value of it that the page's text bears
    out fills empty fields and replaces less certain ones; others are dropped.
    """
    from rowloom.functions import grounding as G
    from rowloom.functions import text_schema as TS
    from rowloom.functions.similarity import DEFAULT_FIELDS, PRODUCT_WEIGHTS
    from rowloom.html import autoextract as A

    names = list(fields or DEFAULT_FIELDS)

    def build(document, base, answer=None):
        record = A.merged(A.structured(document), A.heuristics(document, base))
        result, sure, source = record["result"], record["confidence"], record["from"]
        if fields:
            node, node_keys = TS.map_node(A.richest_node(document), names)
            tags, tag_keys = TS.map_node(A.meta_node(document), names)
            picked = {}
            for f in names:
                if f in node:
                    picked[f] = (node[f], 95, f"json-ld:{node_keys[f]}")
                elif f in tags:
                    picked[f] = (tags[f], 85, f"meta:{tag_keys[f]}")
                elif result.get(f) not in (None, "", []):
                    picked[f] = (result[f], sure.get(f, 50), "heuristic")
                else:
                    picked[f] = (None, 0, "none")
            result, sure, source = ({f: p[k] for f, p in picked.items()} for k in range(3))
        text = lambda v: None if v in (None, "", []) else ", ".join(map(str, v)) if isinstance(v, list) else str(v)
        return {
            "cells": [{"value": text(result[f]), "confidence": int(sure[f]), "source": source[f]} for f in names],
            "method": ("structured+heuristic" if any(result[f] is not None for f in names) else "none") if fields else record["method"],
            "warnings": record["warnings"], "text": A.simplified_text(document),
            "said": [{"value": v, "confidence": c} for v, c in A.model_cells(answer, names, bool(fields))],
        }

    cell = pa.struct([("value", pa.string()), ("confidence", pa.int32()), ("source", pa.string())])
    said = pa.struct([("value", pa.string()), ("confidence", pa.int32())])
    arrow = pa.struct([("cells", pa.list_(cell)), ("method", pa.string()), ("warnings", pa.list_(pa.string())), ("text", pa.string()), ("said", pa.list_(said))])
    kind = "struct<cells:array<struct<value:string,confidence:int,source:string>>,method:string,warnings:array<string>,text:string,said:array<struct<value:string,confidence:int>>>"
    found = _in_records(pages, build, "__auto", arrow, kind, url, html, loops, model_col)
    kept = [c for c in found.columns if c not in ("__auto", model_col, *names, "_confidence", "_extractionMethod", "_provenance", "_needs_model", "_warnings")]
    auto = F.col("__auto")
    cells = {f: auto["cells"][i] for i, f in enumerate(names)}
    weights = dict.fromkeys(names, 1) if fields else PRODUCT_WEIGHTS
    how: dict[str, Column] = {f: F.lit(None).cast("string") for f in names}
    value = {f: c["value"] for f, c in cells.items()}
    sure = {f: c["confidence"] for f, c in cells.items()}
    source = {f: c["source"] for f, c in cells.items()}
    method = auto["method"]
    if model_col:
        # Each step is a projection of its own, as these expressions are large and used several times.
        found = found.withColumn("__corpus", G.corpus(auto["text"]))
        found = found.withColumns({f"__said{i}": auto["said"][i]["value"] for i in range(len(names))})
        found = found.withColumns({f"__how{i}": F.when(F.col(f"__said{i}").isNotNull(), G.ground(F.col(f"__said{i}"), F.col("__corpus"))) for i in range(len(names))})
        better = lambda i, f: F.coalesce(F.col(f"__said{i}").isNotNull() & (F.col(f"__how{i}") != "missing") & (cells[f]["value"].isNull() | (cells[f]["confidence"] < auto["said"][i]["confidence"])), F.lit(False))
        found = found.withColumns({f"__use{i}": better(i, f) for i, f in enumerate(names)})
        used = F.lit(False)
        for i, f in enumerate(names):
            use = F.col(f"__use{i}")
            how[f] = F.col(f"__how{i}")
            value[f] = F.when(use, F.col(f"__said{i}")).otherwise(cells[f]["value"])
            sure[f] = F.when(use, auto["said"][i]["confidence"]).otherwise(cells[f]["confidence"])
            source[f] = F.when(use, "llm").otherwise(cells[f]["source"])
            used = used | use
        method = F.when(used, "llm").otherwise(method)
    records = F.array(*(G.provenance(f, value[f], sure[f], source[f], how[f]) for f in names))
    confidence = G.weighted_confidence({f: sure[f] for f in names if f in weights}, weights)
    empty = F.lit(False)
    for f in names if fields else []:
        empty = empty | value[f].isNull()
    return found.select(*kept, *(value[f].alias(f) for f in names), confidence.alias("_confidence"), method.alias("_extractionMethod"), G.provenance_column(records).alias("_provenance"), ((confidence < threshold) | empty).alias("_needs_model"), auto["warnings"].alias("_warnings"))
