"""From a recipe to one lazy plan over tables of pages, responses, captures and files.

Rows that steps collect are unioned under all their columns. What a step cannot do over data is refused by name when
the plan is made, never skipped.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.functions import predicates as P
from rowloom.functions import transforms as T
from rowloom.functions.js import text_of
from rowloom.functions.similarity import parse_schema
from rowloom.html import read
from rowloom.html.select import scoped
from rowloom.operators import dedupe as D
from rowloom.plans import context as X
from rowloom.plans import templates
from rowloom.plans.recipe import Recipe, Step, read_recipe, unrunnable, walk
from rowloom.plans.steps import LOOP_CAP, default_config
from rowloom.session import cut_lineage, discard
from rowloom.sinks import render as sink
from rowloom.sources import api, pages, pdf


class RecipeError(ValueError):
    """A recipe that no plan can be made of."""


@dataclass
class Sources:
    """The tables a run reads: pages(url, html), responses(run, seq, body, status, link), captures(url, method, type),
    files(path, content), and seen(key): the keys that earlier runs of the recipe on this site gave back. lists: tables that
    a LOOP over a list takes its items from, by name, of any length: index0, their number from 0, and what the items hold."""

    pages: DataFrame | None = None
    responses: DataFrame | None = None
    captures: DataFrame | None = None
    files: DataFrame | None = None
    seen: DataFrame | None = None
    context: dict = field(default_factory=dict)
    lists: dict[str, DataFrame] = field(default_factory=dict)


#: Steps whose configuration may hold templates of loop items and of earlier results; its other texts are the same for all rows.
ROW_STEPS = ("WEBSITE", "NAVIGATE", "EXTRACT", "PAGE_DATA", "PAGE_JSON", "ASSERT", "IF_ELSE", "DOWNLOAD_FILE", "API")


@dataclass
class Result:
    """seen: where a DEDUPE remembers for ever, the keys to give to the next run. notes: what the plan leaves out, and
    why. upto: the rows that the first n collecting steps have given, as an export in the middle of a recipe sees them."""

    rows: DataFrame | None
    exports: list[dict]
    seen: DataFrame | None = None
    notes: list[str] = field(default_factory=list)
    upto: Callable[..., DataFrame | None] = lambda n, placed=False: None
    collected: Callable[[], DataFrame | None] = lambda: None


class Collected:
    """What becomes of the rows of top-level steps as a recipe is compiled; this one leaves them as plans."""

    stopped_at: int | None = None

    def before(self, step: int) -> bool:
        """Whether to go on with the step of this number."""
        return True

    def after(self, step: int, frames: list[DataFrame]) -> list[DataFrame]:
        """The rows that a step has collected, in the form that later ones and the result use."""
        return frames


class _Compiler:
    """Frames carry what loops and earlier steps bind (rowloom.plans.context): page is the frame of the pages that are open,
    scope that of the iterations that are under way, where no page of theirs need be open; scalars are results that are the
    same for all rows. wanted: the names that templates of the recipe begin with; what none asks for is not bound."""

    def __init__(self, spark: SparkSession, sources: Sources, wanted: frozenset[str] = frozenset()):
        self.spark, self.sources, self.wanted = spark, sources, wanted
        self.page = sources.pages
        self.scope: DataFrame | None = None
        self.scalars: dict[str, Column] = {}
        self.responses: dict[str, DataFrame] = {}
        self.named: set[str] = set()
        self.collected: list[DataFrame] = []
        self.gates: list[tuple[int, dict]] = []
        self.exports: list[dict] = []
        self.stops: list[tuple[int, int, int]] = []
        self.seen: DataFrame | None = None
        self.on_fail: list[str] = ["stop"]
        self.loop: list[tuple[str, int]] = []
        self.notes: list[str] = []

    # -- pieces --

    def pages_for(self, step: Step) -> DataFrame:
        if self.page is None:
            raise RecipeError(f"{step.type} ({step.id}) needs a table of pages.")
        return self.page

    def bound(self) -> set[str]:
        """The first names of templates that rows answer, or results of earlier steps."""
        columns = {c for f in (self.page, self.scope) if f is not None for c in f.columns}
        of = {X.ITEM: {"item"}, X.LOOP: {"loop"}, X.EXTRACTED: {"extracted"}, X.STORED: self.named}
        return set().union(set(self.scalars), *(names for c, names in of.items() if c in columns))

    def config(self, step: Step) -> dict:
        """A step's configuration with the templates that the run's context answers; those that rows answer stay as they are."""
        bound = self.bound()
        config = templates.render({**default_config(step.type), **step.config}, self.sources.context, bound)
        if step.type not in ROW_STEPS and step.type != "LOOP" and (left := X.heads(config) & bound):
            raise RecipeError(f"{step.type} ({step.id}): {{{{{min(left)}}}}} differs from row to row, and this step is the same for all.")
        return config

    def fixed(self, step: Step, c: dict, *names: str) -> None:
        """These parts of a configuration must be the same for all rows."""
        for name in names:
            if left := X.heads(c.get(name)) & self.bound():
                raise RecipeError(f"{step.type} ({step.id}): {name} has {{{{{min(left)}}}}}, which differs from row to row.")

    def filled(self, step: Step, config: dict) -> tuple[DataFrame, dict]:
        """The frame of open pages with the texts that its rows have for a configuration's templates, and marks in their stead."""
        return X.filled(self.pages_for(step), config, self.sources.context, self.scalars)

    def text(self, df: DataFrame, template: object) -> object:
        """A configuration's text: as it is, or a column where rows answer its templates."""
        return X.column(df, template, self.sources.context, self.scalars) if isinstance(template, str) and "{{" in template else template

    def collect(self, rows: DataFrame, step: Step) -> None:
        placed = rows.withColumn(X.AT, X.at(rows, len(self.collected)))
        self.collected.append(X.without_bindings(placed).withColumn("_step", F.lit(step.id)))

    def run(self, steps: list[Step]) -> None:
        for step in steps:
            handler: Callable[[Step, dict], None] | None = getattr(self, f"do_{step.type.lower()}", None)
            if handler is None:
                raise RecipeError(f"{step.type} ({step.id}) has no plan.")
            config = self.config(step)
            before = self.page, self.loop, self.scope, len(self.collected), len(self.gates), len(self.exports), len(self.stops)
            try:
                handler(step, config)
            except RecipeError:
                if not config.get("optional"):
                    raise
                self.page, self.loop, self.scope = before[:3]
                for made, n in zip((self.collected, self.gates, self.exports, self.stops), before[3:], strict=True):
                    del made[n:]

    # -- results of steps --

    def store(self, frame: DataFrame, name: object, default: str, found: Column) -> DataFrame:
        """The frame with a result, a JSON text, under its name, if any template asks for it."""
        name = str(name or default).strip() or default
        if name not in self.wanted:
            return frame
        self.named.add(name)
        old = F.col(X.STORED) if X.STORED in frame.columns else F.create_map().cast("map<string,string>")
        return frame.withColumn(X.STORED, X.merged(old, F.create_map(F.lit(name), found)))

    def keep_last(self, frame: DataFrame, values: Column) -> DataFrame:
        """The frame with the values (a map, null where a page gives no row) of a step's last row under their names."""
        old = F.col(X.EXTRACTED) if X.EXTRACTED in frame.columns else F.create_map().cast("map<string,string>")
        return frame.withColumn(X.EXTRACTED, F.when(values.isNull(), old).otherwise(X.merged(old, values)))

    def carried(self, url: str) -> DataFrame | None:
        """The bindings that a step which opens a page hands on to it. An address made of a page's own results is opened for
        each page; any other once an iteration, or once, with the results of the last page. None: there are no bindings."""
        results = [c for c in (X.EXTRACTED, X.STORED) if self.page is not None and c in self.page.columns]
        if not results:
            return self.scope
        kept = [c for c in X.BINDINGS if c in self.page.columns]
        if X.heads(url) & ({"extracted"} | self.named):
            return self.page.select(*kept)
        places = F.struct(*_order(self.page))
        keys = [X.AT] if X.AT in kept else []
        last = F.max_by(F.struct(*(c for c in kept if c not in keys)), places).alias("__last")
        done = self.page.groupBy(*keys).agg(last)
        return done.where("__last IS NOT NULL").select(*keys, "__last.*")

    # -- navigation --

    def do_website(self, step: Step, c: dict) -> None:
        url = str(c.get("url") or "").strip()
        if self.sources.pages is None:
            raise RecipeError(f"{step.type} ({step.id}) needs a table of pages.")
        named = url not in ("", "https://", "http://")
        carried, self.loop = self.carried(url), []
        if carried is None and "{{" not in url:
            self.page = self.sources.pages.where(F.col("url") == url) if named else self.sources.pages
            return
        if not named:
            raise RecipeError(f"{step.type} ({step.id}) needs an address where items or results are in use.")
        frame = self.spark.range(1).drop("id") if carried is None else carried
        wanted = frame.withColumn("__url", F.trim(self.text(frame, url) if "{{" in url else F.lit(url)))
        pages_ = self.sources.pages.drop(*X.BINDINGS, pages.SCOPE)
        self.page = pages_.join(wanted, pages_["url"] == wanted["__url"]).drop("__url")

    do_navigate = do_website

    def do_wait(self, step: Step, c: dict) -> None:
        """Recorded pages do not change while one waits."""

    def do_paginate(self, step: Step, c: dict) -> None:
        """The pages here, and those that the first link found by the selector leads to, one after the other."""
        self.page = self.followed(step, c, int(c.get("maxPages") or c.get("max") or api.DEFAULT_PAGES))

    def followed(self, step: Step, c: dict, most: int) -> DataFrame:
        """Pages with _page, the number of links followed to them, until no page is new or `most` pages deep."""
        selector = str(c.get("selector") or "").strip()
        if not selector:
            raise RecipeError(f"{step.type} ({step.id}) needs the selector of the link to the next page.")
        here = self.pages_for(step)
        if c.get("type") == "paginate-links":
            links = pages.follow(here, selector).select(F.col("next").alias("url"), (F.col("place") + 1).cast("long").alias("_page"))
            numbered = here.select("url", F.lit(0).cast("long").alias("_page")).unionByName(links)
            numbered = numbered.groupBy("url").agg(F.min("_page").alias("_page")).where(F.col("_page") < most)
            return self.sources.pages.join(numbered, "url")
        links = pages.follow(self.sources.pages, selector).where("place = 0").select("url", "next")
        kept = [c for c in X.BINDINGS if c in here.columns]
        start = here.select(*([X.AT] if kept else []), "url")
        reached = follow_links(start, links, min(most, LOOP_CAP), keys=[X.AT] if X.AT in kept else [])
        found = self.sources.pages.drop(*X.BINDINGS).join(reached, "url")
        return found.join(self.carried("").select(*kept), X.AT) if X.AT in kept else found

    # -- extraction --

    def do_extract(self, step: Step, c: dict) -> None:
        for spec in c.get("fields") or c.get("schema") or []:
            self.fixed(step, spec, "name", "transform", "regexPattern", "regexFlags", "regexGroup")
        frame, marked = self.filled(step, {"fields": c.get("fields") or c.get("schema") or []})
        specs = marked["fields"]
        chains = {s.get("name") or "data": {"transform": s.get("transform") if isinstance(s.get("transform"), list) else [s["transform"]], "pattern": s.get("regexPattern", ""), "flags": s.get("regexFlags", ""), "group": s.get("regexGroup"), "base": F.col("url")} for s in specs if s.get("transform")}
        self.collect(T.transform_rows(pages.extract(frame, specs, loop=self.loop), chains), step)
        if specs and "extracted" in self.wanted:
            names = {(s.get("name") or "data"): f"__x{i}" for i, s in enumerate(specs)}
            last = pages.last_values(frame, specs, self.loop)
            cells = last.withColumns({f"__x{i}": F.get("_last", F.lit(i)) for i in range(len(specs))})
            cells = T.transform_rows(cells, {names[k]: v for k, v in chains.items()})
            text = lambda x: text_of(F.col(x), cells.schema[x].dataType.simpleString())
            values = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*map(text, names.values())))
            self.page = self.keep_last(cells, F.when(F.col("_last").isNotNull(), values)).drop("_last", pages.FILLED, *(f"__x{i}" for i in range(len(specs))))

    def do_page_data(self, step: Step, c: dict) -> None:
        self.fixed(step, c, "source", "storeAs")
        frame, marked = self.filled(step, {"type": c.get("type") or ""})
        read_data = lambda f, loops: pages.page_data(f, c["source"], marked["type"], bool(c.get("flatten")), loops=loops)
        found = read_data(frame, self.loop).drop(pages.FILLED)
        self.collect(found.select(*(x for x in found.columns if x not in ("data", "_line")), F.posexplode("data.records").alias("_line", "record")), step)
        if self.wanted & {"extracted", str(c.get("storeAs") or "pageData").strip()}:
            whole = read_data(frame.withColumn("__html", F.col("html")), []).withColumnRenamed("__html", "html").drop(pages.FILLED)
            data = F.col("data")
            told = F.concat(F.regexp_replace(F.to_json(data.dropFields("records")), r"\}$", ',"records":['), F.array_join(data["records"], ","), F.lit("]}"))
            whole = self.store(whole, c.get("storeAs"), "pageData", told)
            if "extracted" in self.wanted:
                whole = self.keep_last(whole, F.from_json(F.try_element_at(data["records"], F.lit(-1)), "map<string,string>"))
            self.page = whole.drop("data")

    def do_page_json(self, step: Step, c: dict) -> None:
        self.fixed(step, c, "mode", "storeAs")
        frame, marked = self.filled(step, {"selector": c.get("selector") or ""})
        read_page = lambda f, loops: pages.page_json(f, c["mode"], selector=marked["selector"], scripts=bool(c.get("includeScripts")), loops=loops)
        found = read_page(frame, self.loop).drop(pages.FILLED)
        value = {"tree": F.array(F.col("page.tree")), "text": F.col("page.text"), "flat": F.transform("page.rows", lambda x: F.to_json(x))}[c["mode"]]
        self.collect(found.select(*(x for x in found.columns if x not in ("page", "_line")), F.posexplode(value).alias("_line", "record")), step)
        if str(c.get("storeAs") or "pageJson").strip() in self.wanted:
            whole = read_page(frame.withColumn("__html", F.col("html")), []).withColumnRenamed("__html", "html").drop(pages.FILLED)
            page = F.col("page")
            told = F.concat(F.regexp_replace(F.to_json(page.dropFields("tree")), r"\}$", ',"tree":'), F.coalesce(page["tree"], F.lit("null")), F.lit("}"))
            self.page = self.store(whole, c.get("storeAs"), "pageJson", told).drop("page")

    def do_auto_extract(self, step: Step, c: dict) -> None:
        fields, is_default, _ = parse_schema(c.get("schema") or c.get("fields") or "")
        read_auto = lambda f, loops: pages.auto_extract(f, None if is_default else fields, int(c.get("threshold") or 70), loops=loops)
        self.collect(read_auto(self.pages_for(step), self.loop), step)
        if "extracted" in self.wanted:
            whole = read_auto(self.pages_for(step).withColumn("__html", F.col("html")), []).withColumnRenamed("__html", "html")
            names = [x for x in whole.columns if x not in self.pages_for(step).columns]
            values = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"`{x}`").cast("string") for x in names)))
            self.page = self.keep_last(whole, values).drop(*names)

    def do_pdf_extraction(self, step: Step, c: dict) -> None:
        if self.sources.files is None:
            raise RecipeError(f"{step.type} ({step.id}) needs a table of files.")
        done = pdf.extract_pdf(self.sources.files, max_pages=int(c.get("maxPages") or pdf.MAX_PAGES))
        each = done.select("path", F.explode("pages").alias("p")).select("path", "p.page", "p.text", "p.items")
        self.collect(pdf.tables(each.select("path", "page", "items"), has_header=bool(c.get("hasHeader", True))) if c.get("mode") == "tables" else each.select("path", "page", "text"), step)

    def do_api(self, step: Step, c: dict) -> None:
        if self.sources.responses is None:
            raise RecipeError(f"{step.type} ({step.id}) needs a table of recorded responses.")
        p = c.get("pagination") or {}
        kept = api.recorded_pages(self.sources.responses, p.get("mode") or "none", c.get("rowsPath") or "", p.get("cursorPath") or "", p.get("maxPages"))
        rows = api.rows_at(kept, "body", c.get("rowsPath") or "").drop("status", "link", "stop_reason")
        self.collect(rows, step)
        json_body = F.when(F.try_parse_json("body").isNotNull(), F.col("body")).otherwise(F.regexp_extract(F.to_json(F.struct("body")), r'(?s)^\{"body":(.*)\}$', 1))
        told = F.concat(F.lit('{"status":'), F.coalesce(F.col("status").cast("string"), F.lit("null")), F.lit(',"body":'), F.coalesce(json_body, F.lit("null")), F.lit("}"))
        last = kept.agg(F.max_by(told, F.struct("run", "seq")).alias("told"))
        for name in {str(c.get("storeAs") or "api").strip() or "api", "api"}:
            self.responses[name] = rows
            if name in self.wanted:
                self.scalars[name] = last.scalar()
        if c.get("exposeBodyAsExtracted") is True and "extracted" in self.wanted:
            self.scalars["extracted"] = F.get_json_object(last.scalar(), "$.body")

    def do_api_sniffer(self, step: Step, c: dict) -> None:
        if self.sources.captures is None:
            raise RecipeError(f"{step.type} ({step.id}) needs a table of captures.")
        if c.get("enabled"):
            keep = P.capture_filter(F.col("url"), F.col("method"), c.get("urlFilter") or "", c.get("methods") or "") & ~P.capture_noise(F.col("url"), F.col("type"))
            self.collect(self.sources.captures.where(keep), step)

    def do_download_file(self, step: Step, c: dict) -> None:
        """A manifest: which files would be fetched, and under what names."""
        frame, marked = self.filled(step, {"selector": c.get("selector") or "", "attribute": c.get("attribute") or ""})
        loops = list(self.loop)

        def links(document, base, scope=None, filled=None):
            selector, attribute = (X.fill(marked[k], filled) for k in ("selector", "attribute"))
            parts = [scoped(document, selector, record) for _, record in pages.records(document, loops, scope)] if loops else [scoped(document, selector)]
            found = [n.attrs.get(attribute) if attribute else n.attrs.get("href") or n.attrs.get("src") for part in parts for n in part]
            return [T.absolute_url(u, base) for u in found if u]

        import pyarrow as pa

        found = pages._per_page(frame, links, "__links", pa.list_(pa.string()), "array<string>", "url", "html", pages.SCOPE)
        found = found.select(*([c for c in X.BINDINGS if c in found.columns]), F.col("url").alias("page_url"), F.posexplode("__links").alias("__i", "url"))
        each = found.where(F.rlike("url", F.lit("(?i)^(https?|data):"))).withColumn("index", F.col("__i") + 1).drop("__i")
        names = templates.render(str(step.config.get("filename") or "{{file.name}}"), self.sources.context, self.bound() | {"file"})
        self.collect(file_manifest(each, names, lambda df, t: X.column(df, t, {}, self.scalars)), step)

    # -- control --

    def do_loop(self, step: Step, c: dict) -> None:
        kind, outer = c.get("type") or "elements", (self.page, self.loop, self.scope)
        self.fixed(step, c, *c)
        body = step.children or []
        self.on_fail.append(c.get("onFail") or "skip")
        if kind == "elements":
            if not c.get("selector"):
                raise RecipeError(f"LOOP ({step.id}) over elements needs a selector.")
            self.loop = [*self.loop, (c["selector"], max(0, int(c.get("max") or 0)))]
            if _binds_records(body):
                bound = pages.bind_records(self.pages_for(step), self.loop)
                self.page = X.counted(bound, F.col("__item"), F.col("__i"), F.col("__n"), len(self.collected), F.col("__place")).drop("__item", "__i", "__n", "__place")
                self.scope = self.page.select(*(x for x in X.BINDINGS if x in self.page.columns))
            self.run(body)
        elif kind in ("paginate", "paginate-links"):
            self.page = self.followed(step, c, int(c.get("max") or c.get("maxPages") or api.DEFAULT_PAGES))
            self.run(body)
        elif kind == "paginate-url":
            self.numbered_pages(step, c)
        elif kind in ("count", "list"):
            self.iterate(step, c, kind)
            self.run(body)
        else:
            raise RecipeError(f"LOOP ({step.id}) has no type {kind}.")
        self.on_fail.pop()
        self.page, self.loop, self.scope = outer

    def iterate(self, step: Step, c: dict, kind: str) -> None:
        """Bind the items of a list, or numbers, to the frames: one plan for the loop's body, a row an iteration."""
        number, most = len(self.collected), max(0, int(c.get("max") or 0))
        if kind == "count":
            n = int(c.get("count") or c.get("max") or 0)
            if n < 1:
                raise RecipeError(f"LOOP ({step.id}) needs a count of at least 1.")
            self.capped(step, n)
            blank = F.create_map(*(F.lit(x) for k in ("text", "href", "src", "value") for x in (k, "")))
            numbers = F.transform(F.sequence(F.lit(0), F.lit(min(n, LOOP_CAP) - 1)), lambda i: F.map_concat(blank, F.create_map(F.lit("index"), (i + 1).cast("string"), F.lit("index0"), i.cast("string"))))
            return self.deal(numbers, number)
        if c.get("source") == "context":
            path = str(c.get("contextPath") or "").strip()
            head, *rest = X.keys(path)
            table = self.sources.lists.get(head) if not rest else _response_items(self.responses[head]) if rest == ["rows"] and head in self.responses else None
            if table is not None:
                return self.bind_table(table if not most else table.where(F.col("index0") < most), number)
            if head in self.bound():
                cut = lambda items: F.slice(items, F.lit(1), F.lit(most)) if most else items
                return self.deal(cut(X.items_in_json(F.col("__json"))), number, path)
            found = templates.resolve_path(self.sources.context, path)
            if found is templates.MISSING or not isinstance(found, list | dict):
                self.notes.append(f'LOOP ({step.id}): "{path}" is no list that this run has, and its body has no rows')
            given = found if isinstance(found, list) else [found] if isinstance(found, dict) else []
        elif isinstance(c.get("items"), list):
            given = c["items"]
        else:
            given = list_lines(str(c.get("lines") or c.get("list") or ""), str(c.get("delimiter") or ""), c.get("hasHeader") is True)
        self.capped(step, len(given))
        self.deal(X.items_of(given[: min(most or LOOP_CAP, LOOP_CAP)]), number)

    def deal(self, items: Column, number: int, path: str | None = None) -> None:
        """A row for each item, in all frames. path: what the column __json, that items are made of, has the value of."""
        dealt = lambda df: X.iterate(df if path is None else df.withColumn("__json", X.value(df, path, self.sources.context, self.scalars)), items, number).drop("__json")
        whole = self.page if self.page is not None and self.scope is None and set(X.BINDINGS) & set(self.page.columns) else self.scope
        base = self.spark.range(1).drop("id") if whole is None else whole.select(*(x for x in X.BINDINGS if x in whole.columns))
        self.scope = dealt(base)
        self.page = self.page if self.page is None else dealt(self.page)

    def bind_table(self, table: DataFrame, number: int) -> None:
        """Items that are rows of a table: the body must begin by opening a page for each."""
        if self.scope is not None:
            raise RecipeError("A list that is a table cannot be looped over within another loop.")
        held = [F.col(f"`{x}`") for x in table.columns if x not in ("index0", "cols")]
        pairs = [x for c in held for x in (F.lit(table.select(c).columns[0]), text_of(c, table.select(c).schema[0].dataType.simpleString()))]
        own = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
        own = X.merged(own, F.col("cols")) if "cols" in table.columns else own
        item = X.merged(F.create_map(F.lit("index"), (F.col("index0") + 1).cast("string"), F.lit("index0"), F.col("index0").cast("string")), own)
        count = table.agg(F.count(F.lit(1))).scalar()
        self.scope = X.counted(table.select("index0", item.alias("__item")), F.col("__item"), F.col("index0"), count, number).drop("__item", "index0")
        self.page = None

    def numbered_pages(self, step: Step, c: dict) -> None:
        """Pages by a numbered address, up to the first without new rows."""
        first, by = (int(c.get(a) or c.get(b) or 1) for a, b in (("start", "startPage"), ("step", "pageStep")))
        if by == 0 or c.get("step") == 0:
            raise RecipeError(f"LOOP ({step.id}): a step of 0 never ends.")
        self.capped(step, int(c.get("max") or 10))
        n, template = min(int(c.get("max") or 10), LOOP_CAP), str(c.get("url") or c.get("urlTemplate") or "")
        wanted = self.spark.range(n).select(F.col("id").alias("_page"), F.replace(F.lit(template), F.lit("{page}"), (first + F.col("id") * by).cast("string")).alias("url"))
        if self.scope is not None:
            raise RecipeError(f"LOOP ({step.id}): numbered pages within a loop over items are not supported; open them by a template.")
        self.page = self.sources.pages.join(F.broadcast(wanted), "url") if self.sources.pages is not None else None
        start, self.loop = len(self.collected), []
        self.run(step.children or [])
        if c.get("stopWhenEmpty") is not False and len(self.collected) > start:
            if any("_page" not in df.columns for df in self.collected[start:]):
                raise RecipeError(f"LOOP ({step.id}): rows that do not tell their page cannot stop it; set stopWhenEmpty to false.")
            self.stops.append((start, len(self.collected), n))

    def capped(self, step: Step, n: int) -> None:
        if n > LOOP_CAP:
            self.notes.append(f"LOOP ({step.id}): {n - LOOP_CAP} of {n} items are beyond the {LOOP_CAP} that a loop takes")

    def do_if_else(self, step: Step, c: dict) -> None:
        """Each page (in a loop, each record) takes one branch; a condition that cannot be evaluated sends it to the other."""
        self.fixed(step, c, "condition")
        seen = self._observed(step, c)
        value = self.text(seen, c.get("value", ""))
        if isinstance(value, Column) and c["condition"] == "text-matches":
            raise RecipeError(f"IF_ELSE ({step.id}): a pattern must be the same for all rows.")
        against = {"other": P.observed(value, F.lit(True), value), "compare_attr": c["condition"].startswith("attr-")} if isinstance(value, Column) else {"value": value}
        holds = lambda x: P.condition(c["condition"], P.observed(x["text"], x["count"] > 0, x["attr"]), **against)
        outer = self.page, self.loop
        for branch, test in ((step.ifBranch, holds), (step.elseBranch, lambda x: ~holds(x))):
            self.page = self._scoped(seen, test) if self.loop else seen.where(test(F.col("__seen"))).drop("__seen")
            self.run(branch or [])
            self.page, self.loop = outer

    def do_assert(self, step: Step, c: dict) -> None:
        """A page or record on which the assertion fails stops the run with its message; an optional one only warns, and
        in a loop, unless its onFail is stop, the record takes no part in what follows."""
        if c.get("optional"):
            return
        self.fixed(step, c, "assertion")
        seen = self._observed(step, c)
        selector, count, value = (self.text(seen, c.get(k, "")) for k in ("selector", "count", "value"))
        fails = lambda x: P.assertion(c["assertion"], x["count"], x["text"], selector if selector is not None else "", count, value)
        if self.loop:
            if self.on_fail[-1] != "skip":
                first = F.element_at(F.filter(F.transform("__seen", fails), lambda m: m.isNotNull()), 1)
                none = ~F.exists("__seen", lambda x: fails(x).isNotNull())
                seen = seen.where(F.when(none, F.lit(True)).otherwise(F.raise_error(first).cast("boolean")))
            self.page = self._scoped(seen, lambda x: fails(x).isNull())
            return
        message = fails(F.col("__seen"))
        stops = F.lit(False) if self.on_fail[-1] == "skip" else F.raise_error(message).cast("boolean")
        self.page = seen.where(F.when(message.isNull(), F.lit(True)).otherwise(stops)).drop("__seen")

    def _observed(self, step: Step, c: dict) -> DataFrame:
        import pyarrow as pa

        frame, marked = self.filled(step, {"selector": c.get("selector") or "", "attribute": c.get("attr") or c.get("attribute") or ""})

        def look(document, base, filled=None):
            selector, attribute = (X.fill(marked[k], filled) for k in ("selector", "attribute"))
            return seen(scoped(document, selector), attribute.lower())

        def seen(found, attribute):
            first = found[0] if found else None
            return {"count": len(found), "text": read.clean(first.text()) if first else None, "attr": first.attrs.get(attribute) if first else None}

        loops = list(self.loop)

        def look_at_each(document, base, scope=None, filled=None):
            selector, attribute = (X.fill(marked[k], filled) for k in ("selector", "attribute"))
            return [seen(scoped(document, selector, record), attribute.lower()) | {"place": place} for place, record in pages.records(document, loops, scope)]

        whole = frame.withColumn("__html", F.col("html"))
        kind, shape = pa.struct([("count", pa.int64()), ("text", pa.string()), ("attr", pa.string())]), "count:bigint,text:string,attr:string"
        if loops:
            each = pa.list_(pa.struct([*kind, pa.field("place", pa.string())]))
            return pages._per_page(whole, look_at_each, "__seen", each, f"array<struct<{shape},place:string>>", "url", "html", pages.SCOPE).withColumnRenamed("__html", "html").drop(pages.FILLED)
        return pages._per_page(whole, look, "__seen", kind, f"struct<{shape}>", "url", "html").withColumnRenamed("__html", "html").drop(pages.FILLED)

    def _scoped(self, seen: DataFrame, test: Callable[[Column], Column]) -> DataFrame:
        """The pages with only those records in scope that pass."""
        return seen.withColumn(pages.SCOPE, F.transform(F.filter("__seen", test), lambda x: x["place"])).drop("__seen")

    # -- rows --

    def do_dedupe(self, step: Step, c: dict) -> None:
        self.gates.append((len(self.collected), c))

    def do_export(self, step: Step, c: dict) -> None:
        sink.format_meta(c["format"])
        if c.get("append") and c["format"] not in sink.APPENDABLE:
            raise RecipeError(f"EXPORT ({step.id}): {c['format']} cannot be appended to; use one of {', '.join(sink.APPENDABLE)}.")
        self.exports.append({"format": c["format"], "filename": c.get("filename") or sink.default_filename(c["format"]), "upto": len(self.collected), "append": bool(c.get("append")), "dataset": c.get("dataset") or c.get("filename") or ""})

    def everything(self) -> DataFrame | None:
        """All rows that steps have collected, before any gate."""
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), self.collected) if self.collected else None

    def rows(self, upto: int | None = None, placed: bool = False) -> DataFrame | None:
        """All rows past the deduplication gates: only rows collected after a gate pass through it. placed: with _seq, the
        place of each row in the run, by which they are in order."""
        if not self.collected[:upto]:
            return None
        if upto is not None:
            whole = self.collected, self.gates, self.stops
            self.collected, self.gates, self.stops = self.collected[:upto], [g for g in self.gates if g[0] < upto], [s for s in self.stops if s[1] <= upto]
            try:
                return self.rows(placed=placed)
            finally:
                self.collected, self.gates, self.stops = whole
        ordered = [df.withColumn("_seq", F.concat_ws("\x01", X.AT, *_order(df))).withColumn("_batch", F.lit(i)) for i, df in enumerate(self.collected)]
        out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ordered)
        for start, end, n in self.stops:
            kept = self._gated(out.where(F.col("_batch") < end)).where(F.col("_batch") >= start).groupBy("_page").agg(F.count(F.lit(1)).alias("kept"))
            # What the run had before the loop stands before its first page.
            had = self._gated(out.where(F.col("_batch") < start)).agg(F.count(F.lit(1)).alias("kept")).select(F.lit(-1).cast("long").alias("_page"), "kept")
            counts = self.spark.range(n).withColumnRenamed("id", "_page").join(kept, "_page", "left").select("_page", F.coalesce("kept", F.lit(0)).alias("kept"))
            open_pages = paginate_until_empty(counts.unionByName(had), "_page", "kept").select("_page")
            inside = F.col("_batch").between(start, end - 1)
            out = out.where(~inside).unionByName(out.where(inside).join(F.broadcast(open_pages), "_page", "left_semi"))
        return self._gated(out, remember=True).drop(X.AT, "_batch", *([] if placed else ["_seq"]))

    def _gated(self, out: DataFrame, remember: bool = False) -> DataFrame:
        for start, config in self.gates:
            fields = D.parse_fields(config.get("fields") or "")
            names = fields or [x for x in out.columns if not x.startswith("_")]
            placed = out.withColumn("__order", F.col("_seq"))
            gated = D.first_rows(placed.where(F.col("_batch") >= start), "__order", names)
            if config.get("scope") == "forever":
                gated = gated.withColumn("__key", F.sha2(D.row_key(gated.drop("__order"), names), 256))
                if self.sources.seen is not None:
                    gated = gated.join(self.sources.seen.select(F.col("key").alias("__key")), "__key", "left_anti")
                if remember:
                    known = [x for x in (self.sources.seen, self.seen) if x is not None]
                    self.seen = reduce(DataFrame.unionByName, [x.select("key") for x in known], gated.select(F.col("__key").alias("key"))).distinct()
                gated = gated.drop("__key")
            out = placed.where(F.col("_batch") < start).unionByName(gated).drop("__order")
        return out


def _binds_records(body: list[Step]) -> bool:
    """Whether the body of a loop over elements names its items, or leaves the page: then each record is a row of the frame."""
    return any(s.type in ("WEBSITE", "NAVIGATE", "PAGINATE") or (s.type == "LOOP" and str(s.config.get("type") or "").startswith("paginate")) or X.heads(s.config) & {"item", "loop"} for s in walk(body))


def list_lines(text: str, delimiter: str = "", has_header: bool = False) -> list:
    """Items of pasted lines, blank ones left out: with a delimiter, each with its cells by the header's names (or col1, col2
    and so on), the first as its value, and the line as its text."""
    import csv

    lines = [x.strip() for x in text.splitlines() if x.strip()]
    if not delimiter or not lines:
        return lines
    cells = [[x.strip() for x in row] for row in (next(csv.reader([line], delimiter=delimiter[0])) for line in lines)]
    names = [x or f"col{i + 1}" for i, x in enumerate(cells[0])] if has_header else [f"col{i + 1}" for i in range(len(cells[0]))]
    start = 1 if has_header else 0
    rows = ({n: row[i] if i < len(row) else "" for i, n in enumerate(names)} for row in cells[start:])
    return [row | {"value": c[0] if c else "", "text": line} for row, c, line in zip(rows, cells[start:], lines[start:], strict=True)]


def _response_items(rows: DataFrame) -> DataFrame:
    """The rows of recorded responses as items, numbered through: responses are few, and are numbered by their sizes."""
    sizes = rows.groupBy("run", "seq").agg(F.count(F.lit(1)).alias("__n"))
    before = W.orderBy("run", "seq").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("run", "seq", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    numbered = rows.join(F.broadcast(starts), ["run", "seq"])
    values = F.when(F.rlike("row", F.lit(r"^\s*\{")), F.from_json("row", "map<string,string>"))
    return numbered.select((F.col("__start") + F.col("row_no")).alias("index0"), F.col("row").alias("text"), F.coalesce(values, F.create_map(F.lit("value"), F.col("row"))).alias("cols"))


def follow_links(start: DataFrame, links: DataFrame, most: int, keys: list[str] | None = None) -> DataFrame:
    """url and _page: the pages of start and those that next links (url, next; one a page) lead to, fewer than `most` links
    away, each at its least distance; keys: columns of start that tell runs apart, each with pages of its own.

    By doubling: after k rounds the table of jumps leads 2^k links on, and the pages reached are those fewer than 2^k links
    away, so that a chain of n pages takes about log2(n) rounds, each a join of slim tables. Rounds end when no page is new.
    """
    keys = keys or []
    least = lambda df: df.groupBy(*keys, "url").agg(F.min("_page").alias("_page"))
    reached = cut_lineage(least(start.select(*keys, "url", F.lit(0).cast("long").alias("_page"))), "followed")
    jumps, n, away = cut_lineage(links.select("url", "next").dropDuplicates(["url"]), "jumps"), reached.count(), 1
    while away < most:
        onward = reached.join(jumps, "url").select(*keys, F.col("next").alias("url"), (F.col("_page") + away).alias("_page"))
        more = cut_lineage(least(reached.unionByName(onward)), "followed")
        found = more.count()
        discard(reached)
        reached, away = more, 2 * away
        if found == n:
            break
        n = found
        if away < most:
            then = jumps.select(F.col("url").alias("next"), F.col("next").alias("__then"))
            longer = cut_lineage(jumps.join(then, "next").select("url", F.col("__then").alias("next")), "jumps")
            discard(jumps)
            jumps = longer
    discard(jumps)
    return reached.where(F.col("_page") < most)


def _order(df: DataFrame) -> list[Column]:
    """What rows of a step are ordered by: the page, then the record and row numbers, padded so that they sort as text."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    pad = lambda c: F.when(F.length(text(c)) < 12, F.lpad(text(c), 12, "0")).otherwise(text(c)).alias(c)
    return [pad("_page")] * ("_page" in df.columns) + [F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")] * ("url" in df.columns) + [pad(c) for c in ("page_id", "_record", "_row", "_line", "path", "run", "seq", "row_no", "page", "index") if c in df.columns]


def file_manifest(files: DataFrame, template: str = "{{file.name}}", bound: Callable[[DataFrame, str], Column] | None = None) -> DataFrame:
    """url, index and the safe path that a file would be saved under: name, stem, ext, host and index may be in the template.
    bound makes a column of a template with other names."""
    from rowloom.sinks.datasets import safe_segment

    path = F.regexp_extract("url", r"(?i)^[a-z]+://[^/?#]*([^?#]*)", 1)
    last = F.try_url_decode(F.regexp_extract(path, r"([^/]+)/*$", 1))
    subtype = F.regexp_extract("url", r"(?i)^data:[^/;,]*/([A-Za-z0-9.-]+)", 1)
    numbered = F.concat(F.lit("file-"), F.col("index").cast("string"))
    name = F.when(F.startswith(F.lower("url"), F.lit("data:")), F.concat(numbered, F.lit("."), F.when(subtype == "", "bin").otherwise(subtype))).otherwise(F.when(F.coalesce(last, F.lit("")) == "", numbered).otherwise(last))
    ext = F.regexp_extract("name", r"^.+\.([A-Za-z0-9]{1,8})$", 1)
    facts = files.withColumn("name", name).withColumn("ext", ext).withColumn("host", F.lower(F.regexp_extract("url", r"(?i)^[a-z]+://([^/?#:]*)", 1)))
    facts = facts.withColumn("file", F.struct("name", F.when(F.col("ext") != "", F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("name")).alias("stem"), "ext", "host", "index"))
    own = lambda s: bound(facts, s) if bound is not None and X.heads(s) - {"file"} else templates.compile_template(facts, s)
    whole = lambda s: F.concat(*(own(x) for x in re.split(r"(?<=\}\})|(?=\{\{)", s) if x)) if s else F.lit("")
    segments = [safe_segment(whole(s)) for s in template.split("/")]
    final = F.when(segments[-1] != "", segments[-1]).otherwise(safe_segment(F.col("name")))
    named = F.when((F.col("ext") != "") & ~F.rlike(final, F.lit(r"\.[A-Za-z0-9]{1,8}$")), F.concat(final, F.lit("."), F.col("ext"))).otherwise(final)
    folders = [F.when(s != "", s) for s in segments[:-1][:8]]
    return facts.withColumn("path", F.concat_ws("/", *folders, named)).drop("file")


def compile_recipe(spark: SparkSession, recipe: object, sources: Sources, collected: Collected | None = None) -> Result:
    """The rows that a recipe collects, and the exports it asks for; nothing runs until they are used, unless collected,
    which is given the rows of each top-level step, has them written."""
    r = recipe if isinstance(recipe, Recipe) else read_recipe(recipe)
    if r.errors:
        raise RecipeError("; ".join(r.errors))
    refused = unrunnable(r)
    if refused:
        raise RecipeError("; ".join(f"{kind} ({i}): {why}" for i, kind, why in refused))
    wanted = X.heads([s.config for s in walk(r.steps)]) | {X.keys(str(s.config.get("contextPath") or ""))[0] for s in walk(r.steps)}
    c = _Compiler(spark, sources, frozenset(wanted))
    kept = collected or Collected()
    for i, step in enumerate(r.steps):
        if not kept.before(i):
            kept.stopped_at = i
            break
        n = len(c.collected)
        c.run([step])
        c.collected[n:] = kept.after(i, c.collected[n:])
    return Result(c.rows(), c.exports, c.seen, c.notes, c.rows, c.everything)


def counters(done: Result) -> dict[str, int]:
    """Rows that a run collected, and those that its deduplication and empty pages dropped."""
    kept, given = (0 if df is None else df.count() for df in (done.rows, done.collected()))
    return {"rows": kept, "dropped": given - kept}


#: Columns that say where a row comes from; exports leave them out.
ENGINE_COLUMNS = ("_record", "_row", "_line", "_page", "_step")


def run_exports(done: Result, out: str, datasets_root: str, stored: DataFrame | None = None) -> list[dict]:
    """Write a run's exports under out, one document each, in a folder of parts, in the order of the run; returns what each
    has written.

    An appending export adds its rows to its dataset and writes the whole of it. Any other writes the rows so far, and
    before them those stored by an interrupted run that are not among them.
    """
    from rowloom.sinks import datasets

    report = []
    for e in done.exports:
        rows = done.upto(e["upto"], placed=True)
        path = f"{out}/{datasets.dataset_name(e['filename'])}"
        if rows is None:
            report.append({"path": None, "rows": 0})
            continue
        rows = rows.drop(*ENGINE_COLUMNS)
        if e["append"]:
            report.append({"path": path} | datasets.export_appended(rows, datasets_root, e["dataset"] or "default", e["format"], path, "_seq"))
            continue
        if stored is not None:
            # Stored rows first, as they were there before; then those of this run.
            names = [c for c in rows.columns if c != "_seq"]
            kept = stored.select(*(F.col(f"`{c}`") if c in stored.columns else F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in names))
            key = D.export_key(kept)
            kept = kept.withColumn("__key", key).withColumn("_seq", F.lit(""))
            keyed = rows.withColumn("__key", D.export_key(rows.drop("_seq")))
            rows = datasets.merge_stores(keyed, kept, "__key").drop("__key")
        report.append({"path": path, "rows": sink.write_document(rows, e["format"], path, "overwrite", "_seq")})
    return report


def paginate_until_empty(rows: DataFrame, page: str, kept: str, first_rows: bool = False) -> DataFrame:
    """Pages (page number, kept rows) of a numbered pagination up to and with the first that added nothing, once the run has
    rows: first_rows says that it has some before its first page."""
    begun = F.lit(True) if first_rows else F.col(page) > rows.agg(F.min(F.when(F.col(kept) > 0, F.col(page)))).scalar()
    stop = rows.where((F.col(kept) == 0) & begun).agg(F.min(page).alias("stop")).scalar()
    return rows.where(F.coalesce(F.col(page) <= stop, F.lit(True)))
