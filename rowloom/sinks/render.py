"""Rows as text: CSV, TSV, JSON, JSONL, XML and Markdown, one `line` per output line, built from Catalyst expressions.

render_lines keeps everything distributed; render_text joins the lines on the driver, for results small enough to be
one string; write_lines writes files, each a whole document; write_document writes one document of any size, in order, in
parts.
"""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rowloom.functions.js import text_of
from rowloom.operators.numbering import numbered

#: Extension, media type and label of each format (fixed values).
FORMATS = {
    "csv": ("csv", "text/csv", "CSV"), "json": ("json", "application/json", "JSON"), "jsonl": ("jsonl", "application/x-ndjson", "JSONL"),
    "tsv": ("tsv", "text/tab-separated-values", "TSV"), "xml": ("xml", "application/xml", "XML"), "markdown": ("md", "text/markdown", "Markdown"),
}
APPENDABLE = ("csv", "tsv", "jsonl")


def format_meta(name: str) -> dict[str, str]:
    if name not in FORMATS:
        raise ValueError(f"{name!r} is no format rows can be written in ({', '.join(FORMATS)})")
    return dict(zip(("ext", "mime", "label"), FORMATS[name], strict=True))


def default_filename(name: str, stem: str = "export") -> str:
    return f"{stem}.{format_meta(name)['ext']}"


def cell(df: DataFrame, name: str) -> Column:
    """A value as text: null is empty, structures are JSON, 0 and false stay."""
    return F.coalesce(text_of(F.col(f"`{name}`"), dict(df.dtypes)[name]), F.lit(""))


def _csv(c: Column) -> Column:
    return F.when(F.rlike(c, F.lit('[",\r\n]')), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def _xml(c: Column) -> Column:
    marks = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda x, m: F.replace(x, F.lit(m[0]), F.lit(m[1])), marks, c)


def xml_tag(name: str) -> str:
    clean = re.sub(r"[^A-Za-z0-9_.-]", "_", name)
    return clean if re.match(r"[A-Za-z_]", clean) else f"_{clean}"


def line(df: DataFrame, fmt: str) -> Column:
    """A row's text in a format, without the line's end."""
    names = df.columns
    if fmt == "csv":
        return F.concat_ws(",", *(_csv(cell(df, n)) for n in names))
    if fmt == "tsv":
        return F.concat_ws("\t", *(F.translate(cell(df, n), "\t\r\n", "   ") for n in names))
    if fmt == "markdown":
        clean = (F.regexp_replace(F.replace(cell(df, n), F.lit("|"), F.lit("\\|")), "\r?\n", " ") for n in names)
        return F.concat(F.lit("| "), F.concat_ws(" | ", *clean), F.lit(" |"))
    if fmt == "xml":
        parts = [F.concat(F.lit(f"    <{xml_tag(n)}>"), _xml(cell(df, n)), F.lit(f"</{xml_tag(n)}>")) for n in names]
        return F.concat_ws("\n", F.lit("  <row>"), *parts, F.lit("  </row>"))
    if fmt in ("jsonl", "json"):
        return F.to_json(F.struct(*(F.col(f"`{n}`") for n in names)), {"ignoreNullFields": "false"})
    raise ValueError(f"{fmt!r} is no format rows can be written in")


def header(columns: list[str], fmt: str) -> list[str]:
    if fmt == "csv":
        return [",".join(f'"{n.replace(chr(34), chr(34) * 2)}"' if re.search('[",\r\n]', n) else n for n in columns)]
    if fmt == "tsv":
        return ["\t".join(re.sub("[\t\r\n]", " ", n) for n in columns)]
    if fmt == "markdown":
        clean = [re.sub("\r?\n", " ", n.replace("|", "\\|")) for n in columns]
        return [f"| {' | '.join(clean)} |", f"| {' | '.join('---' for _ in columns)} |"]
    if fmt == "xml":
        return ['<?xml version="1.0" encoding="UTF-8"?>', "<rows>"]
    return []


def render_lines(df: DataFrame, fmt: str, order: str) -> DataFrame:
    """(seq, line): the rows' lines, with the order column as seq; headers are negative, footers have no seq but the largest."""
    format_meta(fmt)
    body = df.drop(order)
    rows = df.select(F.col(order).cast("long").alias("seq"), line(body, fmt).alias("line"))
    head = header(body.columns, fmt)
    if not head:
        return rows
    top = df.sparkSession.createDataFrame([(i - len(head), h) for i, h in enumerate(head)], "seq long, line string")
    return top.unionByName(rows)


def render_text(df: DataFrame, fmt: str, order: str, most_rows: int = 200_000) -> str:
    """The whole text on the driver; more than most_rows rows raise, as that is what write_lines is for."""
    format_meta(fmt)
    body = df.drop(order)
    rows = [r.line for r in df.orderBy(order).select(line(body, fmt).alias("line")).limit(most_rows + 1).collect()]
    if len(rows) > most_rows:
        raise ValueError(f"more than {most_rows} rows for one string; use write_lines")
    if fmt == "json":
        return json.dumps([json.loads(r) for r in rows], indent=2, ensure_ascii=False)
    if not rows:
        return ""
    end = "\r\n" if fmt == "csv" else "\n"
    foot = ["</rows>"] if fmt == "xml" else []
    return end.join([*header(body.columns, fmt), *rows, *foot]) + end


def _document(fmt: str, columns: list[str], lone: bool):
    """For mapInArrow: a partition's rows between the header and the footer of the format, so that each file is whole."""
    import pyarrow as pa

    def wrap(batches):
        top, foot, held = header(columns, fmt), ["</rows>"] if fmt == "xml" else [], None
        for batch in batches:
            out = []
            for row in batch.column(0).to_pylist():
                if fmt == "json":
                    # A row is held back until it is known whether a comma follows it.
                    out.append("[" if held is None else f"{held},")
                    held = "  " + json.dumps(json.loads(row), indent=2, ensure_ascii=False).replace("\n", "\n  ")
                else:
                    out += [row] if held else [*top, row]
                    held = "begun"
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
        last = ([held, "]"] if held else ["[]"] if lone else []) if fmt == "json" else foot if held else []
        yield pa.RecordBatch.from_arrays([pa.array(last, pa.string())], names=["value"])

    return wrap


def write_lines(df: DataFrame, fmt: str, path: str, mode: str = "error", order: str | None = None, files: int | None = None) -> None:
    """The rows as text files, each a whole document of the format (with its header, root or brackets), with cells as
    they are. order: a column to sort by, which is not written; files: the number of files (1: one document, in order),
    by default one for each partition."""
    format_meta(fmt)
    body = df if order is None else df.drop(order)
    rows = df.select(line(body, fmt).alias("value"), *([F.col(f"`{order}`").alias("seq")] if order else []))
    if files is not None:
        rows = rows.repartition(files) if order is None else rows.repartitionByRange(files, "seq")
    if order is not None:
        rows = (rows.orderBy("seq") if files is None else rows.sortWithinPartitions("seq")).drop("seq")
    if fmt != "jsonl":
        rows = rows.mapInArrow(_document(fmt, body.columns, files == 1), "value string")
    rows.write.mode(mode).option("lineSep", "\r\n" if fmt == "csv" else "\n").text(path)


def _indented(rows: DataFrame) -> DataFrame:
    """JSON rows (value) over several lines, as elements of a list."""
    import pyarrow as pa

    def each(batches):
        for b in batches:
            texts = ["  " + json.dumps(json.loads(x), indent=2, ensure_ascii=False).replace("\n", "\n  ") for x in b.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("n"), pa.array(texts, pa.string())], names=["n", "value"])

    return rows.select("n", "value").mapInArrow(each, "n bigint, value string")


def write_document(df: DataFrame, fmt: str, path: str, mode: str = "error", order: str | None = None) -> int:
    """The rows as one document, in order of a column that is not written (without one, as they are read), in parts: the
    text files of the folder, joined by name, are the document. Rows are numbered by ranges, so no task sees them all; the
    first brings the header along, the last the footer. Returns the number of rows."""
    format_meta(fmt)
    body = df if order is None else df.drop(order)
    place = F.monotonically_increasing_id() if order is None else F.col(f"`{order}`")
    placed = numbered(df.select(line(body, fmt).alias("value"), place.alias("seq")), "seq", "n")
    n, end = placed.count(), "\r\n" if fmt == "csv" else "\n"
    top, foot = header(body.columns, fmt), ["</rows>"] if fmt == "xml" else []
    if fmt == "json":
        placed, top, foot = _indented(placed), ["["], ["]"]
    if n == 0:
        whole = ["[]"] if fmt == "json" else []
        df.sparkSession.createDataFrame([(x,) for x in whole], "value string").coalesce(1).write.mode(mode).option("lineSep", end).text(path)
        return 0
    first, last = F.when(F.col("n") == 0, F.lit("".join(x + end for x in top))).otherwise(""), F.lit("".join(end + x for x in foot))
    comma = F.lit("," if fmt == "json" else "")
    text = F.concat(first, "value", F.when(F.col("n") == n - 1, last).otherwise(comma))
    ordered = placed.select("n", text.alias("value")).repartitionByRange("n").sortWithinPartitions("n")
    ordered.select("value").write.mode(mode).option("lineSep", end).text(path)
    return n


def read_document(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """n, from 0, and value: the lines of a document that write_document wrote, in order."""
    lines = spark.read.option("lineSep", "\r\n" if fmt == "csv" else "\n").text(path)
    # Within a file, ids go up line by line; parts of a document are read whole or split in order.
    place = F.concat_ws(":", F.col("_metadata.file_name"), F.lpad(F.col("_metadata.file_block_start").cast("string"), 20, "0"), F.lpad(F.monotonically_increasing_id().cast("string"), 20, "0"))
    return numbered(lines.select("value", place.alias("place")), "place", "n").select("n", "value")


def union_rows(*frames: DataFrame) -> DataFrame:
    """All rows under the union of the columns, in the order first seen."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def header_order(rows: DataFrame, order: str, row: str = "row") -> DataFrame:
    """(key, place) of rows held as maps: keys by the first row, and the place in it, that has them."""
    keys = rows.select(F.col(order), F.posexplode(F.map_keys(row)).alias("pos", "key"))
    first = keys.groupBy("key").agg(F.min(F.struct(order, "pos")).alias("first"))
    return first.select("key", F.col(f"first.{order}").alias("seq"), F.col("first.pos").alias("pos"))
