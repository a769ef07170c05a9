"""Pasted lists, JSON lines in program output, and header texts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rowloom.functions.js import trim
from rowloom.operators.numbering import numbered

MOST_ITEMS = 10_000

#: Header names that a request must not set, and ports that speak SOCKS (fixed values).
REFUSED_HEADERS = ("host", "content-length", "connection", "transfer-encoding", "upgrade", "keep-alive", "proxy-authorization", "proxy-connection", "trailer", "te")
SOCKS_PORTS = (1080, 1081, 9050, 9150)


def split_cells(line: Column, delimiter: str = ",") -> Column:
    """Cells of a delimited line: quotes count only at a cell's start, two quotes in a quoted cell are one, cells are trimmed."""
    sep = re.escape((delimiter or ",")[0])
    # A leading separator makes every cell, the first too, "separator then cell", so that none can be matched as empty by accident.
    pattern = rf"{sep}(\"(?:[^\"]|\"\")*\"[^{sep}]*|[^{sep}]*)"
    raw = F.regexp_extract_all(F.concat(F.lit((delimiter or ",")[0]), line), F.lit(pattern), F.lit(1))

    def cell(c: Column) -> Column:
        inner = F.replace(F.regexp_extract(c, "(?s)^\"((?:[^\"]|\"\")*)\"", 1), F.lit('""'), F.lit('"'))
        after = F.regexp_extract(c, "(?s)^\"(?:[^\"]|\"\")*\"(.*)$", 1)
        return trim(F.when(F.rlike(c, F.lit("(?s)^\"(?:[^\"]|\"\")*\"")), F.concat(inner, after)).otherwise(c))

    return F.transform(raw, cell)


def list_items(lines: DataFrame, order: str, text: str = "line", delimiter: str = "", header: list[str] | None = None, most: int = MOST_ITEMS) -> DataFrame:
    """index, index0, value, text and cols (MAP) of each line that is not blank, the first `most` of them.

    Without a delimiter a line is its own value. header names the columns (blank names become colN); without one they
    are col1, col2 and so on, and cells beyond the columns are left out.
    """
    kept = lines.select(F.col(order), trim(F.col(text)).alias("text")).where(F.col("text") != "")
    numbered = kept.orderBy(order).limit(most).withColumn("index", F.row_number().over(W.orderBy(order)))
    if not delimiter:
        cols = F.create_map(F.lit("value"), F.col("text"))
        return numbered.select("index", (F.col("index") - 1).alias("index0"), F.col("text").alias("value"), "text", cols.alias("cols"))
    numbered = numbered.withColumn("cells", split_cells(F.col("text"), delimiter))
    if header is None:
        width = F.first(F.size("cells")).over(W.orderBy("index").rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
        names = F.transform(F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("col"), i.cast("string")))
    else:
        names = F.array(*(F.lit(h or f"col{i + 1}") for i, h in enumerate(header)))
    numbered = numbered.withColumn("names", names)
    cells = F.transform("names", lambda n, i: F.coalesce(F.try_element_at("cells", i + 1), F.lit("")))
    return numbered.select("index", (F.col("index") - 1).alias("index0"), F.coalesce(F.try_element_at("cells", F.lit(1)), F.lit("")).alias("value"), "text", F.map_from_arrays("names", cells).alias("cols"))


def parse_list(lines: DataFrame, order: str, text: str = "line", delimiter: str = "", has_header: bool = False, most: int = MOST_ITEMS) -> tuple[DataFrame, int]:
    """Items of a pasted list, and how many lines did not fit. The header, one line, is read on the driver."""
    kept = lines.where(trim(F.col(text)) != "")
    header = None
    if delimiter and has_header:
        first = kept.orderBy(order).select(order, split_cells(trim(F.col(text)), delimiter).alias("cells")).first()
        if first is not None:
            header = list(first.cells)
            kept = kept.where(F.col(order) > first[order])
    return list_items(kept, order, text, delimiter, header, most), max(0, kept.count() - most)


def output_rows(lines: DataFrame, line: str = "value") -> tuple[DataFrame, DataFrame]:
    """Rows (JSON lines) and noise in what a program printed."""
    json_line = F.coalesce(F.rlike(trim(F.col(line)), F.lit(r"^[{\[]")) & F.try_parse_json(F.col(line)).isNotNull(), F.lit(False))
    return lines.where(json_line), lines.where(~json_line)


def parse_headers(text: str) -> tuple[dict[str, str | None], list[str]]:
    """Headers of Name: value lines, by lower-cased name: the last of a name wins, an empty value (None) removes the header.
    Names that must not be set are reported; comments and blank lines are skipped."""
    out: dict[str, str | None] = {}
    refused = []
    for line in (x.strip() for x in re.split(r"\r?\n", text or "")):
        if not line or line.startswith("#"):
            continue
        name, _, value = line.partition(":")
        name = name.strip().lower()
        if name in REFUSED_HEADERS or name.startswith(("proxy-", "sec-")) or (name and not re.fullmatch(r"[A-Za-z0-9!#$%&'*+.^_`|~-]+", name)):
            refused.append(name)
        elif name:
            out.pop(name, None)
            out[name] = value.strip() or None
    return out, refused


def parse_proxies(lines: DataFrame, line: str = "value") -> DataFrame:
    """host, port, protocol and user of each line that is a proxy, once for each host and port: an address with a scheme
    (and user), host:port, host:port:user:password, or a JSON object. Without a scheme, the port tells the protocol."""
    text = trim(F.col(line))
    as_json = F.when(F.startswith(text, F.lit("{")), text)
    field = lambda *names: F.coalesce(*(F.get_json_object(as_json, f"$.{n}") for n in names))
    with_scheme = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:([^:@/]*)(?::[^@/]*)?@)?([^:/@?#]+)(?::([0-9]+))?"
    plain = r"^([^:#{][^:]*):([0-9]+)(?::([^:]*):([^:]*))?$"
    part = lambda pattern, k: F.nullif(F.regexp_extract(text, pattern, k), F.lit(""))
    named = F.lower(F.coalesce(part(with_scheme, 1), field("type")))
    known = F.when(named == "socks4", "socks4").when(named.isin("socks5", "socks"), "socks5").when(named == "https", "https").when(named.isNotNull(), "http")
    given = F.coalesce(part(with_scheme, 4), field("port"), F.when(~F.contains(text, F.lit("://")), part(plain, 2))).try_cast("int")
    port = F.coalesce(given, F.when(part(with_scheme, 3).isNotNull(), F.when(known == "socks5", 1080).otherwise(3128)))
    host = F.coalesce(part(with_scheme, 3), field("host"), F.when(~F.contains(text, F.lit("://")), part(plain, 1)))
    user = F.coalesce(part(with_scheme, 2), field("user", "username"), F.when(~F.contains(text, F.lit("://")), part(plain, 3)))
    found = lines.select(F.trim(host).alias("host"), port.alias("port"), known.alias("known"), user.alias("user"))
    kept = found.where(F.coalesce(F.col("host"), F.lit("")) != "").where(F.col("port").between(1, 65535))
    protocol = F.coalesce("known", F.when(F.col("port").isin(*SOCKS_PORTS), "socks5").otherwise("http"))
    return kept.select("host", "port", protocol.alias("protocol"), "user").dropDuplicates(["host", "port"])


STRATEGIES = ("round-robin", "random", "sticky", "geo")


def assign_proxies(requests: DataFrame, proxies: DataFrame, order: str, strategy: str = "round-robin", key: str | None = None, country: str | None = None) -> DataFrame:
    """Each request with a proxy of a short list (numbered by host and port): the next in turn; one drawn from the
    order's value (so that reruns agree); the same one for each value of key; or in turn among those of its country, and
    of all where there is none. Without proxies, the requests have none."""
    if strategy not in STRATEGIES:
        raise ValueError(f"{strategy!r} is no way to choose proxies ({', '.join(STRATEGIES)})")
    if strategy == "sticky" and key is None or strategy == "geo" and country is None:
        raise ValueError(f"{strategy} proxies need the column that decides")
    shared = proxies.withColumn("__group", F.lit(""))
    if strategy == "geo":
        shared = shared.unionByName(proxies.withColumn("__group", F.concat(F.lit("="), F.lower(F.col("country")))).where("__group IS NOT NULL"))
    listed = shared.withColumn("__slot", F.row_number().over(W.partitionBy("__group").orderBy("host", "port")) - 1)
    counts = listed.groupBy("__group").agg(F.count(F.lit(1)).alias("__of"))
    if strategy == "sticky":
        number = F.xxhash64(key)
    elif strategy == "random":
        number = F.xxhash64(order, F.lit("proxy"))
    else:
        requests, number = numbered(requests, order, "__number"), F.col("__number")
    wanted = requests.withColumn("__number", number)
    if strategy == "geo":
        known = counts.where("__group <> ''").select(F.col("__group").alias("__own"))
        wanted = wanted.withColumn("__own", F.concat(F.lit("="), F.lower(F.col(country)))).join(known.withColumn("__has", F.lit(True)), "__own", "left")
        wanted = wanted.withColumn("__group", F.when(F.col("__has"), F.col("__own")).otherwise("")).drop("__own", "__has")
    else:
        wanted = wanted.withColumn("__group", F.lit(""))
    dealt = wanted.join(counts, "__group", "left").withColumn("__slot", F.pmod("__number", F.coalesce("__of", F.lit(1))))
    return dealt.join(listed, ["__group", "__slot"], "left").drop("__group", "__slot", "__of", "__number")


def round_robin(requests: DataFrame, proxies: DataFrame, order: str) -> DataFrame:
    """Each request with the next proxy of the list in turn."""
    return assign_proxies(requests, proxies, order)
