"""JSON APIs: rows in recorded responses, the rules of pagination and retry, and a data source that fetches live."""

from __future__ import annotations

import json
import re
from email.utils import parsedate_to_datetime
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition, SimpleDataSourceStreamReader

#: Limits of retries and pagination (fixed values).
MAX_ATTEMPTS, MAX_WAIT_MS, BASE_WAIT_MS = 4, 60_000, 1000
DEFAULT_PAGES, MOST_PAGES = 10, 500
MODES = ("none", "cursor", "page", "link")


def json_path(path: str) -> str:
    """a.b[0].1 as a VARIANT path."""
    out = "$"
    for part in filter(None, path.strip().split(".")):
        m = re.fullmatch(r"(.*?)((?:\[\d+\])*)", part)
        name, indexes = m[1], m[2]
        out += f"[{name}]" if name.isdigit() else f"['{name}']" if name else ""
        out += indexes
    return out


def value_at(body: Column, path: str, kind: str = "string") -> Column:
    """A value inside a JSON text by dotted path; null where there is none."""
    return F.try_variant_get(F.try_parse_json(body), json_path(path), kind)


def rows_at(df: DataFrame, body: str, rows_path: str = "", row: str = "row") -> DataFrame:
    """A row for each element of the array at a path of a JSON text (`row`, JSON text, and `row_no`); anything but an array gives none."""
    found = F.try_variant_get(F.try_parse_json(F.col(body)), json_path(rows_path), "array<variant>")
    kept = [c for c in df.columns if c not in (body, row, "row_no")]
    return df.select(*kept, F.posexplode(found).alias("row_no", "__row")).select(*kept, "row_no", F.to_json("__row").alias(row))


def max_pages(given: object = None) -> int:
    try:
        n = int(float(given))
    except (TypeError, ValueError, OverflowError):
        return DEFAULT_PAGES
    return DEFAULT_PAGES if n <= 0 else min(n, MOST_PAGES)


def check_pagination(mode: str, rows_path: str, cursor_path: str = "") -> str:
    mode = (mode or "none").lower()
    if mode not in MODES:
        raise ValueError(f"{mode!r} is no mode of pagination ({', '.join(MODES)})")
    if mode != "none" and not rows_path.strip():
        raise ValueError("pagination needs rowsPath: a page is empty when it has no rows there")
    if mode == "cursor" and not cursor_path.strip():
        raise ValueError("pagination by cursor needs cursorPath, where a response holds the next one")
    return mode


# Why a pagination stopped.
NO_CURSOR, NO_LINK, EMPTY_PAGE = "no next cursor in the response", 'no rel="next" in the Link header', "the page was empty"


def recorded_pages(responses: DataFrame, mode: str, rows_path: str, cursor_path: str = "", pages: object = None, run: str = "run", seq: str = "seq", body: str = "body", status: str = "status", link: str = "link") -> DataFrame:
    """The recorded responses of each run that pagination would have asked for, with stop_reason on the last.

    A run's first response that fails is an error (raised when read); a later one ends it. Runs are partitions; within
    one, pages are few (MOST_PAGES).
    """
    mode = check_pagination(mode, rows_path, cursor_path)
    most = 1 if mode == "none" else max_pages(pages)
    by_run = W.partitionBy(run).orderBy(seq)
    n_rows = F.coalesce(F.size(F.try_variant_get(F.try_parse_json(F.col(body)), json_path(rows_path), "array<variant>")), F.lit(0))
    cursor = value_at(F.col(body), cursor_path) if mode == "cursor" else F.lit(None).cast("string")
    more = {"none": F.lit(False), "page": F.lit(True), "cursor": F.coalesce(cursor, F.lit("")) != "", "link": link_next(F.col(link)).isNotNull() if mode == "link" else F.lit(False)}[mode]
    no_more = {"none": "", "page": "", "cursor": NO_CURSOR, "link": NO_LINK}[mode]
    failed = F.coalesce(F.col(status), F.lit(200)) >= 400
    numbered = responses.withColumn("__n", F.row_number().over(by_run)).withColumn("__rows", n_rows)
    numbered = numbered.withColumn("__failed", F.when(failed & (F.col("__n") == 1), F.raise_error(F.concat(F.lit("API request failed: "), F.col(status).cast("string"))).cast("boolean")).otherwise(failed))
    reason = (
        F.when(F.col("__failed"), F.concat(F.lit("page "), F.col("__n").cast("string"), F.lit(" failed: "), F.col(status).cast("string")))
        .when(F.lit(mode == "none"), "").when(F.col("__rows") == 0, EMPTY_PAGE).when(F.col("__n") >= most, f"reached the {most}-page limit").when(~more, no_more)
    )
    stopped = numbered.withColumn("stop_reason", reason)
    first = stopped.withColumn("__stop", F.min(F.when(F.col("stop_reason").isNotNull(), F.col("__n"))).over(W.partitionBy(run)))
    kept = first.where((F.col("__n") <= F.coalesce("__stop", F.lit(most))) & ~F.col("__failed"))
    return kept.select(*responses.columns, "stop_reason")


def add_query(url: str, key: str, value: object) -> str:
    """url with the parameter set (not added a second time)."""
    parts = urlsplit(url)
    if not parts.scheme or not parts.netloc:
        return f"{url}{'&' if '?' in url else '?'}{quote(key, safe='')}={quote(str(value), safe='')}"
    pairs = parse_qsl(parts.query, keep_blank_values=True)
    place = next((i for i, (k, _) in enumerate(pairs) if k == key), None)
    rest = [(k, v) for i, (k, v) in enumerate(pairs) if k != key or i == place]
    rest = [(k, str(value) if k == key else v) for k, v in rest] if place is not None else [*rest, (key, str(value))]
    return urlunsplit((parts.scheme, parts.netloc, parts.path or "/", urlencode(rest), parts.fragment))


def link_next(header: Column) -> Column:
    """The address of rel=next in a Link header; rel is compared whole."""
    parts = F.split(header, r",(?=\s*<)")
    rel = lambda p: F.lower(F.regexp_extract(p, r"(?i)rel\s*=\s*\"?([^\",;]+)\"?", 1)) == "next"
    part = F.try_element_at(F.filter(parts, lambda p: rel(p) & F.rlike(p, F.lit("<[^>]+>"))), F.lit(1))
    return F.nullif(F.regexp_extract(part, "<([^>]+)>", 1), F.lit(""))


def next_link(header: str | None, base: str) -> str | None:
    for part in re.split(r",(?=\s*<)", header or ""):
        address, rel = re.search("<([^>]+)>", part), re.search(r'rel\s*=\s*"?([^",;]+)"?', part, re.I)
        if address and rel and rel[1].lower() == "next":
            return urljoin(base, address[1])
    return None


def retry_after_ms(value: str | None, now_ms: int) -> int | None:
    """What a Retry-After header asks for: seconds or an HTTP date; nothing else is guessed."""
    text = (value or "").strip()
    if text.isascii() and text.isdigit():
        return int(text) * 1000
    try:
        return max(0, int(parsedate_to_datetime(text).timestamp() * 1000) - now_ms) if text else None
    except (TypeError, ValueError):
        return None


def retry_wait(status: int, attempt: int, waited_ms: int, retry_after: int | None = None) -> int | None:
    """How long to wait before the next attempt (attempt counts those made), or None to give up."""
    if not (status == 429 or 500 <= status <= 599) or attempt >= MAX_ATTEMPTS or waited_ms >= MAX_WAIT_MS:
        return None
    return max(0, min(BASE_WAIT_MS << (attempt - 1) if retry_after is None else retry_after, MAX_WAIT_MS - waited_ms))


def retry_schedule(df: DataFrame, status: str = "status", attempt: str = "attempt", waited: str = "waited_ms", retry_after_s: str = "retry_after_s") -> DataFrame:
    """wait_ms by the same rule, as columns."""
    wanted = F.coalesce(F.col(retry_after_s) * 1000, F.shiftleft(F.lit(BASE_WAIT_MS), 1) / 2 * F.pow(F.lit(2), F.col(attempt) - 1))
    retryable = (F.col(status) == 429) | F.col(status).between(500, 599)
    go_on = retryable & (F.col(attempt) < MAX_ATTEMPTS) & (F.col(waited) < MAX_WAIT_MS)
    return df.withColumn("wait_ms", F.when(go_on, F.greatest(F.lit(0), F.least(wanted, F.lit(MAX_WAIT_MS) - F.col(waited))).cast("long")))


# ---- live -----------------------------------------------------------------------------------------------------------


def fetch(url: str, headers: dict[str, str], timeout_s: float) -> tuple[int, dict[str, str], str]:
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    try:
        with urlopen(Request(url, headers=headers), timeout=timeout_s) as r:  # noqa: S310 (the scheme is checked by the caller)
            return r.status, {k.lower(): v for k, v in r.headers.items()}, r.read().decode("utf-8", "replace")
    except HTTPError as error:
        return error.code, {k.lower(): v for k, v in error.headers.items()}, error.read().decode("utf-8", "replace")


def _dig(body, path: str):
    for part in filter(None, re.split(r"\.|\[|\]", path)):
        if isinstance(body, list) and part.isdigit() and int(part) < len(body):
            body = body[int(part)]
        elif isinstance(body, dict):
            body = body.get(part)
        else:
            return None
    return body


def first_address(options: dict[str, str], base: str) -> str:
    """The address of the first page, once the options are found to be in order."""
    if not re.match("https?://", base):
        raise ValueError("An API source needs a full http:// or https:// address.")
    mode = check_pagination(options.get("mode", "none"), options.get("rowspath", ""), options.get("cursorpath", ""))
    return add_query(base, options.get("pageparam", "page"), int(options.get("startpage", 1))) if mode == "page" else base


def most_pages(options: dict[str, str]) -> int:
    return 1 if (options.get("mode") or "none").lower() == "none" else max_pages(options.get("maxpages"))


def read_page(options: dict[str, str], base: str, url: str, number: int, get=fetch, sleep=None, now=None) -> tuple[list[str], str | None]:
    """Rows (JSON texts) of the page at url, the number-th from 0, and the address of the next one; retries as the rules
    have it. A first page that fails is an error, a later one the end."""
    import time

    sleep, now = sleep or time.sleep, now or (lambda: int(time.time() * 1000))
    mode, rows_path, cursor_path = (options.get("mode") or "none").lower(), options.get("rowspath", ""), options.get("cursorpath", "")
    headers = json.loads(options.get("headers", "{}"))
    attempt, waited = 0, 0
    while True:
        status, given, text = get(url, headers, float(options.get("timeoutms", 15000)) / 1000)
        attempt += 1
        wait = retry_wait(status, attempt, waited, retry_after_ms(given.get("retry-after"), now()))
        if wait is None:
            break
        sleep(wait / 1000)
        waited += wait
    if status >= 400:
        if number == 0:
            raise RuntimeError(f"API GET {url} failed: {status}")
        return [], None
    body = json.loads(text)
    rows = _dig(body, rows_path) if rows_path else body
    rows = rows if isinstance(rows, list) else []
    following = None
    if mode == "cursor" and _dig(body, cursor_path) not in (None, ""):
        following = add_query(base, options.get("cursorparam", "cursor"), _dig(body, cursor_path))
    elif mode == "page":
        following = add_query(base, options.get("pageparam", "page"), int(options.get("startpage", 1)) + (number + 1) * (int(options.get("pagestep", 1)) or 1))
    elif mode == "link":
        following = next_link(given.get("link"), url)
    return [json.dumps(r, ensure_ascii=False) for r in rows], following if rows and number + 1 < most_pages(options) else None


def read_pages(options: dict[str, str], get=fetch, sleep=None, now=None):
    """Page numbers from 1 and rows (JSON texts) of an API step, page after page."""
    base = options["url"]
    url, number = first_address(options, base), 0
    while url is not None:
        rows, url = read_page(options, base, url, number, get, sleep, now)
        number += 1
        for r in rows:
            yield number, r


class ApiReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.options = options

    def partitions(self):
        """One for each address: several, separated by white space, are read in parallel."""
        return [InputPartition(u) for u in self.options["url"].split()]

    def read(self, partition):
        for page, row in read_pages({**self.options, "url": partition.value}):
            yield partition.value, page, row


class ApiStreamReader(SimpleDataSourceStreamReader):
    """One page of each address a micro-batch. The offset holds, for each address, that of its next page (null when there is
    none) and how many have been read, so a query that starts again from its checkpoint asks for no page a second time."""

    def __init__(self, options: dict[str, str]):
        self.options = options

    def initialOffset(self) -> dict:
        return {base: [first_address(self.options, base), 0] for base in self.options["url"].split()}

    def _step(self, start: dict, only: set[str] | None = None) -> tuple[list[tuple], dict]:
        out, end = [], {}
        for base, (url, number) in start.items():
            if url is None or (only is not None and base not in only):
                end[base] = [url, number]
                continue
            rows, following = read_page(self.options, base, url, number)
            out += [(base, number + 1, r) for r in rows]
            end[base] = [following, number + 1]
        return out, end

    def read(self, start: dict):
        rows, end = self._step(start)
        return iter(rows), end

    def readBetweenOffsets(self, start: dict, end: dict):
        """The rows of a batch that was planned but not finished: its pages are asked for again."""
        at = start
        while behind := {base for base, (_, number) in at.items() if number < end[base][1]}:
            rows, at = self._step(at, behind)
            yield from rows

    def commit(self, end: dict) -> None:
        """Pages need no acknowledgement."""


class ApiDataSource(DataSource):
    """spark.dataSource.register(ApiDataSource); spark.read.format("rowloom_api").option("url", ...).load(), or readStream:
    then each micro-batch brings a page, and a checkpoint remembers the next."""

    @classmethod
    def name(cls) -> str:
        return "rowloom_api"

    def schema(self) -> str:
        return "url string, page int, row string"

    def reader(self, schema):
        return ApiReader({k.lower(): v for k, v in self.options.items()})

    def simpleStreamReader(self, schema):
        return ApiStreamReader({k.lower(): v for k, v in self.options.items()})
