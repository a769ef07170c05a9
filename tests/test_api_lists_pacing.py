import json
import threading
from datetime import datetime, timedelta
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from rowloom.sources import api, lists
from rowloom.streaming import pacing


def recorded(spark, bodies, **more):
    rows = [("r", i + 1, b if isinstance(b, str) else json.dumps(b), 200, None) for i, b in enumerate(bodies)]
    return spark.createDataFrame(rows, "run string, seq int, body string, status int, link string")


def test_recorded_pagination(spark):
    pages = recorded(spark, [{"data": [{"id": 1}, {"id": 2}], "meta": {"next": "x"}}, {"data": [{"id": 3}], "meta": {"next": None}}, {"data": [{"id": 4}]}])
    kept = api.recorded_pages(pages, "cursor", "data", "meta.next")
    ids = [json.loads(r.row)["id"] for r in sorted(api.rows_at(kept, "body", "data").collect(), key=lambda r: (r.seq, r.row_no))]
    assert ids == [1, 2, 3] and kept.where("seq = 2").first().stop_reason == "no next cursor in the response"
    empty = api.recorded_pages(recorded(spark, [[1], [2], [], [3]]), "page", "data")
    assert empty.count() == 1
    limited = api.recorded_pages(recorded(spark, [{"d": [1]}] * 5), "page", "d", pages=2)
    assert limited.count() == 2 and limited.where("seq = 2").first().stop_reason == "reached the 2-page limit"
    broken = pages.withColumn("status", F.when(F.col("seq") == 2, 500).otherwise(200))
    assert [r.seq for r in api.recorded_pages(broken, "page", "data").collect()] == [1]
    with pytest.raises(Exception, match="API request failed: 404"):
        api.recorded_pages(pages.withColumn("status", F.lit(404)), "page", "data").collect()
    links = pages.withColumn("link", F.when(F.col("seq") == 1, '<a?x=1,2>; rel="prev", </n>; rel="next"').otherwise('</z>; rel="next last"'))
    assert api.recorded_pages(links, "link", "data").count() == 2
    for bad in (("cursor", "data", ""), ("page", "", ""), ("zig", "data", "")):
        with pytest.raises(ValueError):
            api.check_pagination(*bad)


def test_paths(spark):
    df = spark.createDataFrame([('{"a":{"b":[{"c":5},{"c":"x"}]},"l":[1]}',), ("no json",), (None,)], "j string")
    got = [tuple(r) for r in df.select(api.value_at(F.col("j"), "a.b[1].c"), api.value_at(F.col("j"), "a.b.0.c"), api.value_at(F.col("j"), "a.zz")).collect()]
    assert got == [("x", "5", None), (None,) * 3, (None,) * 3]
    assert api.rows_at(df, "j", "a").count() == 0 and api.rows_at(df, "j", "l").count() == 1


def test_retry_rules():
    assert [api.retry_wait(503, a, 0) for a in (1, 2, 3, 4)] == [1000, 2000, 4000, None]
    assert api.retry_wait(404, 1, 0) is None and api.retry_wait(429, 1, 0, 90_000) == 60_000 and api.retry_wait(429, 2, 60_000) is None
    assert api.retry_after_ms("7", 0) == 7000 and api.retry_after_ms("Thu, 01 Jan 1970 00:00:09 GMT", 4000) == 5000 and api.retry_after_ms("soon", 0) is None
    assert api.max_pages("9999") == 500 and api.max_pages(-1) == 10 and api.max_pages("x") == 10
    assert api.add_query("https://s.test/a?page=1&b=2", "page", 3) == "https://s.test/a?page=3&b=2" and api.add_query("/a?b", "c", "d e") == "/a?b&c=d%20e"


class Handler(BaseHTTPRequestHandler):
    calls = 0

    def do_GET(self):
        Handler.calls += 1
        page = int(self.path.split("page=")[1]) if "page=" in self.path else 1
        if page == 2 and Handler.calls == 2:
            self.send_response(429)
            self.send_header("Retry-After", "0")
            self.end_headers()
            return
        self.send_response(200)
        self.end_headers()
        self.wfile.write(json.dumps({"items": [{"id": page * 10 + k} for k in range(2)] if page < 4 else []}).encode())

    def log_message(self, *_):
        pass


def test_live_source(spark):
    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(api.ApiDataSource)
    rows = spark.read.format("rowloom_api").options(url=f"http://127.0.0.1:{server.server_port}/x", rowsPath="items", mode="page").load().collect()
    server.shutdown()
    assert [json.loads(r.row)["id"] for r in rows] == [10, 11, 20, 21, 30, 31] and rows[-1].page == 3


def test_pasted_lists(spark):
    lines = spark.createDataFrame(list(enumerate(["url,sku", '"Smith, John",42,"x"', "", '12" pipe,steel', ' "a ""b""" , c '])), "n int, line string")
    items, cut = lists.parse_list(lines, "n", delimiter=",", has_header=True)
    got = sorted(items.collect(), key=lambda r: r["index"])
    assert [r.cols for r in got] == [{"url": "Smith, John", "sku": "42"}, {"url": '12" pipe', "sku": "steel"}, {"url": 'a "b"', "sku": "c"}] and cut == 0
    plain, _ = lists.parse_list(lines, "n")
    assert [(r["index"], r.value) for r in sorted(plain.collect(), key=lambda r: r["index"])][1] == (2, '"Smith, John",42,"x"')
    few, cut = lists.parse_list(lines, "n", delimiter=",", most=2)
    assert few.count() == 2 and cut == 2 and sorted(few.first().cols) == ["col1", "col2"]
    rows, noise = lists.output_rows(spark.createDataFrame([('{"a":1}',), ("log",), ("[1]",), ("{bad",)], "value string"))
    assert rows.count() == 2 and noise.count() == 2
    assert lists.parse_headers("A: 1\n# c\nHost: x\na: 2\nnope\nSec-X: 1") == ({"a": "2", "nope": None}, ["host", "sec-x"])
    given = ["1.2.3.4:80", "socks5://u:p@h.test:1080", "h:99999", "1.2.3.4:80:u:p", "x", "a.test:9050:me:pw", "https://b.test", '{"host":"c.test","port":8080,"username":"z"}', "# c:1"]
    proxies = lists.parse_proxies(spark.createDataFrame([(g,) for g in given], "value string"))
    assert sorted((r.host, r.port, r.protocol) for r in proxies.collect()) == [("1.2.3.4", 80, "http"), ("a.test", 9050, "socks5"), ("b.test", 3128, "https"), ("c.test", 8080, "http"), ("h.test", 1080, "socks5")]
    dealt = lists.round_robin(spark.range(7).withColumnRenamed("id", "n"), proxies, "n")
    assert [r.host for r in dealt.orderBy("n").collect()][:6] == ["1.2.3.4", "a.test", "b.test", "c.test", "h.test", "1.2.3.4"]


def simulate(times, burst, rate):
    tokens, last, free, out = float(burst), None, None, []
    for t in times:
        now = t if free is None or t > free else free
        tokens = burst if last is None else min(burst, tokens + (now - last) * rate)
        wait = max(0.0, (1 - tokens) / rate)
        now += wait
        tokens = tokens + wait * rate - 1
        last = free = now
        out.append(now)
    return out


def test_grants_equal_a_token_bucket(spark):
    import random

    r, start = random.Random(4), datetime(2024, 1, 1)
    times = sorted(r.choice([0, 1, 2, 2.5, 7, 30, 31]) + r.random() for _ in range(60))
    df = spark.createDataFrame([("h", i, start + timedelta(seconds=t)) for i, t in enumerate(times)], "host string, i int, ts timestamp")
    got = [(x.grant_time - start).total_seconds() for x in pacing.grants(df, burst=3, per_second=2.0).orderBy("i").collect()]
    assert all(abs(a - b) < 1e-4 for a, b in zip(got, simulate(times, 3, 2.0), strict=True))


def test_small_rules(spark):
    assert [pacing.backoff_ms(a) for a in (0, 1, 7)] == [1000, 2000, 60_000] and pacing.backoff_ms(0, jitter=-1) == 800 and pacing.requests_per_hour(2, 1000, 3000) == 3600
    df = spark.createDataFrame([(None, 5), (0, 5), (1_000, 1)], "last long, every int")
    assert [r[0] for r in df.select(pacing.missed_windows(F.col("last"), F.col("every"), F.lit(301_000)))  .collect()] == [0, 0, 4]
    with pytest.raises(ValueError):
        pacing.normalise_schedule({"url": "javascript:x", "pipeline": {"steps": [1]}})
    schedule, note = pacing.normalise_schedule({"url": "https://s.test/a", "pipeline": {"steps": [1]}, "everyMinutes": 0.2})
    assert schedule["everyMinutes"] == 1 and schedule["name"] == "s.test" and note
    caps = spark.createDataFrame([("a", i, s) for i, s in enumerate([5, 9, 4, 1, 1])] + [("b", 1, 3)], "run string, i int, n int")
    assert sorted((r.run, r.i) for r in pacing.cap_captures(caps, "run", "i", "n", 3, 10).collect()) == [("a", 0), ("a", 2), ("a", 3), ("b", 1)]


def test_streams(spark, tmp_path):
    source = str(tmp_path / "in")
    rows = [(i, "p", k, datetime(2024, 1, 1) + timedelta(minutes=i)) for i, k in enumerate("abcab")]
    spark.createDataFrame(rows, "seq int, part string, k string, ts timestamp").coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("seq int, part string, k string, ts timestamp").parquet(source)
    for name, out in (("plain", pacing.dedupe_stream(stream, ["k"])), ("late", pacing.dedupe_stream(stream, ["k"], "ts", "1 hour")), ("bounded", pacing.bounded_dedupe_stream(stream, "k", "part", 2))):
        pacing.append_stream(out, str(tmp_path / name), str(tmp_path / f"{name}-c")).awaitTermination(120)
    read = lambda name: sorted(r.seq for r in spark.read.parquet(str(tmp_path / name)).collect())
    assert read("plain") == [0, 1, 2] and read("late") == [0, 1, 2] and read("bounded") == [0, 1, 2, 3, 4]
    q = pacing.event_counts(stream, "ts", ["k"], "2 minutes", "0 seconds").writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").agg(F.sum("n")).first()[0] == 5


def test_ways_to_choose_proxies(spark):
    proxies = spark.createDataFrame([("a", 1, "DE"), ("b", 1, "de"), ("c", 1, None)], "host string, port int, country string")
    requests = spark.createDataFrame([(i, f"s{i % 2}", "DE" if i % 3 else "fr") for i in range(12)], "n int, session string, wants string").repartition(3)
    pick = lambda strategy, **o: {r.n: (r.host, r.session, r.wants) for r in lists.assign_proxies(requests, proxies, "n", strategy, **o).collect()}
    turn = pick("round-robin")
    assert [turn[i][0] for i in range(12)] == list("abc") * 4
    assert pick("random") == pick("random") and len({h for h, _, _ in pick("random").values()}) > 1
    sticky = pick("sticky", key="session")
    assert all(len({h for h, s, _ in sticky.values() if s == one}) == 1 for one in ("s0", "s1"))
    geo = lists.assign_proxies(requests, proxies.withColumnRenamed("country", "country"), "n", "geo", country="wants").collect()
    assert len(geo) == 12 and {r.host for r in geo if r.wants == "DE"} == {"a", "b"} and {r.host for r in geo if r.wants == "fr"} <= {"a", "b", "c"}
    assert {r.host for r in lists.assign_proxies(requests, proxies.limit(0), "n").collect()} == {None}
    with pytest.raises(ValueError):
        lists.assign_proxies(requests, proxies, "n", "sticky")


def test_numbers_over_a_whole_table(spark):
    from rowloom.operators.numbering import numbered

    rows = numbered(spark.range(1000).selectExpr("999 - id AS x").repartition(7), "x", "n").collect()
    assert len(rows) == 1000 and all(r.x == r.n for r in rows)
    assert numbered(spark.range(0), "id", "n").count() == 0


def test_schedules_that_are_due(spark):
    one = {"name": "a", "url": "https://s.test/", "everyMinutes": 5, "pipeline": {"steps": [1]}}
    known, _ = pacing.add_schedule([], one)
    known, _ = pacing.add_schedule(known, one | {"everyMinutes": 9})
    assert len(known) == 1 and known[0]["everyMinutes"] == 9
    for i in range(pacing.MOST_SCHEDULES - 1):
        known, _ = pacing.add_schedule(known, one | {"name": f"b{i}"})
    with pytest.raises(ValueError, match="schedules are taken"):
        pacing.add_schedule(known, one | {"name": "more"})
    minute = 60_000
    table = spark.createDataFrame([("late", 5, True, minute), ("soon", 5, True, 98 * minute), ("off", 5, False, 0), ("busy", 5, True, minute), ("never", 5, True, None)], "name string, every_minutes int, enabled boolean, last_run_ms long")
    got = {r.name: r.missed for r in pacing.due(table, spark.createDataFrame([("busy",)], "name string"), F.lit(100 * minute)).collect()}
    assert got == {"late": 18, "never": 0}


def test_a_host_with_most_requests_is_granted_as_by_simulation(spark):
    import random
    from datetime import datetime, timedelta

    r = random.Random(3)
    start = datetime(2024, 1, 1)
    rows = [(i, r.choice(("hot", "hot", "hot", "cold", None)), start + timedelta(seconds=r.randrange(20_000))) for i in range(800)]
    df = spark.createDataFrame(rows, "i int, host string, ts timestamp")
    got = {x.i: (x.grant_time - start).total_seconds() for x in pacing.grants(df, burst=4, per_second=0.05, order="i", span_s=900).collect()}
    for host in ("hot", "cold", None):
        times = []
        for i, _, ts in sorted((x for x in rows if x[1] == host), key=lambda x: (x[2], x[0])):
            at = (ts - start).total_seconds()
            k = len(times)
            # The token of request k is there 4 requests' refills after some earlier request came.
            want = max(at, max((t + (k - j + 1 - 4) * 20 for j, t in enumerate([*times, at])), default=at))
            times.append(at)
            assert got[i] == want


def test_a_stream_of_pages_asks_for_none_twice(spark, tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    asked = []

    class Pages(BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            n = int(self.path.rpartition("cursor=")[2]) if "cursor=" in self.path else 0
            most = 4 if self.path.startswith("/a") else 2
            body = json.dumps({"items": [{"id": f"{self.path[1]}{n}.{i}"} for i in range(3)], "next": n + 1 if n + 1 < most else None}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(api.ApiDataSource)
    base = f"http://127.0.0.1:{server.server_port}"
    source = spark.readStream.format("rowloom_api").options(url=f"{base}/a {base}/b", rowsPath="items", mode="cursor", cursorPath="next")
    try:
        for _ in range(7):
            # Each run is a new query over the same checkpoint; it takes what comes until it is stopped.
            query = source.load().writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
            query.awaitTermination(60)
            query.stop()
    finally:
        server.shutdown()
    rows = [json.loads(r.row)["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()]
    assert sorted(rows) == sorted([f"a{n}.{i}" for n in range(4) for i in range(3)] + [f"b{n}.{i}" for n in range(2) for i in range(3)])
    assert len(asked) == len(set(asked)) == 6


def test_an_unfinished_batch_is_read_again(spark):
    from rowloom.sources.api import ApiStreamReader

    reader = ApiStreamReader({"url": "http://s.test/x", "mode": "page", "rowspath": "d"})
    given = {"http://s.test/x?page=1": '{"d":[1,2]}', "http://s.test/x?page=2": '{"d":[3]}', "http://s.test/x?page=3": '{"d":[]}'}
    api_fetch, api.read_page.__defaults__ = api.read_page.__defaults__, (lambda url, *_: (200, {}, given[url]), None, None)
    try:
        start, seen = reader.initialOffset(), []
        at = start
        while True:
            rows, end = reader.read(at)
            seen += list(rows)
            if end == at:
                break
            at = end
        assert [r[1:] for r in seen] == [(1, "1"), (1, "2"), (2, "3")]
        assert list(reader.readBetweenOffsets(start, at)) == seen
    finally:
        api.read_page.__defaults__ = api_fetch
