import pytest
from pyspark.sql import functions as F

from rowloom.operators import robots
from rowloom.operators.dedupe import SeenKeys, keep_bounded, map_row_key
from rowloom.sinks import datasets, render


def test_formats(spark):
    df = spark.createDataFrame([(1, 'a,"b"', 0, False, None), (2, "x\ty|z\n", 25, True, 1.0)], "seq int, t string, `2nd` int, ok boolean, d double")
    assert render.render_text(df, "csv", "seq") == 't,2nd,ok,d\r\n"a,""b""",0,false,\r\n"x\ty|z\n",25,true,1\r\n'
    assert render.render_text(df, "tsv", "seq") == 't\t2nd\tok\td\na,"b"\t0\tfalse\t\nx y|z \t25\ttrue\t1\n'
    assert render.render_text(df, "markdown", "seq").splitlines()[3] == "| x\ty\\|z  | 25 | true | 1 |"
    assert "<_2nd>25</_2nd>" in render.render_text(df, "xml", "seq") and "&quot;b&quot;" in render.render_text(df, "xml", "seq")
    assert render.render_text(df, "jsonl", "seq").splitlines()[0] == '{"t":"a,\\"b\\"","2nd":0,"ok":false,"d":null}'
    empty = df.limit(0)
    assert render.render_text(empty, "csv", "seq") == "" and render.render_text(empty, "json", "seq") == "[]"
    with pytest.raises(ValueError):
        render.render_text(df, "xlsx", "seq")
    assert render.default_filename("markdown", "x") == "x.md"


def test_files_and_datasets(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "i int, v string")
    root, out = str(tmp_path / "sets"), str(tmp_path / "out")
    assert datasets.append(df, root, "My set", cap=15) == {"added": 10, "dropped": 0, "total": 10}
    assert datasets.export_appended(df.limit(3), root, "My set", "csv", out) == {"added": 3, "dropped": 0, "total": 13}
    assert spark.read.option("header", True).csv(out).count() == 13
    assert datasets.append(df, root, "My set", cap=15) == {"added": 2, "dropped": 8, "total": 15}
    with pytest.raises(ValueError):
        datasets.export_appended(df, root, "x", "xml", out)
    assert datasets.dataset_name("../a/b\x00 ") == "_a_b_" and datasets.dataset_name(" .. ") == "default" and len(datasets.dataset_name("x" * 90)) == 60
    names = spark.createDataFrame([("../../etc/passwd",), ("a:b?.jpg. ",), (None,)], "n string")
    assert [r[0] for r in names.select(datasets.safe_segment(F.col("n"))).collect()] == ["etc_passwd", "a_b_.jpg", ""]


def test_seen_keys_forget_the_oldest(spark):
    s = SeenKeys(3)
    assert [s.add(k) for k in "abcdab"] == [True, True, True, True, True, True] and s.forgotten == 3
    rows = [(i, "p", k) for i, k in enumerate("abcab")] + [(10 + i, "q", k) for i, k in enumerate("aabb")]
    df = spark.createDataFrame(rows, "seq int, part string, k string")
    got = sorted(r.seq for r in keep_bounded(df, "seq", ["k"], 2, "part").collect())
    assert got == [0, 1, 2, 3, 4, 10, 12]


def test_absent_null_and_empty_are_three_facts(spark):
    df = spark.sql("SELECT * FROM VALUES (map('a', CAST(NULL AS STRING))), (map('a', '')), (map('b', 'x')), (map('a', '  X  y')), (map('a', 'x Y')) t(m)")
    keys = [r[0] for r in df.select(map_row_key(F.col("m"), ["a"])).collect()]
    assert len(set(keys)) == 4 and keys[3] == keys[4]


ROBOTS = """User-agent: a
User-agent: b
Disallow: /x
Allow: /x/y
Crawl-delay: 2
User-agent: *
Disallow: /*.pdf$
Disallow:
Disallow: /a$b/

Disallow: /ignored
Sitemap: https://s.test/map.xml
"""


def test_robots(spark):
    parsed = robots.parse_robots(ROBOTS)
    assert parsed["crawl_delay"] == 2 and parsed["sitemaps"] == ["https://s.test/map.xml"] and ("*", "/ignored", False) not in parsed["rules"]
    df = spark.createDataFrame([(p,) for p in ("/x", "/x/y/z", "/f.pdf", "/f.pdf?q", "/a$b/c", "/ignored", "/")], "p string")
    ask = lambda agent: [r[0] for r in df.select(robots.allowed(F.col("p"), parsed["rules"], agent)).collect()]
    assert ask("A") == [False, True, True, True, True, True, True]
    assert ask("zzz") == [True, True, False, True, False, True, True]
    tie = robots.parse_robots("User-agent: *\nDisallow: /p\nAllow: /p")["rules"]
    assert df.limit(1).select(robots.allowed(F.lit("/p"), tie)).first()[0] is True
    urls = spark.createDataFrame([(i, "h", p) for i, p in enumerate(["/x", "/x/y", "/f.pdf"])] + [(9, "other", "/x")], "url_id int, host string, path string")
    rules = spark.createDataFrame([("h", *r) for r in parsed["rules"]], "host string, agent string, path string, allow boolean")
    got = {r.url_id: r.allowed for r in robots.allowed_by_host(urls, rules, agent="a").collect()}
    assert got == {0: False, 1: True, 2: True, 9: True}
