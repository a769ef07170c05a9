import pytest
from pyspark.sql import functions as F

from rowloom.functions import predicates as P
from rowloom.functions import similarity as S
from rowloom.functions import transforms as T
from rowloom.functions.js import number_text

NUMBERS = [
    ("1.234,56 €", 1234.56), ("€ 9,99", 9.99), ("1.4E7", 1.4e7), ("3 EUR", 3), ("Section 4E", 4), ("Out of stock", None), ("$25.50", 25.5), ("1,234 reviews", 1234), ("1.234", 1234), ("1,234,567.89", 1234567.89),
    ("1 234 567", 1234567), ("-5", -5), ("", None), (None, None), ("9e999", 9.0), ("abc 5e3", 5000), ("1.2,3.4", None), ("12-34", 12), ("1 299,00", 1299), ("2,5e3", 2500),
]


def column(spark, values, build, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", build(F.col("v"))).collect())]


def test_number(spark):
    got = column(spark, [t for t, _ in NUMBERS], T.number)
    want = [w for _, w in NUMBERS]
    assert got == want


def test_trim_and_chain(spark):
    assert column(spark, ["  a \n\t b ﻿c ", None, ""], lambda c: T.apply_transform(c, "trim")) == ["a b c", None, ""]
    assert column(spark, [" Price: 1,299.00 USD ", "sold out"], lambda c: T.apply_transforms(c, ["trim", "number"])) == [1299.0, None]
    assert column(spark, ["12", "sold out"], lambda c: T.apply_transforms(c, ["number", "upper"])) == ["12", None]
    with pytest.raises(ValueError, match="Unknown value transform"):
        T.apply_transform(F.lit("x"), "nope")


@pytest.mark.parametrize(
    "pattern,flags,group,text,want",
    [
        (r"SKU: (\S+)", "", None, "SKU: ABC-123", "ABC-123"), (r"(\d+)", "", 2, "12", None), (r"(a+)+$", "", None, "aaa", None), (r"\d+", "", None, "x 42", "42"), (r"x(\d)?", "", None, "xa", None),
        (r"ABC", "i", None, "xabc", "abc"), (r"(a)(b)", "", 0, "zab", "ab"), (r"(a)(b)", "", 2, "zab", "b"), ("(", "", None, "(", None), (r"^b$", "m", None, "a\nb", "b"), (r"a.b", "s", None, "a\nb", "a\nb"), (r"\bé", "", None, "xé", "é"),
    ],
)
def test_regex(spark, pattern, flags, group, text, want):
    assert column(spark, [text, None], lambda c: T.regex(c, pattern, flags, group)) == [want, None]


def test_regex_refuses_long_input(spark):
    assert column(spark, ["7" + "a" * 20_000, "7" + "a" * 19_999], lambda c: T.regex(c, r"\d")) == [None, "7"]


def test_base64(spark):
    values = ["SGVsbG8gd29ybGQ=", "SGVsbG8gd29ybGQ", "VGhpcw", "Total: 42", "abc", "_-8=", "gICA", "", None, "SGk=\n"]
    assert column(spark, values, T.base64) == ["Hello world", "Hello world", "This", None, None, None, None, None, None, "Hi"]


def test_url(spark):
    base = "https://Shop.test/a/b?x=1"
    cases = {"/p/123": "https://shop.test/p/123", "../x": "https://shop.test/x", "HTTP://E.com": "http://e.com/", "": "", "a b": "https://shop.test/a/a%20b", "?q=1": "https://shop.test/a/b?q=1", "//c.d/e": "https://c.d/e", "https://x.y:443/z": "https://x.y/z", "mailto:a@b": "mailto:a@b"}
    assert column(spark, list(cases), lambda c: T.url(c, base)) == list(cases.values())
    assert column(spark, ["not a url", None], lambda c: T.url(c)) == ["not a url", None]


def test_form_fill(spark):
    assert column(spark, ["o'neil mcDonald"], T.FORM_TRANSFORMS["title-case"]) == ["O'Neil McDonald"]
    assert column(spark, ["<b>x</b>"], T.FORM_TRANSFORMS["strip-html"]) == ["x"]
    assert column(spark, ["YES", "no"], T.FORM_TRANSFORMS["boolean"]) == [True, False]
    assert column(spark, ["42", "123456"], T.FORM_TRANSFORMS["pad-zero-5"]) == ["00042", "123456"]
    assert column(spark, ["$1,234.5"], T.FORM_TRANSFORMS["parse-number"]) == [1234.5]
    assert column(spark, ["2024-03-05", "rubbish"], T.FORM_TRANSFORMS["iso-date"]) == ["2024-03-05", "rubbish"]


def test_number_text(spark):
    values = [25.0, 0.1, -3.5, 1e21, 1.5e-7, 123456789012345680.0, 0.0, 1e7, 12345678.9, 1e-5]
    assert column(spark, values, number_text, "double") == ["25", "0.1", "-3.5", "1e+21", "1.5e-7", "123456789012345680", "0", "10000000", "12345678.9", "0.00001"]


CONDITIONS = [
    ("exists", "", {"a": True, None: False}), ("not-exists", "", {"a": False, None: True}), ("is-empty", "", {"  ": True, "a": False, None: True}), ("not-empty", "", {" ": False, "a": True, None: False}),
    ("text-equals", " a  b ", {"a \n b": True, "A b": False, None: False}), ("text-contains", "b c", {"a b  c d": True, "bc": False}), ("text-matches", r"^\d+$", {" 12 ": True, "1a": False, None: False}),
    ("number-equals", "25.5", {"$25.50": True, "25": False, "Out of stock": False, None: False}), ("number-gt", "", {"1": True, "0": False, "none": False}), ("number-lt", "50", {"$25.50": True, "Out of stock": False}),
]


@pytest.mark.parametrize("name,value,cases", CONDITIONS)
def test_conditions(spark, name, value, cases):
    assert column(spark, list(cases), lambda c: P.condition(name, P.observed(c), value)) == list(cases.values())


def test_condition_attributes_second_elements_and_errors(spark):
    df = spark.createDataFrame([("$9", "$10", " x "), ("$11", "$10", None), ("none", None, "xy")], "a string, b string, t string")
    o, other = P.observed(F.col("a"), attr=F.col("t")), P.observed(F.col("b"))
    rows = df.select(P.condition("number-lt", o, other=other), P.condition("attr-equals", o, "x"), P.condition("attr-contains", o, "y"), P.condition("attr-exists", o)).collect()
    assert [tuple(r) for r in rows] == [(True, True, False, True), (False, False, False, False), (False, False, True, True)]
    for name, value in (("number-gt", "cheap"), ("text-matches", "("), ("unheard", "")):
        with pytest.raises(ValueError):
            P.condition(name, P.observed(F.lit("x")), value)


def test_assertions(spark):
    df = spark.createDataFrame([(0, None), (1, " a b "), (3, "c")], "n long, t string")
    ask = lambda name, **k: [r[0] for r in df.select(P.assertion(name, F.col("n"), F.col("t"), ".x", **k)).collect()]
    assert ask("exists") == ['nothing on the page matches ".x"', None, None]
    assert ask("not-exists") == [None, '1 element still match ".x", and none were expected', '3 elements still match ".x", and none were expected']
    assert ask("count-at-least", wanted="1") == ['expected at least 1 element matching ".x", found 0', None, None]
    assert ask("count-equals", wanted=3) == ['expected exactly 3 elements matching ".x", found 0', 'expected exactly 3 elements matching ".x", found 1', None]
    assert ask("text-contains", value="b") == ['nothing on the page matches ".x"', None, '".x" reads "c", which does not contain "b"']
    assert ask("text-equals", value="a b") == ['nothing on the page matches ".x"', None, '".x" reads "c", not "a b"']
    with pytest.raises(ValueError):
        ask("count-equals", wanted="many")


def test_capture_filter(spark):
    df = spark.createDataFrame([("https://A.test/API/1", "get"), ("https://b.test/x.PNG", "POST"), (None, None)], "u string, m string")
    ask = lambda *a: [r[0] for r in df.select(P.capture_filter(F.col("u"), F.col("m"), *a)).collect()]
    assert ask("api, zzz") == [True, False, False] and ask("re:/API/") == [True, False, False] and ask("re:/api/") == [False, False, False]
    assert ask("", "GET post") == [True, True, False] and ask("") == [True, True, True]
    assert [r[0] for r in df.select(P.capture_noise(F.col("u"), F.lit(None).cast("string"))).collect()] == [False, True, True]
    with pytest.raises(ValueError):
        ask("re:(")


def test_schema_mapping(spark):
    df = spark.createDataFrame([(["@type", "datePublished", "headline", "author", "age"],)], "k array<string>")
    got = df.select(S.map_to_schema(F.col("k"), ["published date", "Headline", "author name", "zzz"])).first()[0]
    assert [(r.field, r.key) for r in got][:2] == [("published date", "datePublished"), ("Headline", "headline")] and got[3].key is None
    only_one = df.select(S.map_to_schema(F.array(F.lit("price")), ["price", "originalPrice"])).first()[0]
    assert [r.key for r in only_one] == ["price", None]
    assert S.parse_schema("a, b\nA,1x,") == (["a", "b"], False, ["1x"]) and S.parse_schema("")[1]
    sims = df.select(S.jaccard(S.tokens(F.lit("productName")), S.tokens(F.lit("product_name"))), S.levenshtein_similarity(F.lit(" ABC "), F.lit("abd")), S.jaccard(S.tokens(F.lit("")), S.tokens(F.lit("")))).first()
    assert sims[0] == 1.0 and abs(sims[1] - 2 / 3) < 1e-12 and sims[2] == 1.0
