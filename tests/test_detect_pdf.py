import json
import zlib

import pytest

from rowloom.html.detect import detect
from rowloom.html.tree import parse
from rowloom.sources import pages as S
from rowloom.sources import pdf

CARDS = "<body><nav><a>a</a><a>b</a><a>c</a></nav><div>" + "".join(
    f'<article class="s-item"><a class="s-item__link" href="/p/{i}"><img src="/i{i}.png"></a><h3 class="s-title">Item {i}</h3><span class="price">${i}.00</span><i class="rating" aria-label="{i} stars"></i><b class="badge">same</b></article>' for i in range(1, 5)
) + "</div></body>"


def test_cards():
    best = detect(parse(CARDS))["candidates"][0]
    assert best["selector"] == ".s-item" and best["count"] == 4
    names = {f["name"]: f for f in best["fields"]}
    assert {"item link url", "title", "price", "rating"} <= set(names) and names["rating"]["attribute"] == "aria-label" and names["price"]["coverage"] == 100
    assert not any(f["samples"][0] == "same" for f in best["fields"])
    assert best["sampleRows"][1]["price"] == "$2.00"


def test_table_headers():
    rows = "".join(f"<tr><td>{n}</td><td><a href=/{n}>{n} page</a></td><td>EU</td></tr>" for n in "abcd")
    best = detect(parse(f"<table><thead><tr><th>Name</th><th>Link</th><th>Region</th></tr></thead><tbody>{rows}</tbody></table>"))["candidates"][0]
    assert best["count"] == 4 and [f["name"] for f in best["fields"]] == ["name", "link", "link url", "region"]
    plain = detect(parse(f"<table><tr><th>Name</th><th>Link</th><th>Region</th></tr>{rows}</table>"))["candidates"][0]
    assert plain["count"] == 4 and plain["fields"][0]["name"] == "name"
    assert detect(parse("<ul><li>a<li>b</ul>"))["candidates"] == [] and detect(parse(""))["candidates"] == []


def test_detect_operator(spark):
    df = spark.createDataFrame([(1, "u", CARDS), (2, "u", None)], "page_id int, url string, html string")
    rows = S.detect_tables(df).collect()
    assert [(r.page_id, r.rank, r.selector) for r in rows] == [(1, 1, ".s-item")] and json.loads(rows[0].fields)


def item(x, y, text):
    return {"x": x, "y": y, "text": text}


def test_grid():
    items = [item(72, 700, "Name"), item(200, 700, "Price"), item(72, 680, "Widget"), item(200, 680, "10.00"), item(75, 660.5, "Gadget"), item(196, 661, "20.00")]
    assert pdf.grid(items) == [["Name", "Price"], ["Widget", "10.00"], ["Gadget", "20.00"]]
    assert pdf.table_records([{"page": 1, "items": items}]) == [{"Name": "Widget", "Price": "10.00", "_page": "1"}, {"Name": "Gadget", "Price": "20.00", "_page": "1"}]
    assert pdf.grid([item(0, 10, "a   b"), item(0, 0, "c  d")]) == [["a", "b"], ["c", "d"]]
    assert pdf.grid([]) == [] and pdf.table_records([{"page": 1, "items": [item(0, 1, "a"), item(50, 1, "b")]}], has_header=False, include_page=False) == [{"col1": "a", "col2": "b"}]


def make_pdf(content, squeeze=False, extra=b""):
    body = zlib.compress(content) if squeeze else content
    kind = b"/Filter /FlateDecode " if squeeze else b""
    return b"%PDF-1.4\n1 0 obj\n<< " + kind + b"/Length %d >>\nstream\n" % len(body) + body + b"\nendstream\nendobj\n" + extra


CONTENT = rb"BT /F1 12 Tf 72 700 Td (Name) Tj 128 0 Td (Pri\143e \(x\)) Tj ET BT 1 0 0 1 72 680 Tm [(Wid) -20 (get)] TJ 14 TL T* (next) Tj ET"


@pytest.mark.parametrize("squeeze", [False, True])
def test_text(squeeze):
    done = pdf.read_pdf(make_pdf(CONTENT, squeeze))
    assert done["pages"][0]["items"] == [item(72, 700, "Name"), item(200, 700, "Price (x)"), item(72, 680, "Widget"), item(72, 666, "next")]
    assert done["pages"][0]["text"] == "Name Price (x) Widget next" and not done["warnings"] and not done["truncated"]


def test_maps_notes_and_errors():
    cmap = make_pdf(b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0003> <0042> endbfrange")[9:]
    assert pdf.read_pdf(make_pdf(b"BT <000100020003> Tj ET", extra=cmap))["pages"][0]["text"] == "ABC"
    unknown = pdf.read_pdf(make_pdf(b"BT <0001000200030004> Tj ET"))
    assert unknown["pages"][0]["note"] == pdf.NOTE_GLYPHS and unknown["warnings"] == [pdf.NO_MAP]
    assert pdf.read_pdf(b"%PDF-1.4\n")["warnings"] == [pdf.NO_TEXT]
    for bad, words in ((b"hello", "lack the %PDF- mark"), (b"%PDF-1.4 /Encrypt 5 0 R", "locked by encryption")):
        with pytest.raises(pdf.PdfError, match=words):
            pdf.read_pdf(bad)


def test_pdf_operators(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("a.pdf", bytearray(make_pdf(CONTENT))), ("b.pdf", bytearray(b"x")), ("c.pdf", None)], "path string, content binary")
    got = {r.path: r for r in pdf.extract_pdf(df).collect()}
    assert got["a.pdf"].page_count == 1 and got["b.pdf"].error and got["c.pdf"].error
    pages = pdf.extract_pdf(df).select("path", F.explode("pages").alias("p")).select("path", "p.page", "p.items")
    assert [json.loads(r.record) for r in pdf.tables(pages).collect()][0] == {"Name": "Widget", "Price (x)": "", "_page": "1"}


def test_equal_records_are_compared_once(monkeypatch):
    """A table of many rows alike costs a comparison a shape, not a row."""
    from rowloom.html import detect as D

    calls, real = [], D.likeness
    monkeypatch.setattr(D, "likeness", lambda a, b: calls.append(1) or real(a, b))
    rows = "".join(f"<tr><td>{i}</td><td>c{i}</td></tr>" for i in range(200))
    assert [len(s) for s in D.record_sets(parse(f"<table><tbody>{rows}<tr><td>x</td></tr></tbody></table>"))] == [200]
    assert len(calls) <= 6
