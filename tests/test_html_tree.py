from rowloom.html.tree import parse


def tags(node):
    return [n.tag for n in node.walk()][1:]


def find(node, tag):
    return [n for n in node.walk() if n.tag == tag]


def test_script_text_is_raw_and_comments_vanish():
    doc = parse('<body><script>var t="</p>";</script><!-- a <p> --><p>x</p></body>')
    assert find(doc, "script")[0].text() == 'var t="</p>";'
    assert [p.text() for p in find(doc, "p")] == ["x"]


def test_implied_ends():
    assert [n.text() for n in find(parse("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>"), "li")] == ["a", "bc", "c", "d"]
    assert [n.text() for n in find(parse("<p>a<p>b<div>c</div>d"), "p")] == ["a", "b"]
    rows = find(parse("<table><tr><td>1<td>2<tr><td>3</table>"), "tr")
    assert [[c.text() for c in r.elements()] for r in rows] == [["1", "2"], ["3"]]
    assert [n.text() for n in find(parse("<select><option>a<option>b</select>"), "option")] == ["a", "b"]


def test_unclosed_formatting_opens_again_in_the_next_block():
    doc = parse("<article><p><b>one<br><p>two</p><p>three</p></article>")
    assert [p.text() for p in find(doc, "p")] == ["one", "two", "three"]
    assert [b.text() for b in find(doc, "b")] == ["one", "two", "three"]


def test_attributes_entities_and_odd_markup():
    doc = parse("""<a href='/x?a=1&amp;b=2' CLASS=big data-q="it's" href=no disabled>A &amp; B &copy; &am</a><br/></br>1 < 2""")
    a = find(doc, "a")[0]
    assert a.attrs == {"href": "/x?a=1&b=2", "class": "big", "data-q": "it's", "disabled": ""}
    assert a.text() == "A & B © &am" and doc.text().endswith("1 < 2")
    assert parse(None).children == [] and parse("").children == []
    assert parse("<p>a<!-- never closed").text() == "a"
    assert parse('<a href="x>y').text() in ("", "y", '<a href="x>y')


def test_head_content_stays_out_of_body():
    doc = parse("<html><head><title>T &lt;b&gt;</title><meta charset=utf-8><body><h1>x</h1></html>")
    assert find(doc, "title")[0].text() == "T <b>" and find(doc, "body")[0].text() == "x"


def test_long_broken_pages_take_linear_time():
    parse("<a b='" * 20_000)
    parse("<b>" * 3000 + "x")
    parse("<" * 200_000)
