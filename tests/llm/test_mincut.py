import itertools
import math
import random
import re
import time
from html import unescape

from rowloom.html.tree import parse
from rowloom.llm import mincut, registry
from rowloom.llm.layouts import layout


def test_minimum_cut_equals_brute_force():
    r = random.Random(3)
    for _ in range(300):
        n = r.randrange(1, 9)
        gain = [r.uniform(-3, 3) for _ in range(n)]
        links = [(a, b, r.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if r.random() < 0.5]
        cost = lambda x: sum(math.log1p(math.exp(-g if k else g)) for g, k in zip(gain, x, strict=True)) + sum(w for a, b, w in links if x[a] != x[b])  # noqa: B023, E731
        best = min(cost(x) for x in itertools.product((True, False), repeat=n))
        assert abs(cost(mincut.minimum_cut(gain, links)) - best) < 1e-4


def brute(html):
    """The article's blocks of the driver's pages, cut by regular expressions."""
    article = re.search(r"<article>(.*)</article>", html, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", article)
    plain = (" ".join(unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in parts)
    return "\n\n".join(p for p in plain if p)


def test_query_equals_brute_force(spark):
    for sf in ("0.001", "0.01"):
        d = f"/root/testdata/sf{sf}"
        html = {r.page_id: r.html for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
        got = registry.QUERIES["op7_html_extraction"](spark, d).collect()
        assert len(got) == len(html)
        for r in got:
            assert r.text == brute(html[r.page_id]) and r.n_chars == len(r.text)


PAGE = """<html><head><title>T</title></head><body><header class="site"><a href=/>Home</a> Big site</header>
<div id="cookie-notice">We use cookies to make this page better for every one of its readers, always.</div>
<div class="menu"><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></div><main><article class="post comments-open">
<header><h1>Title &amp; more</h1></header><p>First   paragraph with <a href=x>a link</a>,<br>and a break.<p>Short.
<div class="ad-slot">Buy the finest things now, at a price that nobody can ever beat. Really.</div>
<form><label>Mail</label><input value=x><p>Subscribe to our long and weekly letter now.</p></form>
<ul><li>item one of the article</li><li>item two</li></ul><pre>code</pre><script>x("<p>no</p>")</script><p hidden>secret</p>
<section id="comments"><article class="comment"><p>A reader says something at great length about this article, as readers do.</p></article></section>
</article></main><aside class="sidebar"><p>Other stories that you may like to read today, all of them quite long.</p></aside>
<footer>&copy; 2024</footer></body></html>"""


def test_furniture_goes_and_content_stays():
    got, _ = mincut.main_blocks(PAGE)
    assert got == ["Title & more", "First paragraph with a link, and a break.", "Short.", "item one of the article", "item two", "code"]
    plain = "<body><div class=nav><a href=1>x</a></div><div><p>Some text that is long enough to be taken for content on its own merits.</p><p>Tiny.</p></div></body>"
    assert mincut.main_blocks(plain)[0] == ["Some text that is long enough to be taken for content on its own merits.", "Tiny."]


def test_other_layouts():
    page = """<body><a class="skiplink" href="#m">Skip to content</a><div id="page-header"><span>Site</span></div><div class="left-sidebar"><p>A sidebar paragraph that goes on for quite a while about other things.</p></div>
    <div id="m" class="post-body"><h2>Heading</h2>Loose text of the article, not in any paragraph at all, but long enough.<p>One.</p><div class="cookieConsent notice">We value your privacy more than anything else in the world, so please agree.</div>
    <blockquote>Quoted.</blockquote><table><tr><td>cell a</td><td>cell b</td></tr></table><p>See <a href="/x">this link</a> and <span class="ad">an inline mark</span>.</p><ul><li><a href="/r">A reference</a></li></ul></div>
    <section class="related-posts"><h3>Related</h3><p>Another story entirely, with a long teaser text that would look like content.</p></section><div id="disqus_thread"><p>I think this article is great and I have much to say about it, said a reader.</p></div>
    <div role="contentinfo">Imprint</div></body>"""
    got = mincut.main_blocks(page)[0]
    assert got[:3] == ["Heading", "Loose text of the article, not in any paragraph at all, but long enough.", "One."]
    assert "Quoted." in got and "See this link and an inline mark." in got and not any(w in " ".join(got) for w in ("sidebar", "privacy", "Related", "story", "reader", "Imprint", "Skip", "Site"))
    listed = "<article><h1>T</h1><p>Text.</p><ul><li><a href=1>First link</a></li><li><a href=2>Second link</a></li></ul><p>End.</p></article>"
    assert mincut.main_blocks(listed)[0] == ["T", "Text.", "First link", "Second link", "End."]


def test_edge_rows(spark):
    long = "<article>" + "<p>word word</p>" * 20_000 + "</article>"
    rows = [(1, "u", None, 1), (2, None, "", 1), (None, "u", "<nav>only</nav>", 1), (4, "u", long, 1), (4, "u", long, 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    got = {(r.page_id, r.n_chars) for r in mincut.main_text(df).collect()}
    assert got == {(1, 0), (2, 0), (None, 0), (4, 20_000 * 11 - 2)}
    assert mincut.main_text(df.limit(0)).count() == 0


def test_furniture_words_in_articles_are_costs():
    long = "The parts of this text say a good deal about the matter that they are named for, and they go on saying it well past a line or two of it."
    page = f"""<article><h1>T</h1><p>{long}</p><h2 id="related-work">Related work</h2><p>{long}</p><section id="discussion"><h2>Discussion</h2><p>{long}</p><p>Short end.</p></section>
    <div class="notice"><p>{long}</p></div><div class="disclaimer">{long}</div><p>{long}</p><ul class="related"><li><a href=1>One</a></li><li><a href=2>Two</a></li></ul>
    <div class="share"><a href=3>Share this</a></div><div class="ad">Buy now.</div><p>End.</p></article>"""
    assert mincut.main_blocks(page)[0] == ["T", long, "Related work", long, "Discussion", long, "Short end.", long, long, long, "End."]
    # The same words outside of an article or main, and furniture by tag or role inside, stay out at any length.
    assert mincut.main_blocks(f'<article><p>{long}</p><aside>{long}</aside><div role="search">{long}</div></article><div class="notice">{long}</div>')[0] == [long]


def test_neighbours_outvote_a_furniture_word():
    text = "x" * 100
    assert mincut.main_blocks(f'<article><p class="notice">{text}</p></article>')[0] == []
    assert mincut.main_blocks(f'<article><p>{text}</p><p class="notice">{text}</p><p>{text}</p></article>')[0] == [text] * 3


def test_cut_mends_the_classifier_on_held_out_layouts():
    weight = mincut.weights()
    wrong_alone = wrong = changed = whole_alone = whole = n = 0
    for seed in range(50_000, 50_250):
        html, content = layout(seed)
        found = mincut.blocks(parse(html))
        gain = [mincut.score(b, weight) for b in found]
        cut = mincut.minimum_cut(gain, mincut.edges(found))
        truth = [b.text in set(content) for b in found]
        wrong_alone += sum((g >= 0) != t for g, t in zip(gain, truth, strict=True))
        wrong += sum(c != t for c, t in zip(cut, truth, strict=True))
        changed += sum((g >= 0) != c for g, c in zip(gain, cut, strict=True))
        whole_alone += [g >= 0 for g in gain] == truth
        whole += cut == truth
        n += len(found)
    assert changed > n / 100 and wrong < 0.7 * wrong_alone and wrong < 0.05 * n and whole > 1.3 * whole_alone


def test_short_lines_follow_their_article_and_long_notices_their_page():
    weight, long = mincut.weights(), "This line goes on for as long as a paragraph does, and says things in whole sentences, as one would. " * 2
    lone = mincut.blocks(parse("<div><li><a href=1>One</a></li></div>"))
    assert mincut.score(lone[0], weight) < 0
    page = f"<div><p>{long}</p><ul><li>a</li></ul><h2>b</h2><p>{long}</p></div>"
    assert mincut.main_blocks(page)[0] == [long.strip(), "a", "b", long.strip()]


def test_long_mixed_pages_take_little_time():
    page = "<div>" + "<p>A paragraph of the text that is long enough to count as one, surely.</p><ul><li><a href=1>x</a></li></ul>" * 4000 + "</div>"
    began = time.process_time()
    assert mincut.main_blocks(page)[1] == 8000
    assert time.process_time() - began < 20


def test_mathematics_is_text():
    page = "<article><p>Where <math><mrow><mi>a</mi><mo>=</mo><msup><mi>b</mi><mn>2</mn></msup></mrow><annotation>a=b^2</annotation></math> holds.</p></article>"
    assert mincut.main_blocks(page)[0] == ["Where a=b2 holds."]


def test_inline_attributes_hide_nothing_from_readers():
    page = "<article><p>The price is <span aria-hidden='true'>five euros</span> in all shops, and it stays so until the end of the year.</p></article>"
    assert mincut.main_blocks(page)[0] == ["The price is five euros in all shops, and it stays so until the end of the year."]
    unseen = "<article><p>All of this text is seen by readers of the page<b hidden> and this is not</b><i style='display: none'> nor this</i>.</p></article>"
    assert mincut.main_blocks(unseen)[0] == ["All of this text is seen by readers of the page."]


def test_any_column_names(spark):
    df = spark.createDataFrame([(1, "<p>One plain paragraph of the page.</p>", "a", "b", 5)], "page_id int, html string, Text string, `a.b` string, N_chars int")
    out = mincut.main_text(df)
    assert out.columns == ["page_id", "a.b", "text", "n_chars", "n_blocks", "n_content"] and out.first()["a.b"] == "b"
