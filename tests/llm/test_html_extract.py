import html
import random
import re
import time

from convoy.llm.html_extract import RunWeights, best_run, extract, fit_weights, main_text


def article(page):
    """The article of a page of the test tables, taken from its own markup."""
    inner = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1]
    blocks = re.split(r"</?(?:p|h1)>", inner)
    lines = (" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in blocks)
    return "\n".join(x for x in lines if x)


def test_pages(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    want = {r.page_id: (r.url, article(r.html)) for r in pages.collect()}
    for r in main_text(pages).collect():
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


def test_pages_without_article_markup(spark, sf):
    """Weights come from marked pages; the scan finds the region where the mark is missing."""
    pages = spark.read.parquet(f"{sf}/pages.parquet").collect()
    marked = spark.createDataFrame([(r.page_id, r.url, r.html) for r in pages], "page_id long, url string, html string")
    bare = [(10**6 + r.page_id, r.url, re.sub(r"</?article>", "", r.html)) for r in pages]
    found = {r.page_id: r.text for r in main_text(marked.union(spark.createDataFrame(bare, marked.schema))).collect()}
    same = [found[10**6 + r.page_id] == found[r.page_id] for r in pages]
    assert sum(same) >= 0.95 * len(same)


def test_parts_that_are_left_out():
    page = """<html><head><title>T</title><script>x("<p>no</p>")</script></head><body><header><p>Site header words here</p></header>
    <nav><a href=a>Menu</a></nav><div class="cookie-notice"><p>We use cookies on this site</p></div>
    <article><h1>Head &amp; tail</h1><p>First   line<br>goes on and on until it is a line of some length</p><div class="ad"><p>Buy this now please</p></div><p>Second &lt;line&gt; &eacute;</p>
    <form><p>Sign up here</p><input></form><ul><li>point one</li><li>point two</li></ul><p>Third line is here as well and it has words enough to count</p></article>
    <section class="comments"><p>Reader says something long</p></section><aside><p>More to read</p></aside><footer><p>Imprint words</p></footer></body></html>"""
    assert extract(page, RunWeights()) == "Head & tail\nFirst line goes on and on until it is a line of some length\nSecond <line> é\npoint one\npoint two\nThird line is here as well and it has words enough to count"


def test_broken_pages():
    start = time.time()
    weights = RunWeights()
    for page in ("<p " * 30_000, '<a href="' * 20_000, "<!--" * 30_000, "<p>x" * 30_000, "<div>" * 3_000 + "x", "<" * 30_000, "</p>" * 30_000, "&am &quo &#x110000; &#0;"):
        extract(page, weights)
    assert time.time() - start < 30
    assert extract("", weights) == "" and extract("<script>a", weights) == "" and extract("plain words", weights) == "plain words"


def test_edges(spark):
    rows = [(1, None, None, "x"), (2, "u", "", "x"), (None, "u", "<p>some words here</p>", "x"), (3, "u", "<p>same page</p>", "x"), (3, "u", "<p>same page</p>", "x"), (4, "u", "<p>" + "long " * 50_000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    found = sorted((str(r.page_id), r.text[:20], r.n_chars) for r in main_text(pages).collect())
    assert found == [("1", "", 0), ("2", "", 0), ("3", "same page", 9), ("3", "same page", 9), ("4", "long long long long ", 249_999), ("None", "some words here", 15)]
    assert main_text(spark.createDataFrame([], pages.schema)).count() == 0


def test_learned_weights_keep_links_and_lists_of_articles(spark, sf):
    """The given pages have links and lists only outside of articles."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    weights = fit_weights(pages)
    nav = "<nav><ul><li><a href=/a>Menu</a></li><li><a href=/b>Other</a></li></ul></nav>"
    prose = "<h1>Head line</h1><p>Some words that open it</p><p>Read <a href=r>the full report</a> today, or <a href=s>all of the other and much longer reports</a></p>"
    short = "<ul>" + "".join(f"<li><a href=/{k}>item{k}</a></li>" for k in range(200)) + "</ul>"
    listed = [f"item{k}" for k in range(200)]
    head = ["Head line", "Some words that open it", "Read the full report today, or all of the other and much longer reports"]
    table = "<table><tr><td>cell</td><td><a href=c>linked</a></td></tr></table>"
    for inner, more in ((prose + short, listed), (prose + short + "<p>The end of it</p>", [*listed, "The end of it"]), (prose + table, ["cell", "linked"]), (f"<div>{prose}</div><div>{short}</div>", listed)):
        page = f"<html><body>{nav}<div class=ad>Buy it</div><article>{inner}</article><footer><p>Imprint <a href=i>words</a></p></footer></body></html>"
        assert extract(page, weights) == "\n".join(head + more)
    assert extract("<p>Read <a>the full report</a> today</p>", weights) == extract("<p>Read <a>the full report</a> today</p>", RunWeights()) == "Read the full report today"
    assert extract("<div>A long enough line of words, see <a>report</a></div>", RunWeights()) == "A long enough line of words, see report"


def test_unclosed_inline_tags():
    start = time.time()
    assert extract("<b>" * 30_000 + "x", RunWeights()) == "x"
    assert time.time() - start < 10


def test_stray_tags_take_linear_time():
    start = time.time()
    n = 100_000
    for page in ("<b>x" * n, "<span>" * n + "x</i>" * n, "<b><section>" + "<i>" * n + "x</b>" * n, "<select>x" * n, "<p>" + "<i>x" * n + "<div>y"):
        extract(page, RunWeights())
    assert time.time() - start < 30


def test_formulas_and_drawings_keep_their_words():
    assert extract("<p>Let <math><mi>x</mi>=2</math> be a <svg><text>drawn</text></svg> number</p>", RunWeights()) == "Let x=2 be a drawn number"


def test_unclosed_quotes_end_with_their_tag():
    assert extract('<p>one two <a title="bad quote>three</a> four</p>', RunWeights()) == "one two three four"
    assert extract("<p>one two <a title='bad quote>three</a> four</p>", RunWeights()) == "one two three four"
    assert extract('<p>one two <a title="1 > 0">three</a> four</p>', RunWeights()) == "one two three four"


def test_best_run_against_all_runs():
    dice = random.Random(5)
    for _ in range(500):
        gains = [dice.choice((-3.0, -1.0, -0.5, 0.0, 0.5, 1.0, 2.0)) for _ in range(dice.randrange(14))]
        first, last = best_run(gains)
        sums = [sum(gains[i:j]) for i in range(len(gains)) for j in range(i, len(gains) + 1)]
        assert sum(gains[first:last]) == max(sums, default=0.0)
        assert (first, last) != (0, 0) or max(gains, default=0.0) <= 0
