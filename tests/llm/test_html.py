import re

import pytest

from seqscore.llm.html import extract, main_text

LONG = "This is a long paragraph, with commas, and enough words to be seen as running text by anyone. " * 2
PAGE = f"""<!doctype html><html><head><title>T</title><style>p{{}}</style><script>var a="</p>";</script></head><body class="has-sidebar">
<header class="site"><a href="/">Home</a><p>Site name</p></header><nav><ul><li><a>One</a><li><a>Two</a></ul></nav>
<div class="cookie-notice"><p>We use cookies, and more cookies, you know.</p></div>
<div id="content"><h1>Title &amp; more</h1><p>{LONG}<p>Second,   <b>bold</b>&nbsp;text<br>line.</p>
<div class="ad">Buy, buy, buy, buy, buy!</div><ul><li>First item</li><li>Second item with <a href=x>a link</a> in it</ul>
<table><tr><td>a</td><td>b</td></tr></table><form><p>Your name, please</p></form><blockquote>Said, so.</blockquote>
<ul class=x><li><a>Rel 1</a></li><li><a>Rel 2</a></li><li><a>Rel 3</a></li></ul></div>
<aside><p>{LONG}</p></aside><div class="comments"><p>{LONG} {LONG}</p></div><footer>&copy; 2020, all</footer></body></html>"""


def test_a_page_with_everything():
    text = " ".join(LONG.split())
    assert main_text(PAGE).split("\n") == ["Title & more", text, "Second, bold text line.", "First item", "Second item with a link in it", "a b", "Said, so."]


@pytest.mark.parametrize("html,want", [
    ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>", ""), ("<nav><a>x</a></nav>", ""),
    ("<article><h1>Short</h1><p>Es.</p></article><footer>f</footer>", "Short\nEs."),
    ("<div class=post><p>A, b.</div><div class='comment'><p>Nice, nice, nice, nice</div>", "A, b."),
    ("<article><header><h1>H</h1></header><section><p>One, two.</p></section><section><p>Three.</p></section><p>&lt;b&gt; &#233;</p></article>", "H\nOne, two.\nThree.\n<b> é"),
    ("<main><div class=sidebar><p>" + LONG + "</p></div><p>Only, this.</p></main>", "Only, this."),
    ("<body>" + "<div>" * 3000 + "deep, text" + "</div>" * 3000, "deep, text"),
    ("<p>a</b></i></p></div>b", "a\nb"), ("<article><p>unclosed <b>bold <i>x</article>", "unclosed bold x"),
])
def test_small_pages(html, want):
    assert main_text(html) == want


def test_pages_of_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    import html as h
    want = {}
    for r in pages.collect():  # one known layout: the article is a sequence of h1 and p
        body = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", body.replace("<b>", "").replace("</b>", ""))]
        want[r.page_id] = "\n".join(p for p in parts if p)
    got = {r.page_id: (r.text, r.n_chars) for r in extract(pages).collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}


def test_rows(spark):
    from pyspark.sql import functions as F
    rows = [(1, "u", None), (2, None, "<p>x, y</p>"), (2, None, "<p>x, y</p>"), (None, "u", "<p>" + "long, " * 50_000 + "</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit("clash"))
    out = sorted(extract(df).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert [(r.page_id, r.text[:9], r.n_chars) for r in out] == [(1, "", 0), (2, "x, y", 4), (2, "x, y", 4), (None, "long, lon", 299_999)]
    assert extract(df.limit(0)).count() == 0


def test_deep_nesting_is_linear():
    """Paragraphs in ever deeper boxes: twice the page takes about twice the time."""
    import time

    def seconds(n):
        page = "<div><p>a, b" * n
        main_text(page)
        start = time.process_time()
        main_text(page)
        return time.process_time() - start

    assert seconds(8000) < 3.2 * seconds(4000) + 0.1
