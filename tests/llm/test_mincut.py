import random
import re
from html import unescape
from itertools import product

import pyarrow.parquet as pq

from glyphloom.llm import mincut

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></ul></nav>
<div class="cookie-notice">We use cookies.</div><main><article><header><h1>Title &amp; more</h1></header>
<p>First with <a title="a>b" href="#">link</a> and&nbsp;text.<p>Second<br>line<ul><li>One<li>Two</ul>
<div class="ad">Buy</div><p>Third &lt;b&gt;.</p><form><label>Mail</label></form>
<table><tr><td>a<td>b</table></article><aside>Side</aside>
<section id="comments"><article><p>Nice post! I like it a lot, thank you.</p></article></section></main>
<footer>F</footer><script>if(a<b){"</p><p>no</p>"}</script><!-- <p>never</p> --></body></html>"""


def test_article_page():
    assert mincut.main_text(PAGE) == ("Title & more\nFirst with link and text.\nSecond line\nOne\n"
                                      "Two\nThird <b>.\na\nb")


def test_page_without_landmarks():
    long = "A long sentence with many words goes here. " * 8
    page = (f'<body><div><a href="/">Home</a> <a href="/x">X</a></div><div><h2>Big</h2><p>{long}</p>'
            f"<p>Short.</p><p>{long}</p></div><div>(c) 2020</div>")
    assert mincut.main_text(page) == f"Big\n{long.strip()}\nShort.\n{long.strip()}"


def test_broken_pages():
    for page in ("", "   ", "<", "<p", "</p></div>", "<!-- open", "<script>x", "a<b", "<a href='", "&#0;",
                 "<div>" * 3000 + "deep" + "</div>" * 3000, "<p class='" * 50, "]]>", "<![CDATA[x]]>"):
        assert isinstance(mincut.main_text(page), str)


def test_raw_text_goes_on_to_its_end_tag():
    text = "Main text that is long enough to stand for itself."
    for script in ("for(i=0;i<n;i++){f()}", "if(a<b&&c>d){'</scripty>'}", "x='<p>no</p>';y=a<!--b",
                   "<script>", "'</div>'"):
        page = f"<script>{script}</script ><article><p>{text}</p></article>"
        assert mincut.main_text(page) == text
        assert mincut.main_text(f"<article><p>{text}</p><SCRIPT>{script}</Script></article>") == text
        assert mincut.main_text(f"<article><p>{text}</p><style>{script}") == text
    assert mincut.main_text(f"<textarea><article>x</textarea><article>{text}</article>") == text


def test_names_of_topics_inside_the_article():
    text = "The share price rose by a tenth on Monday, as analysts had expected."
    for name in ("share-price", "search-results-study", "alert-level", "relatedWork"):
        page = f'<article><p>{text}</p><div id="{name}"><p>{text}</p></div><p>{text}</p></article>'
        assert mincut.main_text(page) == "\n".join([text] * 3), name
    for name in ("share", "ad slot", "social-share", "newsletter-box", "related"):
        page = (f'<article><p>{text}</p><div class="{name}"><a href="#">Share</a></div>'
                f"<p>{text}</p></article>")
        assert mincut.main_text(page) == f"{text}\n{text}", name


def test_deep_and_unclosed_pages_take_linear_time():
    import time

    def seconds(page):
        start = time.process_time()
        mincut.main_text(page)
        return time.process_time() - start

    for unit in ("<b>x", "<div>x", "<span><p>x</i>", "<ul><li>x", "<div><li>x</em>"):
        small, large = seconds(unit * 2000), seconds(unit * 16000)
        assert large < 20 * max(small, 0.02), unit


def plain_article(html):
    """The article of a page of the tables, by patterns alone."""
    inner = re.search(r"<article>(.*?)</article>", html, re.S)[1]
    inner = re.sub(r"<(?:script|style)\b.*?</(?:script|style)>|<!--.*?-->", "", inner, flags=re.S)
    inner = re.sub(r"<br>", " ", inner)
    inner = re.sub(r"</?(?:b|i|em|strong|a|span)\b[^>]*>", "", inner)
    lines = (" ".join(unescape(x).split()) for x in re.split(r"<[^>]+>", inner))
    return "\n".join(line for line in lines if line)


def test_whole_pages_equal_the_plain_article():
    rows = pq.read_table("/root/testdata/sf0.1/pages.parquet", columns=["html"])["html"].to_pylist()
    assert len(rows) == 2500
    for html in rows:
        assert mincut.main_text(html) == plain_article(html)


def test_cut_has_least_cost():
    draw = random.Random(2)
    for _ in range(300):
        count = draw.randint(1, 8)
        odds = [draw.uniform(-3, 3) for _ in range(count)]
        edges = [(a, b, draw.uniform(0, 2)) for a, b in (
            (draw.randrange(count), draw.randrange(count)) for _ in range(10)) if a != b]

        def cost(labels):
            return (sum(max(-o, 0) if keep else max(o, 0) for o, keep in zip(odds, labels))
                    + sum(w for a, b, w in edges if labels[a] != labels[b]))

        best = min(map(cost, product((False, True), repeat=count)))
        assert abs(cost(mincut.minimum_cut(odds, edges)) - best) < 1e-9


def test_rows_and_columns(spark):
    rows = [(1, "u", PAGE), (None, None, None), (2, "", ""), (2, "", ""),
            (3, "v", "<article>" + "<p>word &eacute;</p>" * 20_000 + "</article>")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr(
        "*", "'old' text", "7 label")
    found = mincut.extract_pages(pages)
    assert found.columns == ["page_id", "url", "label", "text", "n_chars"]
    got = sorted(found.collect(), key=repr)
    assert len(got) == 5
    by = {r.page_id: r for r in got}
    assert by[None].text == "" and by[2].n_chars == 0 and by[1].text == mincut.main_text(PAGE)
    assert by[3].text == "\n".join(["word é"] * 20_000) and by[3].n_chars == len(by[3].text)
    assert mincut.extract_pages(pages.limit(0)).collect() == []
