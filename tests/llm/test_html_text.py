"""Page text: the fixture pages against their article markup, templates by hand, edge cases."""

import re
from html import unescape

import pytest

from sparkmail.llm.html_text import extract, parse, scores, text_at
from tests_support import pages


def article_of(html):
    """The text blocks of a fixture page, whose article has only h1, p, b and br."""
    inside = re.search(r"<article>(.*)</article>", html, re.S)[1]
    blocks = [" ".join(unescape(re.sub(r"<br>|</?b>", lambda m: " " if m[0] == "<br>" else "", x)).split())
              for x in re.split(r"</?(?:p|h1)>", inside)]
    return "\n\n".join(b for b in blocks if b)


def test_fixture_pages(spark):
    rows = pages(spark)
    html = {r.page_id: r.html for r in rows.collect()}
    got = extract(rows).collect()
    assert len(got) == len(html)
    for r in got:
        assert r.text == article_of(html[r.page_id]) and r.n_chars == len(r.text)


ARTICLE = "<h1>On  things</h1><p>First &amp; long paragraph, with words.<p>Second one<br>goes on &#233;.</p><ul><li>point one<li>point two</ul>"
TEXT = "On things\n\nFirst & long paragraph, with words.\n\nSecond one goes on é.\n\npoint one\n\npoint two"


def page(body):
    return f"<!doctype html><html><head><title>t</title><style>p>a{{}}</style></head><body>{body}</body></html>"


def alone(html):
    return text_at(parse(html), None)


def test_templates():
    around = ("<header><a href=/>Home</a> Site name</header><nav class=top><ul><li><a href='/a>b'>A</a><li><a>B</a></ul></nav>",
              "<aside><p>Also read this other long text, which is not part of the article at all.</p></aside>"
              "<div class='cookie-notice'>We use cookies, a lot of them, please accept.</div><footer>&copy; 2024 us</footer>")
    for box in ("article", "main", "div class=content", "div id=main-text", "section", "td"):
        assert alone(page(f"{around[0]}<{box}>{ARTICLE}</{box.split()[0]}>{around[1]}")) == TEXT
    inner = ARTICLE + ("<div class='ad'>Buy now, it is cheap and very good.</div><form>Name <input></form><script>if (a<b) x('<p>no</p>')</script>"
                       "<!-- <p>no</p> --><section id=comments><p>Reader: what a nice article, thank you for that.</p></section>")
    assert alone(page(f"{around[0]}<article>{inner}</article>{around[1]}")) == TEXT


def test_consensus_decides(spark):
    """A page that by itself would be read in a wider container is read in that of its host."""
    rows = [(i, f"https://a.example/{i}", page(f"<div class='post p{i}'><p>{'good words ' * 30}{i}</p></div>"))
            for i in range(8)]
    odd = page("<div class='post p77'><p>short text</p></div><div class=extra><p>" + "teaser that is long " * 40 + "</p></div>")
    rows += [(100, "https://A.example/x", odd), (101, "https://b.example/x", odd), (102, None, odd)]
    got = {r.page_id: r.text for r in extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].startswith("good words") and got[3].endswith("3")
    assert got[100] == "short text"
    assert "teaser" in got[101] and got[102] == got[101]


def test_edge_cases(spark):
    html = [None, "", "plain text", "a < b &lt; c", "<p>one<p>two", "<div>" * 30_000 + "deep" + "</div>" * 30_000, "<div><section>" * 20_000 + "deeper",
            "<script>never closed", "<!-- open", "</p></div>x", "<a href=x>only link</a>", "&#x1F600;&nbsp;x", "<p " + 'a="' * 5000, "<p>" + "long " * 300_000]
    rows = [(i, "http://h/", h, "x") for i, h in enumerate(html)] + [(None, None, "<p>t</p>", "x")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert [got[i] for i in range(5)] == ["", "", "plain text", "a < b < c", "one\n\ntwo"]
    assert got[5] == "deep" and got[6] == "deeper" and got[7] == got[8] == "" and got[9] == "x" and got[11] == "\U0001F600 x"
    assert len(got[13]) == 5 * 300_000 - 1 and got[None] == "t"
    assert extract(df).count() == len(rows) and extract(df.limit(0)).count() == 0


def test_scores_are_shares():
    p = parse(page("<nav>menu</nav><article><p>text here</p></article>"))
    found = scores(p)
    assert {p.path(i) for i in found} == {"html>body>article"} and all(0 < s <= 1 for s in found.values())


@pytest.mark.parametrize("shape", ["<div class='x", "<a ", "<!x", "<div aaaa", "<a \"", "<p x='\">", "</", "<script", "<div class=\"a b'"])
def test_malformed_pages_take_time_in_proportion(shape):
    import time

    start = time.time()
    parse(shape * (2_000_000 // len(shape)))
    assert time.time() - start < 20


def test_markup_characters_inside_quotes_stay_in_the_tag():
    page = parse('<div title="a > b" data-x=\'<b>\'><p>one <br/>two</p></div>')
    assert [b[0] for b in page.blocks] == ["one two"]
