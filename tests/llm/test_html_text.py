import re
from html import unescape

from rillhouse.llm import html_text as H


def test_cases():
    assert H.main_text(None) == H.main_text("") == H.main_text("<html><body></body></html>") == ""
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="</p><article>";</script></head><body>
    <header>Site <a href=/>Home</a></header><nav><ul><li>Menu</li></ul></nav><!-- ad <p>no</p> --><div class="ad">Buy</div>
    <article><header><h1>Head &amp; line</h1><span>by me</span></header><p><b>One  two
    three.<br><p>Short.</p><ul><li>a<li>b</ul><div class="cookie-notice">Cookies</div><form><label>Mail</label><input></form>
    <p>x &lt;tag&gt; &eacute;&#233; 5 < 6 &amp;amp; </p><section id="comments"><p>Reader says</p></section><footer>end</footer></article>
    <aside>Side</aside><div id=sidebar><p>more</p></div><footer>&copy; x</footer></body>"""
    assert H.main_text(page) == "Head & line\nOne two three.\nShort.\na\nb\nx <tag> éé 5 < 6 &amp;"
    assert H.main_text("<p>only one short line") == "only one short line"
    plain = "<div class=menu><a href=1>Home</a> <a href=2>News</a></div>" + "<div><a href=3>link</a></div>" * 5 + "<p>" + "long text here. " * 20 + "</p><p>tail.</p>" + "<div><a href=4>other</a></div>" * 5
    assert H.main_text(plain) == ("long text here. " * 20).strip() + "\ntail."
    assert H.main_text("<article><p>" + "w " * 100000 + "</p></article>") == ("w " * 100000).strip()


def test_only_boilerplate_goes():
    text = "<article><p>Text of the article.</p></article>"
    for wrap in ('<div class="content has-sidebar">', '<div class="no-sidebar">', '<div id="with-header">', '<div class="sidebar">', '<form id="search">'):
        assert H.main_text(f"<body>{wrap}{text}</div></body>") == "Text of the article."
    page = """<article><div class="post-header"><h1>Head</h1></div><div class="header"><h2>Sub</h2>by me</div><h2 id="search">Search</h2><p>one</p>
    <section class="related-work"><p>two</p></section><section id="navigation"><p>three</p></section><p>is <math><mi>a</mi><mo>+</mo><mi>b</mi></math></p>
    <svg><title>no</title><text>four</text><text>five</text></svg><object><p>six</p></object><noscript><p>seven</p></noscript>
    <div class="related">no</div><div class="x cookie-notice">no</div><div role="search">no</div></article>"""
    assert H.main_text(page).split("\n") == ["Head", "Sub", "Search", "one", "two", "three", "is a+b", "four five", "six", "seven"]
    other = "<script>'<article>'</script><aside><article>Teaser</article></aside><main><p>Text.</p></main>"
    assert H.main_text(other) == "Text."


def test_first_surge_to_last_dive():
    link = "<div><a href=1>link</a></div>"
    long, short = ("long text here. " * 200).strip(), "A small region of the article, of more than sixty characters in all."
    page = f"{link * 5}<p>{short}</p>{link * 4}<p>{long}</p><p><a href=2>see there</a></p><p>{short}</p>{link * 5}"
    assert H.main_text(page) == "\n".join([short, *["link"] * 4, long, "see there", short])


def reference(page):
    """By hand for the pages of the test tables, whose article holds headings and paragraphs only."""
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = re.split(r"</?(?:p|h1|br)>", body.replace("<b>", "").replace("</b>", ""))
    return "\n".join(t for p in parts if (t := " ".join(unescape(p).split())))


def test_whole_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    got = {r["page_id"]: r for r in H.query(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r["page_id"]]["text"] == reference(r["html"]) and got[r["page_id"]]["n_chars"] == len(reference(r["html"]))


def test_rows(spark):
    df = spark.createDataFrame([(1, None, None, "x"), (1, "u", "", "x"), (None, "u", "<p>t</p>", "x"), (2, "u", "<p>t</p>", "x"), (2, "u", "<p>t</p>", "x")], "page_id long, url string, html string, text string")
    assert sorted((r["text"], r["n_chars"]) for r in H.extract(df).collect()) == [("", 0), ("", 0), ("t", 1), ("t", 1), ("t", 1)]
    assert H.extract(df.limit(0)).count() == 0


def test_distribution_decides_in_a_named_article(monkeypatch):
    off = "<ul class='share'>" + "<li>x</li>" * 4 + "</ul>"
    long = "long text here. " * 20
    page = f"<article><p>By me</p>{off}<h1>Head</h1><p>one</p><p>two</p><p>{long}</p>{off}<p>{long}</p><p>last</p>{off}<p>Tags</p></article>"
    want = ["Head", "one", "two", long.strip(), long.strip(), "last"]
    assert H.main_text(page).split("\n") == want
    assert H.main_text(page.replace("article>", "div>")).split("\n")[-3:] == [long.strip(), long.strip(), "last"]
    monkeypatch.setattr(H, "regions", lambda size, hint: [(0, len(size))])
    assert H.main_text(page).split("\n") == ["By me", *want, "Tags"]


def test_malformed_pages_take_linear_time():
    import time

    for page in ("<script " * 130_000, "<a " * 300_000, "<a '\"> " * 100_000, "<b>" * 50_000 + "</i>" * 50_000, "<b>" * 30_000 + "<p>x</p>" * 30_000, "<!--" * 200_000, "<" * 500_000, "<p>" * 200_000, "&" * 500_000):
        began = time.time()
        H.main_text(page)
        assert time.time() - began < 5, page[:20]
