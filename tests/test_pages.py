from pyspark.sql import functions as F

from corpusloom.functions import html as H
from corpusloom.functions import markdown as M
from corpusloom.functions.domains import Platforms, from_page, from_url, needs_page

PAGE = """<!DOCTYPE html><html lang="fr"><head><title> T &amp; t </title><meta name="description" content=" d "><meta property="og:title" content=" og ">
<meta name="keywords" content="k1, k2"><link rel="canonical" href="/c"><script type="application/ld+json">{"@graph":[{"author":{"url":"https://a.org/@me"}}]}</script></head>
<body><nav><a href="/nav">n</a></nav><div id="m" class="x y z w"><p>See <a href="/one#a">one</a> and <a href="https://b.org/Two">two</a>, <a href="mailto:x@y">mail</a> <a href="#top">top</a></p>
<img src="/i.JPG" srcset="/s.png 2x, /t.txt"><video><source src="v.mp4"></video><img data-src="/lazy.png"></div><footer>foot</footer></body></html>"""


def test_one_parse():
    p = H.parse(PAGE)
    assert (p.title(), p.description(), p.keywords(), p.lang()) == ("og", "d", "k1, k2", "fr")
    assert [u for u, _ in p.links("https://a.org/p")] == ["https://a.org/nav", "https://a.org/one#a", "https://b.org/Two"]
    assert p.media("https://a.org/p") == [("https://a.org/i.jpg", "img"), ("https://a.org/s.png", "img"), ("https://a.org/v.mp4", "video")]
    assert ("https://a.org/lazy.png", "img") in p.media("https://a.org/p", lazy=True)
    info = p.link_contexts("https://a.org/p")["https://b.org/Two"]
    assert info["dom"] == "html > body > div#m.x.y.z > p" and info["context"].startswith("See one and")
    assert p.signal("canonical", "https://a.org/p") == "https://a.org/c" and p.signal("ldjson_author", "https://a.org/p") == "https://a.org/@me"
    text = H.parse(PAGE).dropped().readable()
    assert "foot" not in text and "[IMAGE: /i.JPG]" in text


def test_broken_pages():
    for bad in ("", "<", "<a href=", "plain", "<p><b></p>" * 50, "&#x0;<![if x]><a>"):
        p = H.parse(bad)
        assert p.title() == "" and p.links("") == [] or bad


def test_page_struct_nulls(spark):
    df = spark.createDataFrame([(1, PAGE, "https://a.org/p"), (2, None, None), (3, "", "x")], "id int, html string, url string")
    got = {r["id"]: r["p"] for r in df.select("id", H.page_struct("html", "url").alias("p")).collect()}
    assert got[1]["title"] == "og" and got[2]["title"] is None and got[3]["links"] is None
    cut = spark.createDataFrame([("é" * 10,), (None,)], "h string").select(H.truncated(F.col("h"), 5)).collect()
    assert [r[0] for r in cut] == ["éé", None]


MARKDOWN = [
    ("[a](https://x.org/p)", None, ["https://x.org/p"]),
    ("[a](https://x.org/Foo_(bar)) tail)", None, ["https://x.org/Foo_(bar)"]),
    ("![i](https://x.org/i.png) [b](/rel)", "https://x.org/d/", ["https://x.org/rel"]),
    ("<https://x.org/auto> <b>", None, ["https://x.org/auto"]),
    ('[a](https://x.org/p "title")', None, ["https://x.org/p"]),
    ("[a](https://x.org) [a](https://x.org)", None, ["https://x.org", "https://x.org"]),
    ("[a]() [b](mailto:x)", None, []),
    (None, None, []),
]


def test_markdown_links():
    for text, base, expected in MARKDOWN:
        assert M.resolved_links(text, base) == expected


def test_markdown_columns(spark):
    df = spark.createDataFrame([("one\n\n two https://x.org/p here \n\nthree ![a](/i.png \"t\")", "https://x.org/p/")], "md string, u string")
    r = df.select(M.paragraph_of(F.col("md"), F.col("u")).alias("p"), M.images(F.col("md")).alias("i"), M.links_with_raw("md", "u").alias("l")).first()
    assert r["p"] == "two https://x.org/p here" and r["i"][0]["url"] == "/i.png" and r["i"][0]["title"] == "t" and r["l"] == []


def test_domains():
    t = Platforms()
    assert from_url("https://www.youtube.com/@chan/videos", t) == "www.youtube.com/@chan"
    assert from_url("https://Example.com:8080/x", t) == "Example.com:8080"
    assert from_url("https://www.instagram.com/Name/", t).startswith("instagram.com/name")
    assert needs_page("https://www.amazon.fr/dp/1", t) and not needs_page("https://example.org/", t)
    assert from_page("https://www.youtube.com/watch?v=1", H.parse('<span itemprop="author"><link itemprop="url" href="http://www.youtube.com/@c"></span>'), t) == "www.youtube.com/@c"
    assert from_url("https://web.archive.org/web/2020/https://github.com/someone/repo", t) == "github.com/someone"


def test_pages_of_many_open_elements():
    for tag in ("p", "li", "div", "b", "td", "section"):
        page = "".join(f"<{tag}>t{i} <a href='/l{i}'>x</a>" for i in range(100_000 if tag in ("p", "li") else 20_000))
        doc = H.parse(page)
        n = page.count("<a ")
        assert len(doc.links("https://a.org/")) == n
        assert doc.dropped().readable().startswith("t0") and len(doc.media("https://a.org/")) == 0
    few = H.parse("<ul>" + "<li>item <a href='/l'>x</a>" * 3000).link_contexts("https://a.org/")
    assert few["https://a.org/l"]["dom"] == "ul > li" and few["https://a.org/l"]["context"] == "item x"
    assert H.parse("<div>" * 100_000 + "deep").root.find("div").markup(50)[:10] == "<div><div>"


def test_implied_ends():
    info = H.parse("<body><p>one <a href='/1'>a</a><p>two <a href='/2'>b</a><ul><li>c <a href='/3'>c</a><li>d <ul><li>e <a href='/4'>e</a></ul></ul><table><tr><td>f <a href='/5'>f</a><tr><td>g</table>").link_contexts("https://a.org/")
    got = {k: (v["dom"], v["context"]) for k, v in info.items()}
    assert got["https://a.org/1"] == ("body > p", "one a") and got["https://a.org/2"] == ("body > p", "two b")
    assert got["https://a.org/3"] == ("body > ul > li", "c c") and got["https://a.org/4"] == ("body > ul > li > ul > li", "e e") and got["https://a.org/5"] == ("body > table > tr > td", "f f")
