import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.functions import urls as U

CASES = [
    ("https://a.org/x#frag", "https://a.org/x"),
    ("https://https://a.org/x", "https://a.org/x"),
    ("https://A.ORG/Case?b=2&a=1", "https://a.org/Case?a=1&b=2"),
    ("https://user:Pw@A.org/x", "https://user:Pw@a.org/x"),
    ("https://a.org/x?utm_source=f&fbclid=1&q=a b", "https://a.org/x?q=a+b"),
    ("https://a.org/x?flag", "https://a.org/x?flag="),
    ("https://web.archive.org/web/20200101000000/https://a.org/x?y=1", "https://a.org/x?y=1"),
    ("https://web.archive.org/web/2020id_/https://ghostarchive.org/archive/zz/https://a.org/p", "https://a.org/p"),
    ("https://en.wiki.org/wiki/Foo_(bar)", "https://en.wiki.org/wiki/Foo_(bar)"),
    ("https://a.org/x)", "https://a.org/x"),
    ("https://a.org/x[↑]more", "https://a.org/x"),
    ("https://a.org/x.,;", "https://a.org/x"),
    ("https://[domain]/x", "https://[domain]/x"),
    ("", ""),
    (None, None),
]


@pytest.mark.parametrize(("url", "expected"), CASES)
def test_normal_form(url, expected):
    assert U.normalize_url(url) == expected
    assert U.normalize_url(U.normalize_url(url)) == expected


def test_optional_rules():
    rules = U.UrlRules(force_https=True, strip_www=True, strip_mobile=True, trailing_slash="strip", unwrap_redirect=True)
    assert U.normalize_url("http://www.a.org/x/", rules) == "https://a.org/x"
    assert U.normalize_url("https://m.a.org/", rules) == "https://a.org/"
    assert U.normalize_url("https://www.linkedin.com/redir?url=https%3A%2F%2Fb.org%2Fc", rules) == "https://b.org/c"
    assert U.normalize_url("https://a.org/x", U.UrlRules(trailing_slash="add")) == "https://a.org/x/"
    assert U.normalize_url("https://a.org/x.html", U.UrlRules(trailing_slash="add")) == "https://a.org/x.html"


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcA/?&=#%+:w ", max_size=40), st.text(max_size=20))
def test_never_fails_and_is_idempotent(tail, anything):
    once = U.normalize_url("https://a.org/" + tail)
    assert U.normalize_url(once) == once
    assert isinstance(U.normalize_url("https://[" + anything), str) and isinstance(U.normalize_url("x" + anything), str)


def test_columns(spark):
    data = [(1, "https://www.A.org/P/?q=1#t"), (2, "ftp://a.org/x"), (3, "https://a.org/doc.PDF?x=1"), (4, None), (5, "https://web.archive.org/web/1/https://b.org/")]
    df = spark.createDataFrame(data, "id int, url string")
    u = F.col("url")
    got = {r["id"]: r for r in df.select("id", U.crawlable(u).alias("c"), U.canonical(u).alias("k"), U.host_path_key(u).alias("h"), U.normalize("url").alias("n"), U.classified(u).alias("x"), U.normalize_native(u).alias("m")).collect()}
    assert [got[i]["c"] for i in range(1, 6)] == [True, False, False, False, True]
    assert got[1]["k"] == "https://www.a.org/P?q=1" and got[1]["h"] == "a.org/P?q=1"
    assert got[1]["n"] == got[1]["m"] == "https://www.a.org/P/?q=1"
    assert got[4]["n"] is None and got[4]["h"] is None
    assert got[5]["x"]["is_archive"] and got[1]["x"]["has_anchor"] and got[1]["x"]["has_query"]
    pages = spark.createDataFrame([("https://a.org/x", "https://a.org/x#s"), ("https://a.org/x", "https://a.org/y"), (None, None)], "b string, t string")
    assert [r[0] for r in pages.select(U.same_page("b", "t")).collect()] == [True, False, False]
    assert pages.select(U.joined("b", F.lit("../Z"), lower=True)).first()[0] == "https://a.org/z"
