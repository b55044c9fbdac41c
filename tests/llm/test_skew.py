"""The ways for tables too large to be sent give the same rows as those for small ones."""

import random

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import boilerplate, lines, skew, spans


def test_join_counted(spark, rows):
    left = spark.createDataFrame([(i, "hot" if i % 2 else None if i % 10 == 0 else f"k{i % 7}") for i in range(100)], "id bigint, k string")
    sizes = {r["k"]: r["n"] for r in left.groupBy("k").agg(F.count(F.lit(1)).alias("n")).collect()}
    counted = spark.createDataFrame([(k, n) for k, n in sizes.items()], "k string, n bigint")
    want = sorted(((r["id"], r["k"], sizes[r["k"]]) for r in left.collect()), key=repr)
    for hot in (0, 5, 20, 1000):
        assert rows(skew.join_counted(left, counted, ["k"], "n", hot=hot).select("id", "k", "n")) == want


@pytest.fixture
def large(monkeypatch):
    def use():
        for module in (lines, boilerplate, spans):
            monkeypatch.setattr(module, "SENT", 0)
        monkeypatch.setattr(skew, "HOT", 4)

    return use


def test_lines(spark, rows, large):
    rng = random.Random(4)
    docs = [(i, rng.choice([1, 1, 2, None]), "\n".join(rng.choice(["a", "b", "c", "d", f"u{i}x{rng.random()}"]) for _ in range(rng.randrange(12)))) for i in range(80)]
    df = spark.createDataFrame(docs, "id bigint, site bigint, text string")
    found, blocks = rows(lines.repeated_lines(df, "id", "site", "text")), rows(lines.repeated_blocks(df, "id", "site", "text"))
    large()
    assert rows(lines.repeated_lines(df, "id", "site", "text")) == found and rows(lines.repeated_blocks(df, "id", "site", "text")) == blocks and len(blocks) > 8


def test_spans(spark, rows, large):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdef ") for _ in range(500))
    texts = [f"{i}" * 30 + passage[rng.randrange(150) :] + f"{i} end" * 5 for i in range(12)] + [passage] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    small = [rows(f(df, "id", "text")) for f in (spans.shared_pairs, spans.shared_amount, spans.removal_clusters)]
    large()
    assert [rows(f(df, "id", "text")) for f in (spans.shared_pairs, spans.shared_amount, spans.removal_clusters)] == small and len(small[0]) > 60


def test_cover(spark, rows, large):
    notice = "this long notice of the site stands below every single page of it and says the same words again and again so that nobody who reads the page can miss what the owners of the site want to tell about their rules"
    name = lambda i, k: "".join(chr(97 + (i * 7 + j * k) % 26) for j in range(9))
    pages = [(i, 1, f"https://corpus.example/{i}", f"Title {name(i, 3)}\nown words of page {name(i, 5)} and more\n{notice} and {notice} {name(i, 11)} {notice} and {notice}\nMenu", None) for i in range(20)]
    df = spark.createDataFrame(pages, "id bigint, site bigint, url string, content string, html string")
    cover = lambda: rows(boilerplate.covered(p := boilerplate.streams(df, "id", "site", "url", "content"), boilerplate.repeated_runs(p)).selectExpr("doc", "array_sort(cover.line_no) c"))
    lines.ensure_checkpoint_dir(spark)
    once = cover()
    assert [list(r[1]) for r in once] == [[3, 4]] * 20
    large()
    assert cover() == once
