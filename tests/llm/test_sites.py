from fractions import Fraction

from corpusloom.llm import contributors, lines, sites


def test_spellings(spark, rows):
    d = spark.createDataFrame([(5, "A.example"), (2, "www.a.EXAMPLE."), (3, "b.example"), (4, None), (3, "b.example"), (7, "www.b.example.")], "id bigint, name string")
    assert rows(sites.spellings(d, "id", "name")) == [(2, 2), (3, 3), (4, 4), (5, 2), (7, 3)]


def test_lines_and_caps_by_site(spark, rows):
    same = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "source bigint, site bigint")
    pages = spark.createDataFrame([(i, 1 + i % 2, "Menu") for i in range(6)] + [(10, 3, "Menu"), (11, None, "Menu"), (12, 99, "Menu")], "id bigint, domain_id bigint, content string")
    assert lines.repeated_lines(pages, "id", "domain_id", "content").count() == 0
    assert {r["doc"] for r in lines.repeated_lines(pages, "id", "domain_id", "content", same=same).collect()} == set(range(6))
    capped = contributors.cap_contributors(sites.by_site(pages.withColumn("q", pages.id), "domain_id", same), "domain_id", "q", "id", max_share=Fraction(2, 9))
    assert {r["id"] for r in capped.filter("kept").collect()} == {4, 5, 10, 11, 12}
    assert sites.by_site(pages, "domain_id", None) is pages
