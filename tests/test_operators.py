import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph, media, normalize, rawlinks, search, select, similarity, state, tags

PAGE = "id bigint, land_id bigint, url string, original_url string, domain_id bigint, http_status string, lang string, title string, readable string, html string, fetched_at timestamp_ntz, relevance int, depth int, validllm string"
T0 = dt.datetime(2024, 1, 1)


def pages(spark, rows):
    keys = [c.split()[0] for c in PAGE.split(", ")]
    base = dict.fromkeys(keys) | {"land_id": 1, "domain_id": 1, "fetched_at": T0, "relevance": 5, "depth": 0}
    return spark.createDataFrame([tuple((base | r).get(k) for k in keys) for r in rows], PAGE)


def links(spark, *pairs):
    return spark.createDataFrame(list(pairs), "source_id bigint, target_id bigint")


def test_closed_network(spark, rows):
    e = pages(spark, [{"id": 1, "url": "a"}, {"id": 2, "url": "b", "domain_id": 2}, {"id": 3, "url": "c", "relevance": 0}, {"id": 4, "url": "d", "relevance": None}])
    raw = spark.createDataFrame([(1, 2, "z", "p"), (1, 2, "a", "q"), (1, 3, None, None), (None, 2, None, None), (2, 2, "s", "s"), (1, 4, None, None)], "source_id bigint, target_id bigint, context string, dom string")
    link = graph.edges(raw)
    assert rows(graph.page_links(e, link, 1).select("source_id", "target_id", "context")) == [(1, 2, "a"), (2, 2, "s")]
    d = spark.createDataFrame([(1, "x", None, None, None, None), (2, "y", None, None, None, None)], "id bigint, name string, title string, description string, keywords string, http_status string")
    assert rows(graph.domain_links(e, d, link, 1)) == [(1, "x", 2, "y", 1)]
    assert rows(graph.status_counts(e, 1)) == [(None, 0)]


def test_orphans_and_queues(spark, rows):
    e = pages(spark, [{"id": 1, "relevance": 0}, {"id": 2, "fetched_at": None, "depth": 1}, {"id": 3, "fetched_at": None, "depth": 1}, {"id": 4, "fetched_at": None, "depth": 0}])
    link = links(spark, (1, 2))
    assert rows(select.orphans(e, link, 1).select("id")) == [(3,)]
    assert rows(select.orphans(e, link, 1, dry_run_maxrel=1).select("id")) == [(2,), (3,)]
    assert rows(select.frontier(e, 1, depth=1).select("id")) == [(2,), (3,)]
    bad = spark.createDataFrame([("https://a.org/x](y",), ("https://a.org/(x",), ("https://a.org/x",)], "u string")
    assert [r[0] for r in bad.select(select.malformed(F.col("u"))).collect()] == [True, True, False]
    numbered = select.batches(spark.range(2500), ["id"], 1000).select("id", "position", "batch")
    assert all(p == i + 1 and b == i // 1000 + 1 for i, p, b in rows(numbered))
    tries = spark.createDataFrame([([("d", "403", None), ("t", "200", "x")],), ([("d", "404", None), ("t", "200", "x"), ("a", "200", None)],), ([("d", "200", "p"), ("t", "200", "x")],)], "a array<struct<strategy: string, status: string, html: string>>")
    assert [r[0]["strategy"] for r in tries.select(select.attempts(F.col("a"))).collect()] == ["t", "d", "d"]


def test_media_rules(spark, rows):
    m = spark.createDataFrame([(1, 100, 300, 10, "png", "h", T0, None), (2, None, 300, 10, None, "h", T0, None), (3, 500, 500, 10**7, "png", None, None, "e")], "id bigint, width int, height int, file_size bigint, format string, image_hash string, analyzed_at timestamp_ntz, analysis_error string")
    assert rows(select.media_doomed(m, min_width=200).select("id")) == [(1,), (2,)]
    assert rows(select.media_doomed(m)) == []
    assert rows(media.dimensions(m)) == [(1, 1, 1, 0)] and rows(media.duplicates(m)) == [(1, 2)]
    px = spark.createDataFrame([(1, [[0, 0, 0]] * 30 + [[255, 255, 255]] * 10)], "media_id bigint, pixels array<array<int>>")
    assert [(r.rank, r.r, r.percentage) for r in media.dominant_colours(px).orderBy("rank").collect()] == [(0, 0, 75.0), (1, 255, 25.0)]


def test_tags(spark, rows):
    tag = spark.createDataFrame([(1, 1, None, 1, "A"), (2, 1, 1, 2, "B"), (3, 1, 2, 1, "C"), (9, 1, 99, 1, "lost")], "id bigint, land_id int, parent_id bigint, sorting int, name string")
    content = spark.createDataFrame([(2, 10, "x"), (2, 10, "y"), (3, 11, "z")], "tag_id bigint, expression_id bigint, text string")
    assert rows(tags.tag_counts(tag, content)) == [(10, "A_B", 2), (11, "A_B_C", 1)]
    wide = tags.tag_matrix(tag, content)
    assert wide.columns == ["expression_id", "A", "A_B", "A_B_C"] and rows(wide) == [(10, 0, 2, 0), (11, 0, 0, 1)]


def test_raw_network(spark, rows):
    """Body links weigh 1 and 0, links only in the stored page 0 and their number."""
    e = pages(spark, [
        {"id": 1, "url": "https://site-a.org/1", "html": '<a href="https://site-a.org/2">x</a><a href="https://SITE-A.org/3/">y</a><a href="https://site-a.org/3">y</a><a href="#t">t</a><a href="https://ext.org/">e</a>'},
        {"id": 2, "url": "https://site-a.org/2", "domain_id": 1}, {"id": 3, "url": "https://site-a.org/3", "domain_id": 2}, {"id": 4, "url": "http://www.site-a.org/4", "relevance": 0},
    ])
    got = rawlinks.page_edges(e, links(spark, (1, 2), (2, 2)), 1).select("source_id", "target_id", "weightbody", "weighthtml")
    assert rows(got) == [(1, 2, 1, 0), (1, 3, 0, 2)]


def test_normalise(spark, rows):
    e = pages(spark, [{"id": 1, "url": "https://a.org/x"}, {"id": 2, "url": "https://a.org/x#f"}, {"id": 3, "url": "https://a.org/y?utm_source=1"}, {"id": 4, "url": "https://a.org/y?gclid=2"}])
    plan = normalize.plan(e)
    assert rows(plan.select("id", "action", "canonical_id")) == [(2, "merge", 1), (3, "rename", None), (4, "rename", None)]
    link = links(spark, (2, 3), (3, 2), (1, 3), (2, 1), (1, 1))
    assert rows(normalize.merged_links(link, plan)) == [(1, 1), (1, 3), (3, 1)]
    assert rows(normalize.totals(plan, link)) == [(2, 1, 3, 2)]
    done = {r["id"]: r for r in normalize.renamed(e, plan).collect()}
    assert done[3]["url"] == "https://a.org/y" and done[3]["original_url"] == "https://a.org/y?utm_source=1" and done[1]["original_url"] is None
    chain = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (7, 8), (8, 7)], "a bigint, b bigint")
    assert rows(normalize.terminals(chain, "a", "b")) == [(1, 4), (2, 4), (3, 4)]


def test_search(spark, rows):
    r = spark.createDataFrame([(1, 0, 0, "https://A.org/p/", "", "s", 5, "x"), (1, 1, 0, "https://a.org/p#q", "T", None, 2, "y"), (1, 1, 1, "https://b.org", None, None, None, "y"), (1, 1, 2, "", "n", None, 1, "y")], "query_id int, batch_no int, pos int, url string, title string, snippet string, rank int, providers string")
    m = search.ranked(search.merged(r, "query_id")).drop("_seen").collect()
    assert [tuple(x) for x in m] == [(1, "https://a.org/p", "T", "s", 2, "x+y"), (1, "https://b.org", None, None, None, "y")]
    assert search.routed(r, "fallback", "query_id").count() == 1 and search.routed(r, "parallel", "query_id", allowed=["Y"]).count() == 3
    with pytest.raises(ValueError):
        search.routed(r, "other", "query_id")
    p = spark.createDataFrame([(1, '{"web":{"results":[{"url":"u1","title":"t"},{"title":"no"},{"url":"u3"}]}}'), (2, "{broken"), (3, None)], "q int, payload string")
    assert rows(search.parsed_results(p, "payload", "brave", 3, "q").select("q", "url", "rank")) == [(1, "u1", 1), (1, "u3", 3)]
    known = spark.createDataFrame([(5, "a")], "id bigint, name string")
    assert rows(search.first_seen_ids(spark.createDataFrame([("c",), ("a",), ("b",), ("b",)], "name string"), ["name"], known)) == [(5, "a"), (6, "b"), (7, "c")]
    nxt = spark.createDataFrame([('{"serpapi_pagination":{"next_offset":20,"next":"x"}}', 10, 10), ('{"serpapi_pagination":{"next":"https://s?start=30"}}', 20, 10), ("{}", 5, 10), ('{"serpapi_pagination":{"next_link":"https://s?x=1"}}', 5, 10), ('{"serpapi_pagination":{"next_link":"https://s?first=3"}}', 5, 0)], "p string, c int, n int")
    assert [x[0] for x in nxt.select(search.next_offset(F.col("p"), F.col("c"), F.col("n"))).collect()] == [20, 30, None, 15, None]


def brute(vectors, threshold):
    out = set()
    for i, (a, ga, va) in enumerate(vectors):
        for b, gb, vb in vectors[i + 1 :]:
            s = np.dot(va, vb) / (np.linalg.norm(va) * np.linalg.norm(vb))
            if ga != gb and s >= threshold:
                out.add((a, b))
    return out


def test_similarity(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 40)
    rng = np.random.default_rng(0)
    data = [(i, i % 4, [float(x) for x in rng.normal(size=8)]) for i in range(150)]
    df = spark.createDataFrame(data, "id bigint, g int, v array<double>")
    got = {(r[0], r[1]) for r in similarity.exact_pairs(df, "id", "g", "v", threshold=0.6).collect()}
    assert got == brute(data, 0.6)
    lsh = {(r[0], r[1]) for r in similarity.lsh_pairs(df, "id", "g", "v", dim=8, bits=3, threshold=0.6).collect()}
    assert lsh <= got and len(lsh) > 0
    near = {(r[0], r[1]) for r in similarity.neighbour_pairs(df, "id", "g", "v", top_k=3).collect()}
    x = np.array([d[2] for d in data])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for i in range(len(x)):
        for j in np.argsort(-(x @ x[i]), kind="stable")[:4]:
            if i != j and data[i][1] != data[j][1]:
                want.add((min(i, int(j)), max(i, int(j))))
    assert near == want
    assert similarity.exact_pairs(df.limit(0), "id", "g", "v").count() == 0


def test_signature_tables_raise_the_recall(spark, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK", 50)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 32))
    data = [(i, i % 7, [float(x) for x in base[i % 60] + 0.35 * rng.normal(size=32)]) for i in range(420)] + [(900, 1, [0.0] * 32), (901, 2, None), (None, 3, [1.0] * 32)]
    df = spark.createDataFrame(data, "id bigint, g int, v array<double>")
    whole = {(r[0], r[1]) for r in similarity.exact_pairs(df, "id", "g", "v", threshold=0.85).collect()}
    found = {(r[0], r[1]): r[2] for r in similarity.lsh_pairs(df, "id", "g", "v", dim=32, bits=8, tables=10, threshold=0.85).collect()}
    assert len(whole) > 300 and set(found) <= whole and len(found) >= 0.9 * len(whole)
    one = similarity.lsh_pairs(df, "id", "g", "v", dim=32, bits=8, threshold=0.85).count()
    assert one < len(found) and similarity.lsh_pairs(df.limit(0), "id", "g", "v", dim=32, bits=4).count() == 0


def test_vectors_of_relevant_pages(spark):
    pages = spark.createDataFrame([(1, 1, 5), (2, 1, 0), (3, 1, None), (4, 2, 9)], "id bigint, land_id int, relevance int")
    para = spark.createDataFrame([(10 * i, i) for i in range(1, 5)], "id bigint, expression_id bigint")
    vec = spark.createDataFrame([(10 * i, [1.0]) for i in range(1, 5)], "paragraph_id bigint, embedding array<double>")
    ids = lambda m: sorted(r["paragraph_id"] for r in similarity.relevant_vectors(vec, para, pages, 1, m).collect())
    assert ids(None) == ids(0) == [10, 20, 30] and ids(1) == [10]


def test_paragraphs(spark, rows):
    a, b = "a" * 200, "b" * 200
    df = spark.createDataFrame([(2, 1, f"{a}\n\n{b}"), (1, 1, a), (3, 1, None)], "id bigint, d bigint, t string")
    assert rows(similarity.paragraphs(df, "id", "d", "t").select("expression_id", "para_index")) == [(1, 1), (2, 2)]


def test_states(spark, rows):
    land = spark.createDataFrame([(1, "en,es")], "id bigint, lang string")
    words = spark.createDataFrame([(1, "water"), (1, "water"), (1, "sea bed"), (1, "none")], "land_id bigint, lemma string")
    e = pages(spark, [{"id": 1, "title": "Water", "readable": "the sea bed, water; waters", "lang": "en"}, {"id": 2, "title": None, "readable": "x"}])
    assert rows(state.relevance(e, words, land, native=True)) == [(1, 2 * 10 + 2 * 1 + 1), (2, 10)]
    j = spark.createDataFrame([(1, 3, None, "Oui"), (2, 3, "oui", "no"), (3, 3, "oui", "hm")], "id bigint, relevance int, validllm string, a string")
    assert rows(state.judged(j, "a").select("id", "relevance", "validllm")) == [(1, 3, "oui"), (2, 0, "non"), (3, 3, "oui")]
    f = spark.createDataFrame([("ab", "abc"), ("", "x"), ("ab", ""), ("ab", None), (None, "n"), ("abc", "xyz")], "c string, n string")
    assert [r[0] for r in f.select(state.merged_field(F.col("c"), F.col("n"), "smart", "title")).collect()] == ["abc", "x", "ab", "ab", "n", "abc"]
    out = state.deleted(spark.createDataFrame([(1,)], "id bigint"), link=(links(spark, (1, 2), (2, 3)), ["source_id", "target_id"]))
    assert rows(out["link"]) == [(2, 3)]
    crawled = pages(spark, [{"id": 7, "url": "https://a.org/p", "readable": "[x](/q) ![i](/i.png) <a href='/r'>r</a>", "validllm": "non", "title": "water"}])
    rel, found, m = state.consolidated(crawled, words, land)
    assert rows(rel) == [(7, 0)] and {r["url"] for r in found.collect()} == {"https://a.org/q", "https://a.org/r"} and rows(m) == [(7, "https://a.org/i.png", "img")]
    new = spark.createDataFrame([(1, "https://a.org/n#x", 1), (1, "https://a.org/n", 2), (1, "https://a.org/f.pdf", 1)], "land_id bigint, url string, depth int")
    assert rows(state.expressions_to_add(new, e).select("url", "original_url", "depth")) == [("https://a.org/n", "https://a.org/n#x", 1)]


def test_random_edges_against_brute_force(spark, rows):
    random.seed(4)
    e = pages(spark, [{"id": i, "url": str(i), "domain_id": i % 3, "relevance": i % 4} for i in range(30)])
    pairs = {(random.randrange(30), random.randrange(30)) for _ in range(120)}
    got = rows(graph.page_edges(e, graph.edges(spark.createDataFrame([(*p, None, None) for p in pairs], "source_id bigint, target_id bigint, context string, dom string")), 1, 2))
    assert got == sorted(((a, b, 1) for a, b in pairs if a % 4 >= 2 and b % 4 >= 2 and a % 3 != b % 3), key=repr)
