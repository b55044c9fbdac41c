import random

import numpy as np

from corpusloom.llm import spans


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij é😀") for _ in range(6)).strip() or "x" for _ in range(n))


def brute(texts, span):
    grams = [{t[i : i + span] for i in range(len(t) - span + 1)} for t in texts]
    return {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if grams[i] & grams[j]}


def test_minima_and_hashes():
    v = np.random.default_rng(0).integers(0, 1000, 57).astype(np.uint64)
    for w in (1, 2, 7, 57, 58):
        assert spans.window_minima(v, w).tolist() == [min(v[i : i + w]) for i in range(len(v) - w + 1)]
    h = spans.gram_hashes(np.frombuffer("abcabcabc".encode("utf-32-le"), np.uint32), 3)
    assert h[0] == h[3] == h[6] and len(set(h.tolist())) == 3


def test_pairs_against_brute_force(spark):
    rng = random.Random(3)
    texts = [words(rng, 80) for _ in range(40)]
    shared = words(rng, 60)
    for i, n in ((0, 300), (5, 299), (9, 400), (17, 301)):
        at = rng.randrange(len(texts[i]))
        texts[i] = texts[i][:at] + shared[:n] + texts[i][at:]
    texts += [texts[2], texts[2], texts[9], "x" * 299, "x" * 299, "y" * 700, "z" + "y" * 320, None, "", " " * 400, shared[100:] + words(rng, 20)]
    df = spark.createDataFrame([(i, t, 7, i) for i, t in enumerate(texts)], "doc_id bigint, text string, key int, rep bigint")
    got = {tuple(r) for r in spans.shared_pairs(df, "doc_id", "text").collect()}
    assert got == brute([t or "" for t in texts], 300)
    amount = {r["doc_id"]: r for r in spans.shared_amount(df, "doc_id", "text").collect()}
    assert len(amount) == len(texts)
    for i, t in enumerate(texts):
        covered = [False] * len(t or "")
        for j, u in enumerate(texts):
            if i != j and t and u:
                for k in range(len(t) - 299):
                    if t[k : k + 300] in u:
                        covered[k : k + 300] = [True] * 300
        assert amount[i]["shared_chars"] == sum(covered), i
    clusters = {r["doc_id"]: r["cluster_id"] for r in spans.removal_clusters(df, "doc_id", "text").collect()}
    assert clusters[2] == clusters[40] == clusters[41] == 2 and clusters[0] == clusters[9] == clusters[17] == 0


def test_empty_and_repeated(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert spans.shared_pairs(df, "doc_id", "text").count() == 0 and spans.removal_clusters(df, "doc_id", "text").count() == 0 and spans.shared_amount(df, "doc_id", "text").count() == 0
    df = spark.createDataFrame([(1, "a" * 400), (1, "a" * 400), (None, "a" * 400)], "doc_id bigint, text string")
    assert spans.shared_pairs(df, "doc_id", "text").count() == 0


def test_components(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100 + rng.randrange(30), 100 + rng.randrange(30)) for _ in range(20)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a bigint, b bigint")
    got = dict(tuple(r) for r in spans.components(df, "a", "b").collect())
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    assert got == {x: root(x) for x in parent}


def test_hot_groups(spark, monkeypatch):
    """A third of all rows are copies, another third share one passage."""
    monkeypatch.setattr(spans, "HOT", 7)
    rng = random.Random(8)
    passage = words(rng, 60)
    texts = [passage + words(rng, 10) for _ in range(40)] + ["c" * 400] * 60 + [words(rng, 70) for _ in range(20)] + [passage[:350] + "c" * 330]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    want = brute(texts, 300)
    assert {tuple(r) for r in spans.shared_pairs(df, "doc_id", "text").collect()} == want
    few = {tuple(r) for r in spans.shared_pairs(df, "doc_id", "text", copies="representatives").collect()}
    assert few == {(a, b) for a, b in want if not (40 < a < 100 or 40 < b < 100)}


def test_a_hot_passage_makes_no_pairs(spark):
    """One passage in 3,000 different texts: one group of 3,000 rows, where pairs would be 4.5 million."""
    rng = random.Random(8)
    passage = words(rng, 60)
    df = spark.createDataFrame([(i, f"{i * 7919:09d} " * 3 + passage + f" {i:07d}" * 2) for i in range(3000)], "doc_id bigint, text string")
    shared = spans.Shared(df, "doc_id", "text")
    assert shared.members.count() < 10 * 3000
    assert spans.removal_clusters(df, "doc_id", "text").agg({"cluster_id": "max"}).first()[0] == 0
    assert {r["n_links"] for r in spans.shared_amount(df, "doc_id", "text").collect()} == {2999}


def test_every_pair_of_copies(spark):
    rng = random.Random(5)
    shared = words(rng, 60)
    one, two = shared + words(rng, 10), words(rng, 10) + shared
    texts = [one] * 2 + [two] * 470 + [words(rng, 60)] * 33
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = [tuple(r) for r in spans.shared_pairs(df, "doc_id", "text").collect()]
    kind = [0] * 472 + [1] * 33
    assert sorted(got) == [(i, j) for i in range(505) for j in range(i + 1, 505) if kind[i] == kind[j]]
