import random
import re

from corpusloom.llm import lines as L


def key(line):
    return " ".join(re.sub(r"\d+", "0", line.casefold()).split())


def test_against_brute_force(spark):
    rng = random.Random(5)
    pool = ["Share: copy", "© {n} Site", "Straße {n}", "Menu\u00a0 A", "one", "two"]
    docs = []
    for i in range(60):
        body = []
        for _ in range(rng.randrange(0, 9)):
            line = rng.choice(pool).replace("{n}", str(rng.randrange(3000)))
            line = rng.choice([line, line.upper(), "  " + line.replace(" ", " \t"), line + "\r", f"unique {rng.random()}", ""])
            body.append(line)
        docs.append((i, rng.choice([1, 1, 2, None]), "\n".join(body), "x"))
    docs += [(100, 1, None, "x"), (101, 1, "", "x"), (None, 1, "one", "x")]
    df = spark.createDataFrame(docs, "id bigint, site bigint, text string, doc string")
    seen = {}
    for i, s, t, _ in docs:
        if i is not None:
            for line in (t or "").split("\n"):
                if key(line):
                    seen.setdefault((s, key(line)), set()).add(i)
    want = {(i, n) for i, s, t, _ in docs if i is not None for n, line in enumerate((t or "").split("\n"), 1) if key(line) and len(seen[s, key(line)]) >= 6}
    got = {(r["doc"], r["line_no"]) for r in L.repeated_lines(df, "id", "site", "text").collect()}
    assert got == want and want
    out = spark.createDataFrame([(d,) for d in range(10)], "doc bigint")
    fewer = {r["doc"] for r in L.repeated_lines(df, "id", "site", "text", without=out).collect()}
    assert not fewer & set(range(10))
    clean = {r["doc"]: r["content"] for r in L.without_lines(df, "id", "text", L.repeated_lines(df, "id", "site", "text")).collect()}
    for i, _, t, _ in docs[:60]:
        assert clean[i] == "\n".join(line for n, line in enumerate(t.split("\n"), 1) if (i, n) not in want)
    assert clean[100] is None and clean[101] == ""


def test_blocks(spark):
    docs = [(i, 1, f"own {i}x\nA\nB\n\nC\nD\nrest {i}y") for i in range(6)] + [(9, 1, "B\nA")]
    df = spark.createDataFrame(docs, "id bigint, site bigint, text string")
    sizes = sorted((r["n_lines"], r["n_docs"]) for r in L.repeated_blocks(df, "id", "site", "text").collect())
    # own and rest differ only in digits, so they repeat too: six lines in a row
    assert [s for s in sizes if s[0] == 4] == [(4, 6)] * 3 and max(s[0] for s in sizes) == 4
    assert L.repeated_blocks(df.limit(0), "id", "site", "text").count() == 0


def test_each_depth_is_ranked_and_pruned(spark):
    rng = random.Random(8)
    block = [["a", "b", "a", "c", "b"], ["c", "a", "b", "d"], ["d", "d", "d", "d", "d", "d", "d", "d"]]
    docs = []
    for i in range(60):
        body = [x for _ in range(3) for x in (rng.choice(block) if rng.random() < 0.6 else rng.choices("abcd", k=3))]
        docs.append((i, i % 2, "\n".join(body)))
    df = spark.createDataFrame(docs, "id bigint, site bigint, text string")
    L.ensure_checkpoint_dir(spark)
    pages = L.sequences(df, "id", "site", "text").checkpoint()
    ids = {r["doc"]: (r["source"], r["ids"]) for r in pages.collect()}
    runs = L.suffix_runs(pages, L.ranked(L.frequent_ids(pages, 6), "source", "h"))
    depths = 0
    for depth, blocks, suffixes in L.suffix_depths(runs, 6):
        spans = {}
        for d, (s, h) in ids.items():
            for p in range(len(h) - depth + 1):
                spans.setdefault((s, *h[p : p + depth]), set()).add((d, p))
        want = {k: v for k, v in spans.items() if len({d for d, _ in v}) >= 6}
        stay = {(r["doc"], x["at"]): x["rank"] for r in suffixes.collect() for x in r["lines"]}
        # those of too few documents have left, and ranks sort the rest as their lines do
        assert set(stay) == {p for v in want.values() for p in v} and len(stay) < sum(map(len, spans.values()))
        order = [{stay[p] for p in want[k]} for k in sorted(want)]
        assert all(len(r) == 1 for r in order) and [min(r) for r in order] == sorted(r["rank"] for r in blocks.collect())
        depths += 1
    assert depths >= 2
