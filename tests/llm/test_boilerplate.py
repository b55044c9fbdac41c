import random

from corpusloom.llm import boilerplate as B

NOUNS = "river council harbour library orchard timetable inventory bridge valley archive".split()


def site(n, start, rng):
    rows = []
    name = lambda: "".join(rng.choice("bcdfglmnrst") + rng.choice("aeiou") for _ in range(3)).capitalize()
    sentence = lambda: f"The {rng.choice(NOUNS)} of {name()} was measured by the {rng.choice(NOUNS)} near {name()} before the {rng.choice(NOUNS)} had been seen by anyone at all."
    truth = {}
    for i in range(start, start + n):
        title = f"Notes from {name()}, {name()}"
        lines = [("Home | News | Maps", 1), (f"News › {title}", 1), (f"By {name()} {name()}", 1), (title, 0), (sentence(), 0), (f"What {name()} measured", 0), (sentence(), 0), ("- " + f"{name()}: 12", 0)]
        lines += [("Read next", 1), (f"Notes from {name()}, {name()}", 1), (f"What {name()} measured", 1), (f"Tags: {name()}, {name()}", 1), (f"© {2000 + i % 20} Corpus", 1)]
        body = "".join(f"<h1>{t}</h1>" if j == 3 else f"<h2>{t}</h2>" if j == 5 else f"<ul><li>{t[2:]}</ul>" if j == 7 else f"<p>{t}</p>" for j, (t, f) in enumerate(lines) if not f)
        rest = ["".join(f'<p class="f">{t}</p>' if "Notes" not in t and "What" not in t else f"<p><a href=x>{t}</a></p>" for t, f in part if f) for part in (lines[:4], lines[4:])]
        html = f"<nav>{rest[0]}</nav><main>{body}</main><footer>{rest[1]}</footer>" if i % 3 else None
        rows.append((i, 1, f"https://corpus.example/{i}", "\n".join(t for t, _ in lines), html))
        truth[i] = {no for no, (_, f) in enumerate(lines, 1) if f}
    return rows, truth


def test_learned_lines(spark):
    rows, truth = site(240, 0, random.Random(3))
    df = spark.createDataFrame(rows, "id bigint, site bigint, url string, content string, html string").selectExpr("*", "'x' AS doc", "1 AS line_no")
    got = {}
    for r in B.furniture_lines(df, "id", "site", "url", "content", "html").collect():
        got.setdefault(r["doc"], set()).add(r["line_no"])
    tp = sum(len(got.get(i, set()) & t) for i, t in truth.items())
    fp = sum(len(got.get(i, set()) - t) for i, t in truth.items())
    fn = sum(len(t - got.get(i, set())) for i, t in truth.items())
    assert tp / (tp + fp) > 0.97 and tp / (tp + fn) > 0.97


def test_edges(spark):
    rows = [(1, None, None, "Only one line", None), (2, 5, "", None, "<p>x</p>"), (3, 5, "u", "", None), (None, 5, "u", "text", None), (4, 5, "u", "word " * 30_000 + "end.", "<"), (4, 5, "u", "\n\n  \n", None)]
    df = spark.createDataFrame(rows, "id bigint, site bigint, url string, content string, html string")
    assert {r["doc"] for r in B.furniture_lines(df, "id", "site", "url", "content", "html").collect()} <= {1}
    assert B.furniture_lines(df.limit(0), "id", "site", "url", "content", "html").count() == 0


def test_blocks():
    page = '<script>var q="<p>x</p>"</script><nav><ul><li><a href=/>Home</a></ul></nav><div class="c"><h1>T</h1><p>One<b> two</b><p>three</div><footer><p>end'
    assert [(t, e, held, linked) for t, e, _, held, linked in B.blocks(page)] == [("Home", "li", True, True), ("T", "h1", False, False), ("One two", "p", False, False), ("three", "p", False, False), ("end", "p", True, False)]
