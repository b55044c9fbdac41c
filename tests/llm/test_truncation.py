import pytest

from corpusloom.llm import truncation as T

HEAD = "<html><body><main><article><h1>T</h1><p>One sentence stands here.</p><p>"
WHOLE = [
    HEAD + "And a last one.</p></article></main></body></html>", HEAD + "And a last one.</article></main><footer><p class=f>Site, 36 Street\n</footer>", HEAD + "Done.</p></article></main></body>\n</html>\n<!-- cached by node 4 -->",
    HEAD + "Done.</p></article></main><script>load('x')</script>\n", "<div><p>Done.<ul><li>A, B: 3</ul></div>", "<p>Price: [price]</p>", "<p>Loading...</p>", "<div><p>Access denied</p><p>Reference 745</p></div></body></html>", "<h1>T</h1><p>Menu</p><p>Other words</p>", "", "plain text.",
]
CUT = [
    HEAD + "And a last", HEAD + "And a las", HEAD + "And a <a hre", HEAD + "And a <", HEAD + "And caf&#23", HEAD + "And a last …", HEAD + "And a last [truncated]", HEAD + "And a last\n", HEAD + "And a last</p></div></body></html>",
    HEAD + "And a long sentence that never comes to its</p></article></main></body></html>", "<ul><li>one</li><li>tw</p></div></body></html>", "<div><h1>T</h1><p>One sentence stands here.</p><p>In Ista</p></div></body></html>",
]


@pytest.mark.parametrize("html", WHOLE)
def test_whole(html):
    assert T.ending(html) in ("whole", "loose")


@pytest.mark.parametrize("html", CUT)
def test_cut(html):
    assert T.ending(html) in ("tag", "entity", "mark", "text")


def test_limits(spark, rows):
    page = lambda n: "<p>" + "word " * n
    data = [(i, i % 3, HEAD + "x " * (i % 90) + "end.</p></article></main></body></html>") for i in range(300)]
    data += [(1000 + i, 1, ("<p>" + f"w{i} long words that go on and on " * 20)[:400]) for i in range(20)]
    data += [(2000, 1, None), (2001, None, " "), (None, 2, page(5)), (2003, 2, ("<p>A sentence ends. " * 40)[:399] + ".")]
    df = spark.createDataFrame(data, "id bigint, site bigint, html string").selectExpr("*", "0 AS doc", "'x' AS source")
    limits = {(r["unit"], r["scope"], r["length"]) for r in T.length_hazards(T.endings(df, "id", "site", "html")).filter("significant").collect()}
    assert ("chars", "all", 400) in limits and ("bytes", "source", 400) in limits and not any(x[2] < 350 for x in limits)
    got = {r["doc"]: r for r in T.truncated(df, "id", "site", "html").collect()}
    assert all(got[1000 + i]["cut"] and got[1000 + i]["at_limit"] for i in range(20)) and not any(got[i]["cut"] for i in range(300))
    assert got[2003]["cut"] and got[2003]["ending"] == "loose" and 2000 not in got and 2001 not in got and got[None]["cut"]
    rates = {r["source"]: r for r in T.truncation_rates(df, "id", "site", "html").collect()}
    assert rates[1]["n_cut"] == 20 and rates[0]["rate"] == 0.0
    assert T.truncated(df.limit(0), "id", "site", "html").count() == 0 and T.truncation_rates(df.limit(0), "id", "site", "html").count() == 0


LONG = "Every sentence of this paragraph is like the one before it. " * 170
SCRIPT = "<script>" + "load('x < y');\n" * 350 + "</SCRIPT >"
NOTE = "<!-- " + "cached > by node 4 " * 260 + "-->"
END = "</p></article></main></body></html>"


@pytest.mark.parametrize("behind", [END, "</p></div></body></html>", SCRIPT, NOTE, SCRIPT + NOTE + "</body></html>", " " * 5000 + "</div></body></html>"])
def test_cut_far_from_the_end(behind):
    assert len(LONG) > 10_000 and len(SCRIPT) > 5_000 and len(NOTE) > 4_900
    assert T.ending(HEAD + LONG + "And a last sentence that never comes to its" + behind) == "text"
    assert T.ending(HEAD + LONG + "And a <a href='" + "x" * 5000) == "tag"


@pytest.mark.parametrize("behind", [END, END + SCRIPT, END + NOTE, " " * 5000 + END])
def test_whole_far_from_the_end(behind):
    assert T.ending(HEAD + LONG + "And a last one." + behind) == "whole"


def test_set_aside_is_one_element():
    for core in (HEAD + "<!-- a --> b --> c -->", HEAD + "</p> a > b >"):
        assert T.set_aside(core) == (core, "")
    assert T.set_aside(HEAD + "<script>a</script> b</script>") == (HEAD + "<script>a</script> b", "</script>")


def test_added_tails_do_not_move_the_place_of_the_cut():
    for added in ("", "</p></div></body></html>", "<script>" + "load('x');" * 50_000 + "</script>", "<!-- " + "x" * 500_000 + " -->", " [truncated]"):
        kind, chars, octets = T.read_ending(HEAD + "Ein Wort fällt" + added)
        assert kind in ("text", "mark") and chars == len(HEAD) + 14 and octets == chars + 1


def test_a_limit_decides_where_the_ending_leaves_a_doubt(spark):
    """Records cut at 500 code points behind a heading's word, whose tags were closed again: only their number at one length tells."""
    page = lambda i, n: ("<div><h2>" + f"A{i} heading " * 60)[:n] + "</h2></div></body></html>"
    data = [(i, i % 4, page(i, 300 + 7 * i)) for i in range(60)] + [(1000 + i, i % 4, page(i, 500)) for i in range(30)] + [(2000 + i, 9, page(i, 611)) for i in range(20)]
    df = spark.createDataFrame(data, "id bigint, site bigint, html string")
    got = {r["doc"]: r for r in T.truncated(df, "id", "site", "html").collect()}
    late = [i for i in got if i >= 1000 and got[i]["ending"] == "doubt"]
    assert len(late) > 40 and all(got[i]["cut"] for i in late) and not any(got[i]["cut"] for i in range(60) if 300 + 7 * i not in (500, 611))
    rates = {r["source"]: r for r in T.truncation_rates(df, "id", "site", "html").collect()}
    assert rates[9]["n_by_limit"] >= 18


def test_blocks_do_not_change_the_hazards(spark, monkeypatch, rows):
    data = [(i, i % 3, "<p>" + "word " * (i % 70) + "x" * (i % 7)) for i in range(600)] + [(1000 + i, 1, ("<p>" + f"w{i} long words " * 40)[:256]) for i in range(30)]
    ends = T.endings(spark.createDataFrame(data, "id bigint, site bigint, html string"), "id", "site", "html").checkpoint() if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined() else T.endings(spark.createDataFrame(data, "id bigint, site bigint, html string"), "id", "site", "html")
    once = rows(T.length_hazards(ends))
    monkeypatch.setattr(T, "BLOCK", 64)
    assert rows(T.length_hazards(ends)) == once and len(once) > 50
