import pytest

from corpusloom.llm import markup as M

CASES = [
    ("<p>One <b>two</b></p>", {"html"}), ("a&nbsp;b &#8211; c", {"html"}), ("&lt;p&gt;x&lt;/p&gt;", {"html"}), ("x<br />y", {"html"}), ("<!-- more -->x", {"html"}),
    ("# Title\n\ntext", {"markdown"}), ("Title\n=====\ntext", {"markdown"}), ("a **b** c", {"markdown"}), ("see [x](/p/9)", {"markdown"}), ("| a | b |\n|---|--:|\n| 1 | 2 |", {"markdown"}), ("```\n<p>sample</p>\n```", {"markdown"}), ("a `<b>` c", {"markdown"}), ("* one\n* two", {"markdown"}), ("~~x~~", {"markdown"}), ("> q", {"markdown"}), ("[1]: /p/4", {"markdown"}),
    ("'''T'''\n* one\n# two", {"wiki"}), ("[[Region|the place]]", {"wiki"}), ("== H ==\ntext", {"wiki"}), ('{| class="t"\n! a\n|-\n| 1\n|}', {"wiki"}), ("{{source|X}}", {"wiki"}),
    ("\\section{A}\ntext", {"latex"}), ("so $x^2 + 1$ holds", {"latex"}), ("\\(a \\leq b\\)", {"latex"}), ("$$\\sum_i x_i$$", {"latex"}), ("\\begin{itemize}\n\\item a\n\\end{itemize}", {"latex"}),
    ("<p>$$x_1$$</p>", {"html", "latex"}), ("**a** &amp; b", {"html", "markdown"}),
    ("A paid $842 and later $849 for it.", set()), ("C:\\arlental\\data\\330", set()), ("See #tag and *Name (note below).", set()), ("A == 38? Nobody knows.", set()), ("N {draft 774}", set()), ("N* did not reply; *provisional figure.", set()),
    ("N: 663 < 672 and 683 > 666, so", set()), ("N [sic] & Co., file_n_v460.txt", set()), ("• one\n• two", set()), ("", set()), ("5 * 3 * 2", set()),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_kinds(text, expected):
    assert M.kinds(text) == expected


def test_clean():
    page = "<nav><a href=/>Home</a> <a href=/n>News</a></nav><h1>The <b>title</b></h1><p>One two three four five.</p><ul><li>first</li><li>second</li></ul><pre><code>if x &lt; 1:\n    y</code></pre><p>$$x^2$$</p>"
    out = M.clean(page)
    assert out.startswith("# The title") and "- first\n- second" in out and "```\nif x < 1:\n    y\n```" in out and "$$x^2$$" in out and "Home" not in out
    assert M.clean("# T **b**\n\n* a\n* b\n\n[x](/u) ![i](/i.png)") == "# T b\n\n- a\n- b\n\nx i"
    assert M.clean("== H ==\n* a\n'''b''' [[C|d]] {{t|x}}") == "# H".replace("# ", "## ") + "\n- a\nb d"
    assert M.clean("\\section{A}\n\\begin{itemize}\n\\item b\n\\end{itemize}\n\\emph{c}\\footnote{d} $x$") .split() == ["#", "A", "-", "b", "c", "$x$"]
    assert M.clean(None) is None and M.clean("") == "" and M.clean(" plain ") == "plain"
    assert M.clean("&lt;p&gt;a&lt;/p&gt;\n&lt;p&gt;b&lt;/p&gt;").split("\n") == ["a", "b"]
    words = "word " * 20_000
    assert M.clean(f"<p>{words}</p>") == words.strip()


def test_best_region():
    assert M.best_region([-5, 2, -1, 3, -9, 1]) == (1, 4)
    assert M.best_region([-1, -2]) == (0, 0) and M.best_region([]) == (0, 0)


def test_frames(spark, rows):
    df = spark.createDataFrame([(1, "<p>a</p>", "**b**", 0), (2, None, "", 0), (1, "<p>a</p>", None, 0)], "id bigint, content string, markdown string, key int")
    assert rows(M.markup_kinds(df, "id", ["content", "markdown"])) == [(1, "content", "html"), (1, "content", "html"), (1, "markdown", "markdown")]
    assert rows(M.clean_fields(df, "id", ["content", "markdown"])) == [(1, "a", "b"), (1, "a", None), (2, None, "")]
    assert M.markup_kinds(df.limit(0), "id", ["content"]).count() == 0
    pages = spark.createDataFrame([(i, "<nav><a href=x>Home</a></nav><article><p>one two three four five six</p></article>") for i in range(5)], "id bigint, html string")
    w = {r["token"]: r["weight"] for r in M.fit_weights(pages, "id", "html").collect()}
    assert w["word"] > 0 > w["a"] and M.fit_weights(pages.limit(0), "id", "html").count() == 0


def test_long_formula():
    formula = "$" + " + ".join(f"x_{{{i}}} y^{{{i}}}" for i in range(40)) + "$"
    text = f"The sum {formula} converges. Another *one* is *not* shown."
    assert len(formula) > 300 and M.kinds(f"The sum {formula} converges.") == {"latex"} and formula in M.clean(text)


def test_furniture_goes_and_the_extract_stays():
    body = "".join(f"<p>Sentence {i} of the article tells more about the river and its old bridge.</p>" for i in range(5))
    page = f"<nav><ul><li><a href=/>Home</a></li><li><a href=/n>News</a></li></ul></nav><article><h1>T</h1>{body}<ul><li>first item</li><li><a href=/x>linked</a> item with words</li></ul></article><footer><p>© 2020 Site</p></footer>"
    out = M.clean(page)
    assert "Home" not in out and "News" not in out and "©" not in out
    assert out.startswith("# T") and "- first item" in out and "- linked item with words" in out
    assert M.clean("<ul><li><a href=/a>one</a></li><li><a href=/b>two</a></li></ul>") == "- one\n- two"


def test_passed_weights_decide(spark):
    df = spark.createDataFrame([(1, "<p><a href=x>only a link</a></p>" + "<p>" + "word " * 40 + "</p>")], "id bigint, content string")
    weights = lambda a: spark.createDataFrame([("word", 0.3), ("a", a), ("p", -0.1)], "token string, weight double")
    assert "only a link" not in M.clean_fields(df, "id", ["content"], weights(-9.0)).first()["content"]
    assert "only a link" in M.clean_fields(df, "id", ["content"], weights(-0.1)).first()["content"]
