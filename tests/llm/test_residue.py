import pyarrow as pa
import pytest

from corpusloom.llm import messages
from corpusloom.llm import residue as R

JUNK = ["Hello $city$", "{{ page.title }}", "Dear {first_name},", "[INSERT INTRO HERE]", "By %%HEADLINE%%", "<%= render 'x' %>", "*|FOOTER|*", "#CITY# #DATE#", "Lorem ipsum dolor sit amet magna.", "text text text", "asdf qwer asdf", "test 28", "Your heading here",
        "Page not found", "Error 404", "Fehler 404", "Acceso denegado", "Your session has expired.", "Please enable JavaScript to run this app.", "Bitte aktivieren Sie JavaScript, um diese Anwendung zu nutzen.", "Accesso negato a /x. Codice 12",
        "Checking your browser before opening x...", "Are you human?", "This domain is parked. Contact the owner of x.", '{"error": {"code": 4, "message": "no such document"}}', "ACCÈS REFUSÉ", "Sito in manutenzione, riprova più tardi."]
TEXT = ["Without JavaScript enabled, the map of Ostend showed nothing, which the report calls a failure.", "A guide shows how a variable such as {{ city }} is replaced before a letter is printed by the office.", "Editors noted that filler such as lorem ipsum had stayed in 12 drafts for a whole month.", "The water union measured the night bus routes."]


@pytest.mark.parametrize("line", JUNK)
def test_junk(line):
    assert R.line_kind(line) in ("slot", "filler", "message")


@pytest.mark.parametrize("line", TEXT)
def test_text(line):
    assert R.line_kind(line) == "text"


def test_templates():
    lines = ["Access to page red is denied", "Access to page blue is denied", "Something else stands here now"]
    assert R.mine(lines)[0] == R.mine(lines)[1] or "<*>" in R.mine(lines)[1]
    assert R.mine([]) == []


def test_pages(spark):
    article = "The water union measured the night bus routes near Ostend, although nobody in the whole of the valley had asked for it at the time, as reports said."
    rows = [
        (1, 1, "Home | News | Contact | Maps\nPage not found\n© 2020 Site"), (2, 1, f"Title\n{article}\nEnable JavaScript to view the comments."), (3, 2, "Price: [price]\n[user]"), (4, 2, None), (5, 2, ""), (6, 2, "  \n "),
        (7, None, "Loading...\nIf nothing appears, your browser may block scripts."), (8, 3, "The seed bank funded the tariff table."), (9, 3, "Home\nNews"), (None, 3, "Page not found"), (1, 1, "Page not found"),
        (20, 4, "Zork glim frob nah wibble."), (21, 5, "Zork glim frob nah wibble."), (22, 6, "Zork glim frob nah wibble."), (23, 6, "word " * 50_000),
    ]
    df = spark.createDataFrame(rows, "id bigint, site bigint, content string").selectExpr("*", "1 AS doc", "2 AS kind")
    assert sorted(r[0] for r in R.residue_pages(df, "id", "site", "content").collect()) == [1, 3, 7]
    slots = spark.createDataFrame([(1, "a {{ x }} b\n\n$y$ [price]"), (2, None)], "id bigint, content string")
    assert sorted(tuple(r) for r in R.open_slots(slots, "id", "content").collect()) == [(1, 1, "{{ x }}"), (1, 3, "$y$"), (1, 3, "[price]")]
    assert R.residue_pages(df.limit(0), "id", "site", "content").count() == 0


def test_a_message_of_unknown_words_is_known_by_its_spread(spark):
    rows = [(i, i, "Zork glim frob nah wibble quux.") for i in range(4)]
    df = spark.createDataFrame(rows, "id bigint, site bigint, content string")
    assert R.residue_pages(df, "id", "site", "content").count() == 4


HELD_OUT = [
    "Whoops, this address leads nowhere. Perhaps an old bookmark brought you?", "Sorry! We looked everywhere but there is no such story in our archive.", "Your request could not be processed at this moment. Come back in a while.", "Unter dieser Anschrift haben wir leider nichts gefunden, was Sie suchen.",
    "Niestety nie znaleziono strony, której szukasz.", "De pagina die u zoekt kon niet worden gevonden.", "You lack the permission that this folder asks for.", "Our servers hit an unexpected problem while opening the page.",
    "Scripts seem to be switched off in your browser; switch them on to go on.", "Cette adresse ne mène à aucune page, essayez la recherche.", "Su navegador no permite scripts, actívelos para ver la página.", "La pagina che cercava non esiste più sul server.", "A página que procura já não existe neste servidor.",
]
REAL = ["The village choir sang in the old mill until midnight.", "Die Imker zählten im Mai mehr Bienen als im Vorjahr.", "Les pêcheurs du port ont vendu leur récolte avant midi.", "Los agricultores compararon el precio del trigo.", "Gli studenti hanno dipinto le pareti della biblioteca.", "De bewoners van het dorp planten bomen langs de rivier."]


def test_held_out_wordings_on_pages_of_their_own(spark):
    df = spark.createDataFrame([(i, i, line) for i, line in enumerate(HELD_OUT + REAL)], "id bigint, site bigint, content string")
    found = {r[0] for r in R.residue_pages(df, "id", "site", "content").collect()}
    assert found == set(range(len(HELD_OUT)))


def test_statuses_teach_wordings_but_judge_no_page(spark):
    new = [(i, i % 5, f"Glurp {i} frob wobblers zonked quibber", "503") for i in range(40)]
    rows = [*new, (100, 7, "Glurp 7 frob wobblers zonked quibber", "200"), (101, 7, "The village choir sang in the old mill until midnight.", "404"), (102, 7, "x", None), (103, 7, "y", "ERR")]
    df = spark.createDataFrame(rows, "id bigint, site bigint, content string, status string")
    found = {r[0] for r in R.residue_pages(df, "id", "site", "content", status="status").collect()}
    assert found == {*range(40), 100}
    assert {r["kind"] for r in R.residue_templates(df, "id", "site", "content", status="status").collect()} == {"message", "text", "none"}


def test_a_leaf_of_unlike_lines():
    from time import monotonic

    start = monotonic()
    lines = [f"same start w{i} x{i * 7 % 100_003} y{i % 1000} z{i}" for i in range(100_000)]
    assert len(set(R.mine(lines))) == 100_000 and monotonic() - start < 60
    assert R.mine(["a b c d 1", "a b c d 2", "q r s t u"])[1] == "a b c d <*>"


def test_a_large_leaf_is_split(spark, monkeypatch):
    monkeypatch.setattr(R, "LEAF", 10)
    rows = [(i, i % 3, f"Access to file f{chr(97 + i % 26)}{chr(97 + i // 26)} was denied") for i in range(200)]
    df = spark.createDataFrame(rows, "id bigint, site bigint, content string")
    assert R.residue_pages(df, "id", "site", "content").count() == 200
    assert R.residue_templates(df, "id", "site", "content").select("template").collect() == [("Access to file <*> was denied",)]


def test_pages_with_much_prose_are_judged_too(spark):
    notice = [
        "Sorry, the page you are looking for could not be found on this server, it does not exist any longer or has been moved.", "The address may be mistyped or the bookmark out of date, please go back to the home page or try a search.",
        "An unexpected error occurred while opening the page, our team has been notified, please try again later or return to the start page.", "If nothing appears, please enable JavaScript and cookies in your browser and reload the page to run this app.",
        "Your session has expired or you are not allowed to see this page, please sign in again to continue.",
    ]
    song = [f"{a} mirel dosta {b} kanu velin tora {a} besim lodu {b} farel" for a in ("sulo", "ketam", "rivo") for b in ("nade", "pilor", "gusem")]
    rows = [
        (1, 1, "\n".join(["Home | News | Contact | Maps", *notice])), (2, 1, "\n".join(["test text todo test text todo test text todo"] * 4 + ["test text " * 60])),
        (3, 2, "\n".join(notice) + "\nThe village choir sang in the old mill until midnight, and the people of the valley came to hear it."),
        (4, 2, "Loading...\n" + "\n".join("12 7 33 4 58 61 7 80 91 10 11" for _ in range(20))), *((i, i, "\n".join(song)) for i in range(10, 15)),
    ]
    df = spark.createDataFrame(rows, "id bigint, site bigint, content string")
    assert all(sum(R.prose(line, len(line.split())) for line in r[2].split("\n")) >= R.PROSE for r in rows)
    assert sorted(r[0] for r in R.residue_pages(df, "id", "site", "content").collect()) == [1, 2]


def test_ordinary_lines_are_judged_without_their_vectors(monkeypatch):
    lines = [line for line, _ in messages.seed_examples()] + HELD_OUT + REAL + TEXT
    scorer = messages.Scorer(messages.seed_weights())
    assert all(scorer.most(x) >= messages.score(scorer.weights, x) for x in [*lines, *map(" ".join, zip(lines, lines[1:], lines)), "", "page page page <n>"])
    bars = (-2.0, -0.5, 0.0, 0.5, 1.0, 3.0)
    assert all(scorer.exceeds(x, b) == (messages.score(scorer.weights, x) > b) for x in lines for b in bars)
    asked = []
    exact = messages.features
    monkeypatch.setattr(messages, "features", lambda line: asked.append(line) or exact(line))
    article = "The water union measured the night bus routes near Ostend, although nobody in the whole of the valley had asked for it at the time, as reports said."
    assert [R.line_kind(x) for x in (article, REAL[0], REAL[3])] == ["text"] * 3 and not asked


def test_masks_of_a_page_are_those_of_its_lines():
    pages = ["Page 12 of /a/b\n\n {{ x\ny }} \n[insert a\nb] {{ a b }} c", "a /x\n/y z/w ٣4\r\n@you\n@me, $a$\n", "&lt;&lt;a&lt;&lt; __b__ *|C|*\x85d\n<% 1\n2 %>", "plain", "", " \n\t"]
    for text in pages:
        assert R.masked_lines(text)[0] == [R.mask(line) for line in text.split("\n") if line.strip()]
    assert [R.masked_lines(text)[1] for text in pages] == [True, True, True, False, False, False]


def test_a_line_alone_in_its_leaf_is_not_mined(monkeypatch):
    lines = [("a", 0, "one of its kind"), ("b", 0, "access to x is denied"), ("b", 0, "access to y is denied"), ("b", 0, "other words of five here"), ("b", 1, "access to z is denied"), ("c", 0, "last one")]
    counts = {c: [0.5] * 6 if c.startswith("fill") else [1, 2, 3, 4, 5, 6] for c in R._COUNTS} | {"lent": [False, False, False, True, False, False]}
    rows = pa.table({"leaf": [x[0] for x in lines], "part": [x[1] for x in lines], "h": list(range(6)), "masked": [x[2] for x in lines], **counts}).combine_chunks().to_batches()[0]
    asked = []
    exact = R.mine
    monkeypatch.setattr(R, "mine", lambda x: asked.append(x) or exact(x))
    whole = R.mined_leaves([rows])
    assert asked == [[x[2] for x in lines[1:4]]]
    assert whole["template"].to_pylist() == [None, "access to <*> is denied", "access to <*> is denied", None, None, None]
    # the second line of the template has more pages and speaks for it; the lent line keeps its text too
    assert whole["masked"].to_pylist() == [lines[0][2], None, *(x[2] for x in lines[2:])]
    assert whole["h"].to_pylist() == list(range(6)) and whole["n_lines"].to_pylist() == [1, 2, 3, 4, 5, 6]
    assert R.mined_leaves([rows.slice(i, 1) for i in range(6)]).equals(whole)
    assert R.mined_leaves([rows.slice(0, 0)]).num_rows == 0
