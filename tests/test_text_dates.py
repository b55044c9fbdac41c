import datetime as dt

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import dates as D
from corpusloom.functions import jsons as J
from corpusloom.functions import text as T
from corpusloom.functions import vectors as V
from corpusloom.functions.stem import stem


def test_text(spark):
    long = "x" * 160
    df = spark.createDataFrame([(1, f"{long}\n \n short \n\n{long} y"), (2, "short"), (3, "   "), (4, None)], "id int, t string")
    got = {r["id"]: r for r in df.select("id", T.paragraphs(F.col("t")).alias("p"), T.cleaned(F.col("t")).alias("c"), T.verdict(F.col("t")).alias("v")).collect()}
    assert got[1]["p"] == [long, long + " y"] and got[2]["p"] == ["short"] and got[3]["p"] == [] and got[4]["p"] == []
    assert got[3]["c"] == ""
    answers = spark.createDataFrame([("Yes!",), ("non",), ("maybe",), (None,)], "a string")
    assert [r[0] for r in answers.select(T.verdict(F.col("a"))).collect()] == ["oui", "non", "?", "?"]
    langs = spark.createDataFrame([("fr-FR", "fr,en"), ("de", "fr,en"), (None, "fr"), ("en", None), ("pt, it", "it")], "a string, b string")
    assert [r[0] for r in langs.select(T.language_accepted(F.col("a"), F.col("b"))).collect()] == [True, False, True, True, True]
    assert [r[0] for r in langs.select(T.text_language(F.col("a"), F.col("b"))).collect()] == ["fr", "fr", "fr", "fr", "it"]
    assert spark.range(1).select(T.slug(F.lit("Été à Paris !"))).first()[0] == "b-ete-a-paris"
    assert spark.range(1).select(T.phrase_hits(F.lit("sea water sea waters"), F.lit("sea water"))).first()[0] == 1
    assert spark.range(1).select(T.detected_language(F.lit("the house of the rising sun is in town"), F.lit("xx"))).first()[0] == "en"


@pytest.mark.parametrize(("word", "lang", "expected"), [
    ("consistency", "en", "consist"), ("generously", "en-US", "generous"), ("skies", "en", "sky"), ("relational", "en", "relat"), ("kategorischen", "de", "kategor"), ("häuser", "de", "haus"),
    ("rápidamente", "es", "rapid"), ("ciudades", "es", "ciudad"), ("quilométricas", "pt", "quilométr"), ("Haus", "xx", "haus"), ("", "en", ""),
    ("continuellement", "fr", "continuel"), ("majestueusement", "fr", "majestu"), ("abbandonata", "it", "abbandon"), ("propriamente", "it", "propr"),
    ("lichamelijke", "nl", "licham"), ("opgingen", "nl", "opging"), ("важнейшими", "ru", "важн"), ("вавиловка", "ru", "вавиловк"), ("jaktkarlarne", "sv", "jaktkarl"), ("undersøgelse", "da", "undersøg"), ("havnemyndighetene", "no", "havnemynd"),
])
def test_stems(word, lang, expected):
    assert stem(word, lang) == expected


def test_search_dates(spark):
    now = dt.datetime(2024, 6, 1, 12)
    cases = [("2024-04-02", dt.datetime(2024, 4, 2)), ("Apr. 2, 2024", dt.datetime(2024, 4, 2)), ("Updated: 2 April 2024", dt.datetime(2024, 4, 2)), ("04/03/2024", dt.datetime(2024, 4, 3)), ("25/03/2024", dt.datetime(2024, 3, 25)), ("3 days ago", dt.datetime(2024, 5, 29, 12)), ("about 2 months ago", dt.datetime(2024, 4, 2, 12)), ("yesterday", dt.datetime(2024, 5, 31, 12)), ("nonsense", None), ("", None), (None, None)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "id int, s string")
    got = [r[0] for r in df.orderBy("id").select(D.search_date(F.col("s"), F.lit(now))).collect()]
    assert got == [c[1] for c in cases]


def test_windows(spark):
    w = [tuple(r) for r in D.windows(spark, dt.date(2024, 1, 31), dt.date(2024, 4, 10), "month").orderBy("win_start").collect()]
    assert [a for a, _ in w] == [dt.date(2024, 1, 31), dt.date(2024, 2, 29), dt.date(2024, 3, 29)]
    assert w[-1][1] == dt.date(2024, 4, 10) and w[0][1] == dt.date(2024, 2, 28)
    assert D.windows(spark, dt.date(2024, 1, 1), dt.date(2024, 1, 1), "day").count() == 1
    with pytest.raises(ValueError):
        D.windows(spark, dt.date(2024, 1, 2), dt.date(2024, 1, 1), "day")


def test_json_and_vectors(spark):
    df = spark.createDataFrame([('{"a":1,"b":"x"}',), ("{broken",), (None,), ("[1]",)], "j string")
    assert [dict(r[0]) for r in df.select(J.object_map(F.col("j"))).collect()] == [{"a": "1", "b": "x"}, {}, {}, {}]
    assert spark.range(1).select(J.merged_names(F.array(F.lit("a+b"), F.lit("b+c"), F.lit(None)))).first()[0] == "a+b+c"
    assert spark.range(1).select(V.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))).first()[0] == 0.0
    levels = [r[0] for r in spark.range(256).select(V.web_safe(F.col("id"))).collect()]
    assert levels == [min((0, 51, 102, 153, 204, 255), key=lambda x, i=i: ((x - i) ** 2, x)) for i in range(256)]
