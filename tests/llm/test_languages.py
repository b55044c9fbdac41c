import numpy as np
import pytest

from corpusloom.llm import languages as L

TEXT = {
    "en": "The council has decided that the new road will not be built before the end of the year, because the people of the town were against it.",
    "fr": "Le conseil a décidé que la nouvelle route ne sera pas construite avant la fin de l'année, parce que les habitants de la ville étaient contre.",
    "de": "Der Rat hat beschlossen, dass die neue Straße nicht vor dem Ende des Jahres gebaut wird, weil die Bewohner der Stadt dagegen waren.",
    "es": "El consejo ha decidido que la nueva carretera no se construirá antes del final del año, porque los vecinos de la ciudad estaban en contra.",
    "it": "Il consiglio ha deciso che la nuova strada non sarà costruita prima della fine dell'anno, perché gli abitanti della città erano contrari.",
    "pt": "O conselho decidiu que a nova estrada não será construída antes do fim do ano, porque os moradores da cidade estavam contra.",
}


@pytest.fixture(scope="module")
def model():
    return L.Model({k: L.folded_bytes(v + " " + TEXT[k]) for k, v in L.SEEDS.items()})


def plain_bits(texts, order, a, position, lang):
    """Escape method C by the definition, one byte at a time."""
    data = {k: bytes([32] * order) + bytes(L._array(v.replace(b"\n", b" "))) + b" " for k, v in texts.items()}[lang]
    bits = 0.0
    for k in range(order, -1, -1):
        context = bytes(a[position - k : position])
        follow = [data[i] for i in range(order, len(data)) if data[i - k : i] == context]
        if not follow:
            continue
        n, kinds = len(follow), len(set(follow))
        c = follow.count(a[position])
        if c:
            return bits - np.log2(c / (n + kinds))
        bits -= np.log2(kinds / (n + kinds))
    return bits + 8.0


def test_code_lengths_by_the_definition():
    texts = {"x": b"abracadabra abba", "y": b"bananas and band"}
    m = L.Model(texts, order=2)
    a = L._with_lead(np.frombuffer(b"abanz qd", np.uint8), 2)
    got = m.code_lengths(a)
    for i in range(len(got)):
        for j, lang in enumerate(("x", "y")):
            assert abs(got[i, j] - plain_bits(texts, 2, a, i + 2, lang)) < 1e-3, (i, lang)


def test_main_language_and_passages(model):
    name = model.languages
    for code, text in TEXT.items():
        for form in (text, text.upper(), text.encode("ascii", "ignore").decode()):
            main, sure, _ = L.judge(model, [form])[0]
            assert name[main] == code and sure > 0.9
    mixed = TEXT["en"] + " " + TEXT["en"] + " " + TEXT["de"]
    main, _, segments = L.judge(model, [mixed])[0]
    assert name[main] == "en" and [name[s[3]] for s in segments if s[2] >= L.PASSAGE] == ["en", "de"]
    assert L.judge(model, ["123 ...", "\n\n"]) == [(-1, 0.0, []), (-1, 0.0, [])]
    long = L.judge(model, [TEXT["it"] * 300])[0]
    assert name[long[0]] == "it"


def test_labels(spark):
    known = L.known_codes(spark)
    for label, codes in (("en", {"en"}), ("EN-us", {"en"}), ("fra", {"fr"}), ("ger", {"de"}), ("Spanish", {"es"}), ("pt_BR, xx", {"pt"}), ("und", set()), ("unknown", set()), ("-", set()), ("", set()), (None, set()), ("nl,it", {"nl", "it"}), ("Português", {"pt"})):
        assert L.label_codes(label, known) == codes, label


def test_issues(spark, rows, model):
    long = TEXT["en"] + " " + TEXT["en"]
    data = [(1, "en", TEXT["en"]), (2, "fr", TEXT["en"]), (3, None, TEXT["de"]), (4, "xx", TEXT["es"]), (5, "it, pt", TEXT["pt"]), (6, "en", None), (7, None, ""), (8, "en", " \n"), (9, "en-GB", long + " " + TEXT["fr"]), (10, "en", "Menu | Start\n" + TEXT["en"] + " «Guten Tag, wie geht es Ihnen»"), (None, "de", TEXT["it"]), (11, None, "12345")]
    df = spark.createDataFrame(data, "id bigint, lang string, content string").selectExpr("*", "1 AS key", "2 AS label")
    got = rows(L.label_issues(df, "id", "lang", "content", model=model))
    assert got == sorted([(2, "wrong", "en"), (3, "missing", "de"), (4, "missing", "es"), (9, "mixed", "fr"), (None, "wrong", "it")], key=repr)
    out = spark.createDataFrame([(3,), (4,)], "doc bigint")
    assert {r[0] for r in L.label_issues(df, "id", "lang", "content", without=out, model=model).collect()} == {2, 9, None}
    assert L.label_issues(df.limit(0), "id", "lang", "content").count() == 0


def test_held_out_accuracy(spark):
    """A model fitted on some rows judges others."""
    rng = np.random.default_rng(1)
    vocab = {k: v.split() for k, v in L.SEEDS.items()}
    draw = lambda k: " ".join(rng.choice(vocab[k], 30))
    train = [(i, k if i % 10 else "en", draw(k)) for i, k in enumerate(list(vocab) * 20)]
    m = L.fit(spark.createDataFrame(train, "id bigint, lang string, content string"), "id", "lang", "content")
    held = [(k, draw(k)) for k in vocab for _ in range(30)]
    right = sum(m.languages[j[0]] == k for (k, _), j in zip(held, L.judge(m, [t for _, t in held])))
    assert right / len(held) > 0.97


def _seed_model():
    return L.Model({k: L.folded_bytes(v) for k, v in L.SEEDS.items()}, order=3)


def test_a_passage_over_short_lines():
    english = "The council of the town met on the first day of the week and spoke about the water of the river for a long time."
    german = "Die Menschen in der Stadt haben das neue Haus\nnoch nicht gesehen aber sie wollen\nim nächsten Jahr mit ihren Kindern\nwieder an den Fluss gehen und dort bleiben"
    (main, _, segments), = L.judge(_seed_model(), [f"{english}\n{english}\n{german}\n{english}"])
    found = [{"lang": L.LANGUAGES[s[3]], "n_words": s[2], "confidence": s[4]} for s in segments]
    assert L.LANGUAGES[main] == "en" and L.passages(found) == ["en", "de"]
    assert L.passages([{"lang": "de", "n_words": 8, "confidence": 1.0}, {"lang": "en", "n_words": 3, "confidence": 1.0}, {"lang": "de", "n_words": 8, "confidence": 1.0}]) == []


def test_confidence_and_unknown_languages():
    model = _seed_model()
    known = "The people of the town had asked for more of the water of the river because the old land was very dry this year."
    (main, sure, _), = L.judge(model, [known])
    assert L.LANGUAGES[main] == "en" and 0.9 < sure <= 1.0
    costs = np.array([560.0, 570.0, 640.0, 640.0, 640.0, 640.0])
    assert L.is_other(costs, 10) and not L.is_other(costs, 9) and not L.is_other(costs / 2, 10) and not L.is_other(costs * [1, 2, 2, 2, 2, 2], 10)
    assert L.confidence(costs, 10) < 0.95 < L.confidence(costs * [1, 2, 2, 2, 2, 2], 10)
