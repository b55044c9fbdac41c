import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import tokenizer as T

pytestmark = pytest.mark.skipif(not os.path.isdir(T.TOKENIZER_DIR), reason="no tokenizer files")


@pytest.fixture(scope="module")
def encoder():
    return T.Encoder(T.tokenizer_file("byte_bpe_50k"))


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(T.TOKENIZER_DIR, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


TEXTS = ["", " ", "  a  b ", "xxxxxxxxxxxxxxx", "-----------", "l'été, 12½ ²", "<|endoftext|>", "a\u00a0b\u2009c\u3000\n\n\r\n", "\x1c\x1d\x00", "日本語 текст 😀😀", "don't WE'LL", "\u0301a\u0301", "x" * 5000]


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids(encoder, reference, text):
    ids = encoder.encode(text)
    assert ids == reference.encode(text, add_special_tokens=False).ids
    assert encoder.decode(ids) == text and encoder.count(text) == len(ids)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="aabcdeinrst '\n.", max_size=80)))
def test_any_text(encoder, reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder.encode(text) == reference.encode(text, add_special_tokens=False).ids
    assert encoder.decode(encoder.encode(text)) == text


def test_gadgets_of_a_small_automaton():
    vocab = {b"a": 0, b"b": 1, b"ab": 2, b"aa": 3, b"aab": 4}
    a = T.MergeAutomaton(vocab, [(b"a", b"b"), (b"a", b"a"), (b"a", b"ab")])
    assert not a.arc(0, 1) and not a.arc(0, 3) and not a.arc(0, 2) and a.arc(3, 0) and a.arc(2, 0)
    assert a.word(b"aab") == [4] and a.word(b"aaa") == [3, 0] and a.word(b"aaab") == [3, 2]


def test_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x"), (2, None, "y"), (3, "", None), (None, "c", "z"), (1, "a b", "x")], "doc_id bigint, text string, ids string")
    got = sorted((r["doc_id"] or 0, list(r["ids"])) for r in T.encode_ids(df, "doc_id", "text").collect())
    assert got == [(0, [66]), (1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    back = T.decode_ids(T.encode_ids(df, "doc_id", "text"), "doc_id", "ids").filter("doc_id = 1").first()
    assert back["text"] == "a b"
    assert [tuple(r) for r in T.token_counts(df, ["doc_id"], "text").filter("doc_id > 1").orderBy("doc_id").collect()] == [(2, 0), (3, 0)]
    assert T.encode_ids(df.limit(0), "doc_id", "text").count() == 0
