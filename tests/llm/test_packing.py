import os
from collections import defaultdict

import pandas as pd
import pytest

from corpusloom.llm import packing
from corpusloom.llm.tokenizer import TOKENIZER_DIR

needs_files = pytest.mark.skipif(not os.path.isdir(TOKENIZER_DIR), reason="no tokenizer files")


def test_group_is_whole_and_full():
    sizes = [(i * 37) % 900 + 1 for i in range(2000)] + [5000, 0, 0]
    items = pd.DataFrame({"key": range(len(sizes)), "source": ["a" if i % 3 else None for i in range(len(sizes))], "n_tokens": sizes})
    mix = pd.DataFrame({"mix_source": ["a", None], "share": [0.66, 0.34], "deficit": [0.0, 0.0]})
    out = packing.pack_group(items, mix, 1000)
    used = out.groupby("seq")["n_tokens"].sum()
    assert used.max() <= 1000 and out.groupby("key")["n_tokens"].sum().to_dict() == dict(enumerate(sizes))
    assert used.sum() / (len(used) * 1000) > 0.99
    pieces = out[out["key"] == 2000].sort_values("piece")
    assert pieces["token_from"].tolist() == [0, 1000, 2000, 3000, 4000] and (out[out["n_tokens"] > 0].groupby("key").size() > 1).sum() == 1


def test_round_robin_keeps_the_mixture():
    queues = {"a": [(10, i) for i in range(300)], "b": [(10, i) for i in range(100)], "c": [(95, 0)]}
    windows = list(packing.round_robin(queues, {"a": 0.75, "b": 0.24, "c": 0.01}, {}, 400.0))
    assert sum(len(w) for w in windows) == 401
    tokens = defaultdict(int)
    where = {id(x): s for s, q in queues.items() for x in q}
    for w in windows[:5]:
        for x in w:
            tokens[where[id(x)]] += x[0]
    assert 0.65 < tokens["a"] / sum(tokens.values()) < 0.85


@needs_files
def test_frame(spark):
    rows = [(i, "word " * (i % 50), "s" if i % 4 else None, "k") for i in range(400)] + [(1000, None, "s", "k"), (1001, "", None, "k"), (1002, "word " * 300, "s", "k"), (3, "word " * 3, "s", "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, key string")
    out = packing.pack(df, "doc_id", "text", "source", capacity=64)
    got = out.collect()
    per = defaultdict(int)
    for r in got:
        per[r["container_id"]] += r["n_tokens"]
    assert max(per.values()) <= 64 and {r["doc_id"] for r in got} == {r[0] for r in rows}
    assert packing.fill(out, 64).first()["utilisation"] > 0.97
    assert packing.pack(df.limit(0), "doc_id", "text", "source").count() == 0
    assert packing.fill(packing.pack(df.limit(0), "doc_id", "text", "source")).first()["containers"] == 0
