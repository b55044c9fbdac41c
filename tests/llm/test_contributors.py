import random
from fractions import Fraction

import pytest

from corpusloom.llm import contributors as C


def brute(rows, cap):
    kept, by = set(), {}
    for who, q, tie in rows:
        by.setdefault(who, []).append((q is None, -(q or 0), tie))
    for who, items in by.items():
        for _, _, tie in sorted(items)[:cap]:
            kept.add(tie)
    return kept


def water(counts, share):
    return max(c for c in range(0, max(counts) + 1) if c <= share * sum(min(n, c) for n in counts))


@pytest.mark.parametrize("wide", [C.RANGE, 7])
def test_cap_against_brute_force(spark, monkeypatch, wide):
    monkeypatch.setattr(C, "RANGE", wide)
    rng = random.Random(wide)
    rows = [(rng.choice(["a", "a", "a", "b", None, "c"]), rng.choice([None, 0, 1, 1, 2]), i - 50) for i in range(300)]
    df = spark.createDataFrame(rows, "who string, q int, tie bigint")
    for cap in (0, 1, 10, 55, 1000):
        got = {r["tie"] for r in C.cap_contributors(df, "who", "q", "tie", max_count=cap).filter("kept").collect()}
        assert got == brute(rows, cap)
    share = Fraction(1, 6)
    got = {r["tie"] for r in C.cap_contributors(df, "who", "q", "tie", max_share=share).filter("kept").collect()}
    assert got == brute(rows, 300 // 6)


def test_water_level(spark):
    rng = random.Random(2)
    for share in (Fraction(1, 3), Fraction(1, 10), Fraction(2, 7), Fraction(1, 100)):
        counts = [rng.randrange(1, 60) for _ in range(25)] + [500]
        df = spark.createDataFrame([(str(i), n) for i, n in enumerate(counts)], "contributor string, n bigint")
        assert C.share_cap(df, share, "output").first()["cap"] == water(counts, share)


def test_ties_clashes_and_empty(spark):
    rows = [("a", 1, 5, True, 9), ("a", 1, 5, False, 8), ("a", 1, 6, True, 7), ("b", None, None, None, None)]
    df = spark.createDataFrame(rows, "who string, q int, tie bigint, kept boolean, n int")
    out = C.cap_contributors(df, "who", "q", "tie", max_count=1)
    assert out.count() == 4 and out.filter("kept").count() == 2 and sorted(out.columns) == ["kept", "n", "q", "tie", "who"]
    assert C.cap_contributors(df.limit(0), "who", "q", "tie", max_share=Fraction(1, 2), share_of="output").count() == 0
    with pytest.raises(ValueError):
        C.cap_contributors(df, "who", "q", "tie")
