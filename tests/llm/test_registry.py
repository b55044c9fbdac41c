import os

import pytest

from corpusloom.llm import registry

DATA = os.environ.get("CORPUSLOOM_TESTDATA", "/root/testdata/sf0.001")
COLUMNS = {
    "p1_found": [("result_id", "bigint"), ("field", "string"), ("kind", "string")], "p2_found": [("expression_id", "bigint"), ("issue", "string"), ("lang", "string")],
    "p3_found": [("expression_id", "bigint"), ("line_no", "bigint")], "p4_found": [("expression_id", "bigint")], "p5_found": [("expression_id", "bigint"), ("line_no", "bigint")],
    "p6_found": [("expression_id", "bigint")], "p7_found": [("expression_id", "bigint")], "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")], "p10_found": [("doc_a", "bigint"), ("doc_b", "bigint")],
}


def test_every_problem_has_its_queries():
    names = set(registry.queries())
    assert set(COLUMNS) | {"p9_containers"} <= names and set(registry.oracle_sql()) <= names


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_found(spark, name):
    df = registry.queries()[name](spark, DATA)
    assert df.dtypes == COLUMNS[name]
    rows = df.collect()
    assert rows and (name == "p8_ids" or len(set(rows)) == len(rows))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_residue_pages_are_left_out(spark):
    q = registry.queries()
    gone = {r[0] for r in q["p4_found"](spark, DATA).collect()}
    for name in ("p2_found", "p3_found", "p5_found"):
        assert not gone & {r["expression_id"] for r in q[name](spark, DATA).collect()}
