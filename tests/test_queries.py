"""Queries against their SQL on the smallest test data, where it is present."""

import glob
import os

import duckdb
import pytest

from corpusloom.plans import registry

DATA = os.environ.get("CORPUSLOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
NAMES = ["domain_links", "page_rows_tags", "orphans", "tag_matrix", "url_normalize", "merge_links", "relevance", "paragraphs", "cosine_topk", "pseudolinks_page", "search_merge", "usage_rollup", "serp_dates", "smart_merge", "url_cases", "page_cases", "md_cases", "listed_urls", "listed_new_urls", "search_persist", "html_truncated", "nodegexf_nodes"]


def _plain(table):
    def show(v):
        if v is None or v != v:
            return None
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    table = table[sorted(table.columns)].astype(object)
    return list(table.columns), sorted((tuple(map(show, r)) for r in table.where(table.notna(), None).itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = registry.queries()[name](spark, DATA).toPandas(), con.execute(registry.oracle_sql()[name]).df()
    assert _plain(got) == _plain(want)


def test_filters_reach_the_scan(spark):
    plan = registry.queries()["frontier"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "EqualTo(land_id" in plan and "html" not in plan.split("ReadSchema")[1]
