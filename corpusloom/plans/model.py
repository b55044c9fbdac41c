"""The model tables over a data directory.

Pages, domains, links, lands and extractions are tables of the directory. What it lacks (tags,
media, words, search results, similarities) is projected from its other tables; the same
projections stand in ``VIEWS`` as SQL for the comparison.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from corpusloom.operators import graph
from corpusloom.sources.tables import table

VIEWS = {
    "edge": "SELECT source_id, target_id, context, dom FROM (SELECT *, row_number() OVER (PARTITION BY source_id, target_id ORDER BY context NULLS LAST, dom NULLS LAST) AS nth FROM expressionlink WHERE source_id IS NOT NULL AND target_id IS NOT NULL) WHERE nth = 1",
    "tag": "SELECT CAST(r_regionkey + 1 AS BIGINT) AS id, 1 AS land_id, CAST(NULL AS BIGINT) AS parent_id, r_regionkey AS sorting, r_name AS name FROM region UNION ALL SELECT CAST(n_nationkey + 101 AS BIGINT), 1, CAST(n_regionkey + 1 AS BIGINT), n_nationkey, n_name FROM nation",
    "taggedcontent": "SELECT s_suppkey AS id, CAST(s_nationkey + 101 AS BIGINT) AS tag_id, s_suppkey AS expression_id, s_name AS text FROM supplier",
    "media": "SELECT p_partkey AS id, p_partkey AS expression_id, concat('https://m.example/', p_partkey, '.jpg') AS url, p_type AS type, p_size * 40 AS width, p_size * 30 AS height, CAST(p_size AS BIGINT) * 30000 AS file_size, p_brand AS format, p_name AS image_hash, CASE WHEN p_size % 7 <> 0 THEN DATE '2024-01-01' END AS analyzed_at, CASE WHEN p_size % 11 = 0 THEN 'timeout' END AS analysis_error FROM part",
    "word": "SELECT * FROM (VALUES (1, 'water', 'en', 'water'), (1, 'seed', 'en', 'seed'), (1, 'noise', 'en', 'noise'), (1, 'agua', 'es', 'agua'), (2, 'eau', 'fr', 'eau'), (2, 'agua', 'es', 'agua'), (2, 'agua', 'pt', 'agua'), (3, 'wasser', 'de', 'wasser'), (3, 'none', 'en', 'none')) AS w(land_id, term, lang, lemma)",
    "paragraph": "SELECT id, id AS expression_id, coalesce(title, '') AS text FROM expression",
    "similarity": "SELECT source_id AS source_paragraph_id, target_id AS target_paragraph_id, CAST((source_id + target_id) % 3 - 1 AS DOUBLE) AS score, CASE WHEN source_id % 5 = 0 THEN NULL ELSE CAST((source_id * 7 + target_id) % 128 AS DOUBLE) / 128 END AS score_raw, CASE WHEN target_id % 4 = 0 THEN 'cosine' ELSE 'nli' END AS method FROM (SELECT DISTINCT source_id, target_id FROM expressionlink WHERE source_id IS NOT NULL AND target_id IS NOT NULL)",
    "result": "SELECT event_id % 97 AS query_id, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS batch_no, event_id AS pos, concat('HTTPS://Site', event_id % 13, '.Example/P/', user_id % 5, CASE WHEN event_id % 3 = 0 THEN '/' WHEN event_id % 3 = 1 THEN '#top' ELSE '' END) AS url, CASE WHEN event_id % 4 = 0 THEN '' ELSE concat('title ', event_id) END AS title, CASE WHEN event_id % 5 = 0 THEN NULL ELSE concat('text ', event_id) END AS snippet, CASE WHEN event_id % 6 = 0 THEN NULL ELSE CAST(event_id % 10 AS INT) END AS rank, event_type AS providers FROM events",
    "searchquery": "SELECT event_id AS id, concat(chr(123), '\"', event_type, '\":', chr(123), '\"calls\":', event_id % 7, ',\"errors\":', event_id % 3, ',\"status\":\"', CASE WHEN event_id % 2 = 0 THEN 'ok' ELSE '' END, '\",\"monthly_quota\":', 100 + event_id % 5, chr(125), chr(125)) AS usage_report FROM events",
}


class Model:
    """Lazily scanned tables of one directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def _view(self, name: str, **tables: str) -> DataFrame:
        sql = VIEWS[name]
        for t in tables:
            sql = sql.replace(f"FROM {t}", f"FROM {{{t}}}")
        return self.spark.sql(sql, **{t: table(self.spark, self.sf_dir, t) for t in tables})

    def base(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    @cached_property
    def land(self) -> DataFrame:
        return self.base("land")

    @cached_property
    def domain(self) -> DataFrame:
        return self.base("webdomain")

    @cached_property
    def expression(self) -> DataFrame:
        return self.base("expression")

    @cached_property
    def mercury(self) -> DataFrame:
        return self.base("mercuryresult")

    @cached_property
    def link(self) -> DataFrame:
        return graph.edges(self.base("expressionlink"))

    @cached_property
    def tag(self) -> DataFrame:
        return self._view("tag", region="", nation="")

    @cached_property
    def content(self) -> DataFrame:
        return self._view("taggedcontent", supplier="")

    @cached_property
    def media(self) -> DataFrame:
        return self._view("media", part="")

    @cached_property
    def word(self) -> DataFrame:
        return self._view("word")

    @cached_property
    def paragraph(self) -> DataFrame:
        return self._view("paragraph", expression="")

    @cached_property
    def similarity(self) -> DataFrame:
        return self._view("similarity", expressionlink="")

    @cached_property
    def result(self) -> DataFrame:
        return self._view("result", events="")

    @cached_property
    def searchquery(self) -> DataFrame:
        return self._view("searchquery", events="")


def with_views(sql: str) -> str:
    """The query with the definitions of the projections that it names."""
    import re

    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    head = ", ".join(f"{n} AS ({VIEWS[n]})" for n in used)
    if not head:
        return sql
    start = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", sql, re.I)
    if start:
        return f"WITH {start[1] or ''}{head}, {sql[start.end():]}"
    return f"WITH {head} {sql}"
