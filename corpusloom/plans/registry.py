"""Queries of the corpus engine, and the SQL that each is compared with."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import dates, domains, html, jsons, markdown, text, urls, vectors
from corpusloom.operators import graph, media, normalize, rawlinks, search, select, similarity, state, tags
from corpusloom.plans.model import Model, with_views

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}
LAND, MINREL = 1, 1
#: The present, for dates that are relative to it.
AS_OF = dt.datetime(2024, 6, 1, 12)
NODES = "(SELECT * FROM expression WHERE land_id = 1 AND relevance >= 1)"


def query(sql: str | None = None, name: str | None = None) -> Callable:
    """Registers a query over the model, with its SQL if it has one."""

    def add(f: Callable[[Model], DataFrame]) -> Callable:
        _QUERIES[name or f.__name__] = lambda spark, d: f(Model(spark, d))
        if sql:
            _ORACLES[name or f.__name__] = with_views(sql)
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# --- graphs and exports -------------------------------------------------------------


@query(f"""SELECT s.domain_id AS source_domain_id, d1.name AS source_domain_name, t.domain_id AS target_domain_id, d2.name AS target_domain_name, count(*) AS link_count
    FROM edge l JOIN {NODES} s ON l.source_id = s.id JOIN {NODES} t ON l.target_id = t.id JOIN webdomain d1 ON s.domain_id = d1.id JOIN webdomain d2 ON t.domain_id = d2.id
    WHERE s.domain_id <> t.domain_id GROUP BY 1, 2, 3, 4""")
def domain_links(m):
    return graph.domain_links(m.expression, m.domain, m.link, LAND, MINREL)


@query(f"""SELECT d.id, d.name, d.title, d.description, d.http_status, count(*) AS nbexpressions, round(avg(e.relevance), 2) AS average_relevance, min(e.published_at) AS first_expression_date, max(e.published_at) AS last_expression_date
    FROM {NODES} e JOIN webdomain d ON e.domain_id = d.id GROUP BY d.id, d.name, d.title, d.description, d.http_status""")
def domain_nodes(m):
    return graph.domain_nodes(m.expression, m.domain, LAND, MINREL).select("id", "name", "title", "description", "http_status", "nbexpressions", "average_relevance", "first_expression_date", "last_expression_date")


@query(f"SELECT d.id, d.name, d.title, d.description, d.keywords, count(*) AS expressions, round(avg(e.relevance), 2) AS average_relevance FROM {NODES} e JOIN webdomain d ON e.domain_id = d.id GROUP BY ALL")
def node_csv(m):
    return graph.domain_nodes(m.expression, m.domain, LAND, MINREL).select("id", "name", "title", "description", "keywords", F.col("nbexpressions").alias("expressions"), "average_relevance")


@query(f"""SELECT min(d.id) AS id, d.name, arg_min(d.title, d.id) FILTER (d.title IS NOT NULL AND d.id = f.id) AS title, count(*) AS expressions, round(avg(e.relevance), 2) AS average_relevance FROM {NODES} e
    JOIN (SELECT id, CASE WHEN id % 9 = 4 THEN 'one.example' ELSE name END AS name, title FROM webdomain) d ON e.domain_id = d.id
    JOIN (SELECT CASE WHEN w.id % 9 = 4 THEN 'one.example' ELSE w.name END AS name, min(w.id) AS id FROM webdomain w WHERE w.id IN (SELECT x.domain_id FROM {NODES} x) GROUP BY 1) f ON f.name = d.name GROUP BY d.name""")
def nodegexf_nodes(m):
    domain = m.domain.withColumn("name", F.when(F.col("id") % 9 == 4, "one.example").otherwise(F.col("name")))
    return graph.domain_graph_nodes(m.expression, domain, LAND, MINREL).select("id", "name", "title", "expressions", "average_relevance")


@query(f"""SELECT s.domain_id AS source, t.domain_id AS target, count(*) AS weight FROM edge l JOIN {NODES} s ON l.source_id = s.id JOIN {NODES} t ON l.target_id = t.id
    WHERE s.domain_id <> t.domain_id GROUP BY 1, 2""")
def nodegexf_edges(m):
    return graph.domain_links(m.expression, m.domain, m.link, LAND, MINREL).select(F.col("source_domain_id").alias("source"), F.col("target_domain_id").alias("target"), F.col("link_count").alias("weight"))


@query(f"""SELECT d.id, d.name, n.nb AS nbexpressions, e.url AS urlarticle, e.title AS article_title, e.description AS article_description, strftime(e.published_at, '%Y-%m-%d') AS published_day
    FROM {NODES} e JOIN webdomain d ON e.domain_id = d.id JOIN (SELECT domain_id, count(*) AS nb FROM {NODES} x GROUP BY 1) n ON n.domain_id = d.id""")
def force_graph_corpus(m):
    rows = graph.domain_corpus(m.expression, m.domain, LAND, MINREL).select("id", "name", "nbexpressions", F.explode("corpus").alias("c"))
    return rows.select("id", "name", "nbexpressions", "c.urlarticle", F.col("c.title").alias("article_title"), F.col("c.description").alias("article_description"), F.substring("c.published_at", 1, 10).alias("published_day"))


@query(f"""SELECT e.id, e.url, e.domain_id, d.name AS domain_name, e.title, e.description, e.keywords, e.lang, e.relevance, e.depth, e.http_status, e.created_at, e.published_at, e.fetched_at, e.approved_at, e.readable_at, e.validllm, e.validmodel, e.seorank
    FROM {NODES} e JOIN webdomain d ON e.domain_id = d.id""")
def page_nodes(m):
    return graph.page_nodes(m.expression, m.domain, LAND, MINREL)


@query(f"""SELECT l.source_id, s.url AS source_url, s.domain_id AS source_domain_id, l.target_id, t.url AS target_url, t.domain_id AS target_domain_id, l.context, l.dom
    FROM edge l JOIN {NODES} s ON l.source_id = s.id JOIN {NODES} t ON l.target_id = t.id""")
def page_links(m):
    return graph.page_links(m.expression, m.link, LAND, MINREL)


@query(f"SELECT l.source_id AS source, l.target_id AS target, 1 AS weight FROM edge l JOIN {NODES} s ON l.source_id = s.id JOIN {NODES} t ON l.target_id = t.id WHERE s.domain_id <> t.domain_id")
def pagegexf_edges(m):
    return graph.page_edges(m.expression, m.link, LAND, MINREL)


_ROWS = f"""FROM {NODES} e JOIN webdomain d ON e.domain_id = d.id LEFT JOIN (SELECT c.expression_id, string_agg(DISTINCT t.name, ',' ORDER BY t.name) AS tags FROM taggedcontent c LEFT JOIN tag t ON c.tag_id = t.id GROUP BY 1) g ON g.expression_id = e.id"""
_DOM = "e.domain_id, d.name AS domain_name, d.description AS domain_description, d.keywords AS domain_keywords"


@query(f"SELECT e.id, e.url, e.title, e.description, e.keywords, e.published_at, e.relevance, e.depth, {_DOM}, g.tags {_ROWS}")
def page_rows_tags(m):
    return graph.page_rows(m.expression, m.domain, m.tag, m.content, LAND, MINREL)


@query(f"SELECT e.id, e.url, e.title, e.description, e.keywords, e.readable, e.published_at, e.relevance, e.depth, {_DOM}, g.tags {_ROWS}")
def full_page_rows(m):
    return graph.page_rows(m.expression, m.domain, m.tag, m.content, LAND, MINREL, readable=True)


@query(f"SELECT e.id, e.url, d.name AS domain_name, coalesce(len(string_split(g.tags, ',')), 0) AS n_tags, coalesce(g.tags, '') AS tags {_ROWS}")
def page_force_graph(m):
    return graph.page_graph(m.expression, m.domain, m.tag, m.content, LAND, MINREL).select("id", "url", "domain_name", F.size("tags").cast("long").alias("n_tags"), F.array_join("tags", ",").alias("tags"))


@query("""SELECT e.id, k.name, json_extract_string(e.j, '$.' || k.name) AS value FROM (SELECT id, json(seorank) AS j FROM expression WHERE land_id = 1 AND relevance >= 1 AND json_valid(seorank) AND json_type(seorank) = 'OBJECT') e,
    unnest(json_keys(e.j)) AS k(name)""")
def json_keys_long(m):
    return graph.ranking_members(m.expression, LAND, MINREL)


@query("SELECT http_status, count(http_status) AS n FROM expression WHERE land_id = 1 AND fetched_at IS NOT NULL GROUP BY http_status")
def status_hist(m):
    return graph.status_counts(m.expression, LAND)


@query("SELECT coalesce(fetch_method, 'unknown') AS fetch_method, count(id) AS n FROM expression WHERE land_id = 1 AND fetched_at IS NOT NULL GROUP BY 1")
def fetch_methods(m):
    return graph.fetch_methods(m.expression, LAND)


@query("""SELECT l.id, l.name, w.terms, coalesce(p.pages, 0) AS pages, coalesce(p.remaining, 0) AS remaining FROM land l LEFT JOIN (SELECT land_id, string_agg(DISTINCT term, ',' ORDER BY term) AS terms FROM word GROUP BY 1) w ON w.land_id = l.id
    LEFT JOIN (SELECT land_id, count(DISTINCT id) AS pages, count(*) FILTER (fetched_at IS NULL) AS remaining FROM expression GROUP BY 1) p ON p.land_id = l.id""")
def land_stats(m):
    return graph.land_list(m.land, m.expression, m.word)


@query("SELECT land_id, count(*) AS n FROM expression WHERE fetched_at IS NULL GROUP BY land_id")
def remaining(m):
    return m.expression.filter("fetched_at IS NULL").groupBy("land_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(*) AS pages, CAST(coalesce(sum(length(html)), 0) AS BIGINT) AS chars FROM expression WHERE land_id = 1 AND html IS NOT NULL")
def html_storage(m):
    return graph.stored_pages(m.expression, LAND)


@query(f"SELECT id, url, http_status, fetch_method, coalesce(regexp_replace(strftime(fetched_at, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', ''), '') AS fetched_at, relevance, CAST(strlen(html) AS INT) AS size_bytes FROM {NODES} e WHERE html IS NOT NULL")
def html_manifest(m):
    return graph.page_manifest(m.expression, LAND, MINREL)


@query("SELECT id, CASE WHEN description IS NULL OR trim(description) = '' OR lower(trim(description)) = 'unknown' THEN 'na' ELSE trim(description) END AS shown FROM webdomain")
def shown_values(m):
    return m.domain.select("id", graph.shown(F.col("description")).alias("shown"))


@query("SELECT land_id, count(*) AS pages, count(DISTINCT id) AS ids FROM expression WHERE land_id = 2 AND relevance >= 3 GROUP BY land_id")
def parameterised_scan(m):
    from corpusloom.sources.inputs import table_where

    rows = table_where(m.expression, {"land_id": "land_id", "id": "id"}, 2, 3)
    return rows.groupBy("land_id").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("id").alias("ids"))


@query("SELECT l.id AS land_id, trim(u) AS lang FROM land l, unnest(list_filter(string_split(l.lang, ','), lambda x: x <> '')) AS t(u)")
def split_list(m):
    return m.land.select(F.col("id").alias("land_id"), F.explode(F.filter(F.split("lang", ","), lambda x: x != "")).alias("lang")).select("land_id", F.trim("lang").alias("lang"))


@query("SELECT id, position, CAST(ceil(position / 1000.0) AS BIGINT) AS batch FROM (SELECT id, row_number() OVER (ORDER BY id) AS position FROM expression WHERE readable IS NOT NULL)")
def corpus_batches(m):
    return select.batches(m.expression.filter("readable IS NOT NULL").select("id"), ["id"]).select("id", "position", "batch")


# --- queues -----------------------------------------------------------------------


@query("SELECT id, depth FROM expression WHERE land_id = 1 AND fetched_at IS NULL")
def frontier(m):
    return select.frontier(m.expression, LAND).select("id", "depth")


@query("SELECT id, depth, http_status FROM expression WHERE land_id = 1 AND http_status IN ('403', '503', 'ERR')")
def retry_status(m):
    return select.frontier(m.expression, LAND, retry_status=["403", "503", "ERR"]).select("id", "depth", "http_status")


@query("SELECT id FROM expression WHERE land_id = 1 AND fetched_at IS NOT NULL AND readable_at IS NULL")
def readable_queue(m):
    return select.readable_queue(m.expression, LAND).select("id")


@query("SELECT id FROM expression WHERE land_id = 1 AND (approved_at IS NOT NULL OR readable_at IS NOT NULL) AND relevance >= 2")
def consolidation_set(m):
    return select.consolidation_set(m.expression, LAND, minrel=2).select("id")


@query("SELECT id FROM expression WHERE land_id = 1 AND http_status = '200' AND relevance >= 1 AND seorank IS NULL")
def seo_queue(m):
    return select.seo_queue(m.expression, LAND, minrel=1).select("id")


@query("SELECT id FROM expression WHERE land_id = 1 AND readable IS NOT NULL AND length(readable) >= 140 AND (validllm IS NULL OR validllm NOT IN ('oui', 'non') OR validllm = 'non')")
def llm_queue(m):
    return select.llm_queue(m.expression, LAND, force=True).select("id")


@query("SELECT id, name FROM webdomain WHERE http_status LIKE 'ERR%' OR http_status IN ('000', 'ARC_NO_HTML', 'REQ_NO_HTML')")
def domain_queue(m):
    return select.domain_queue(m.domain, "err").select("id", "name")


@query("SELECT id FROM expression WHERE land_id = 1 AND relevance < 2 AND fetched_at IS NOT NULL")
def maxrel_delete(m):
    return select.below_relevance(m.expression, LAND, 2).select("id")


@query("SELECT id FROM expression e WHERE land_id = 1 AND fetched_at IS NULL AND depth > 0 AND NOT EXISTS (SELECT 1 FROM edge l WHERE l.target_id = e.id)")
def orphans(m):
    return select.orphans(m.expression, m.link, LAND).select("id")


@query("""SELECT id FROM expression e WHERE land_id = 1 AND fetched_at IS NULL AND depth > 0 AND NOT EXISTS (SELECT 1 FROM edge l JOIN expression s ON s.id = l.source_id
    WHERE l.target_id = e.id AND s.land_id = 1 AND NOT coalesce(s.relevance < 2 AND s.fetched_at IS NOT NULL, false))""")
def orphans_dry_run(m):
    return select.orphans(m.expression, m.link, LAND, dry_run_maxrel=2).select("id")


_BROKEN = "CASE WHEN id % 7 = 0 THEN concat(url, ')(x') WHEN id % 11 = 0 THEN concat(url, '_(y') ELSE url END"


@query(f"""WITH x AS (SELECT id, {_BROKEN} AS url, readable FROM expression) SELECT id, url FROM x WHERE readable IS NULL AND (contains(lower(url), ')(') OR contains(lower(url), '](') OR contains(lower(url), ')[') OR contains(lower(url), 'javascript:')
    OR length(url) - length(replace(url, '(', '')) > length(url) - length(replace(url, ')', ''))) AND NOT EXISTS (SELECT 1 FROM edge l WHERE l.target_id = x.id)""")
def malformed_orphans(m):
    pages = m.expression.select("id", F.expr(_BROKEN).alias("url"), "readable")
    return select.malformed_orphans(pages, m.link).select("id", "url")


@query("SELECT e.id FROM expression e WHERE lang IS NULL OR trim(lang) = '' OR EXISTS (SELECT 1 FROM land l, unnest(string_split(l.lang, ',')) a(x), unnest(string_split(e.lang, ',')) b(y) WHERE l.id = e.land_id AND lower(string_split(trim(a.x), '-')[1]) = lower(string_split(trim(b.y), '-')[1]) AND trim(b.y) <> '')")
def lang_compatible(m):
    rows = m.expression.select("id", "land_id", "lang").join(m.land.select(F.col("id").alias("land_id"), F.col("lang").alias("land_langs")), "land_id")
    return rows.filter(text.language_accepted(F.col("lang"), F.col("land_langs"))).select("id")


@query("""SELECT e.id, CASE WHEN o <> '' AND list_contains(b, o) THEN o ELSE b[1] END AS text_lang FROM (SELECT x.id, lower(trim(string_split(coalesce(x.lang, ''), '-')[1])) AS o, list_transform(string_split(l.lang, ','), lambda v: string_split(lower(trim(v)), '-')[1]) AS b
    FROM expression x JOIN land l ON l.id = x.land_id) e""")
def text_lang(m):
    rows = m.expression.select("id", "land_id", "lang").join(m.land.select(F.col("id").alias("land_id"), F.col("lang").alias("land_langs")), "land_id")
    return rows.select("id", text.text_language(F.col("lang"), F.col("land_langs")).alias("text_lang"))


# --- media and tags -----------------------------------------------------------------


@query(f"SELECT m.id, m.expression_id, m.url, m.type FROM media m WHERE m.expression_id IN (SELECT id FROM {NODES} n)")
def media_csv(m):
    return media.media_list(m.media, m.expression, LAND, MINREL)


@query("SELECT coalesce(format, 'unknown') AS format, count(*) AS n FROM media GROUP BY 1")
def media_formats(m):
    return media.formats(m.media)


@query("""SELECT count(*) FILTER (width IS NULL OR height IS NULL) AS unknown, count(*) FILTER (width < 200 OR height < 200) AS small,
    count(*) FILTER (NOT (width < 200 OR height < 200) AND NOT (width >= 1000 AND height >= 1000)) AS medium, count(*) FILTER (width >= 1000 AND height >= 1000) AS large FROM media""")
def media_dims(m):
    return media.dimensions(m.media)


@query("SELECT count(*) FILTER (file_size IS NULL) AS unknown, count(*) FILTER (file_size < 102400) AS small, count(*) FILTER (file_size >= 102400 AND file_size < 1048576) AS medium, count(*) FILTER (file_size >= 1048576) AS large FROM media")
def media_sizes(m):
    return media.file_sizes(m.media)


@query("SELECT count(*) AS \"groups\", CAST(coalesce(sum(n), 0) AS BIGINT) AS files FROM (SELECT image_hash, count(*) AS n FROM media WHERE image_hash IS NOT NULL GROUP BY 1 HAVING count(*) > 1)")
def media_dups(m):
    return media.duplicates(m.media)


@query("SELECT count(*) AS total, count(analyzed_at) AS analysed, count(analysis_error) AS errors FROM media")
def media_totals(m):
    return media.totals(m.media)


@query("SELECT id FROM media WHERE analyzed_at IS NOT NULL AND (width IS NULL OR width < 400 OR height IS NULL OR height < 300 OR file_size > 1200000)")
def media_preview(m):
    return select.media_doomed(m.media, min_width=400, min_height=300, max_bytes=1_200_000).select("id")


@query("SELECT id FROM media WHERE coalesce(width, 0) >= 400 AND coalesce(file_size, 0) <= 900000")
def media_conforming(m):
    return select.media_conforming(m.media, min_width=400, max_bytes=900_000).select("id")


@query("SELECT m.id FROM media m JOIN expression e ON e.id = m.expression_id WHERE e.depth <= 2 AND e.relevance >= 1")
def media_scope(m):
    return select.media_scope(m.media, m.expression, depth=2, minrel=1).select("id")


@query("SELECT id, row_number() OVER (ORDER BY analyzed_at IS NOT NULL, analysis_error IS NULL, id) AS position FROM media")
def media_reanalysis(m):
    keyed = m.media.select("id", F.col("analyzed_at").isNotNull().alias("analysed"), F.col("analysis_error").isNull().alias("fine"))
    return select.batches(keyed, ["analysed", "fine", "id"]).select("id", "position")


@query("""SELECT id, format, CAST(greatest(0, least(255, ceil((width % 256 - 25.5) / 51) * 51)) AS INT) AS red, CASE WHEN coalesce(height, 0) = 0 THEN 0.0 ELSE round(width / height, 2) END AS ratio FROM media""")
def web_safe_colours(m):
    return m.media.select("id", "format", vectors.web_safe(F.col("width") % 256).alias("red"), vectors.aspect_ratio(F.col("width"), F.col("height")).alias("ratio"))


_TREE = "WITH RECURSIVE tree AS (SELECT id, parent_id, sorting, name AS path FROM tag WHERE parent_id IS NULL UNION ALL SELECT c.id, c.parent_id, c.sorting, p.path || '_' || c.name FROM tag c JOIN tree p ON c.parent_id = p.id)"


@query(f"{_TREE} SELECT id, parent_id, sorting, path FROM tree")
def tag_paths(m):
    return tags.tag_paths(m.tag).select("id", "parent_id", "sorting", "path")


@query(f"{_TREE} SELECT c.expression_id, t.path, count(*) AS n FROM taggedcontent c JOIN tree t ON c.tag_id = t.id GROUP BY 1, 2")
def tag_matrix(m):
    return tags.tag_counts(m.tag, m.content)


@query(f"{_TREE} SELECT t.path, c.text AS content, c.expression_id FROM taggedcontent c JOIN tree t ON c.tag_id = t.id")
def tag_content(m):
    return tags.tagged_texts(m.tag, m.content)


# --- addresses ----------------------------------------------------------------------

_TRACK = "^(utm_.*|fbclid|gclid|mc_eid|ref_src|_ga|yclid|_openstat|wt_.*|msclkid|igshid|spm)(=|$)"
_NORM = f"""CASE WHEN regexp_extract(b, '^([A-Za-z]+://)', 1) = '' THEN url ELSE lower(regexp_extract(b, '^([A-Za-z]+://)', 1)) || lower(regexp_extract(b, '^[A-Za-z]+://([^/?]*)', 1)) || regexp_extract(b, '^[A-Za-z]+://[^/?]*([^?]*)', 1)
    || CASE WHEN len(list_filter(string_split(CASE WHEN contains(b, '?') THEN regexp_replace(b, '^[^?]*\\?', '') ELSE '' END, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{_TRACK}'))) > 0
    THEN '?' || array_to_string(list_transform(list_sort(list_transform(list_filter(string_split(CASE WHEN contains(b, '?') THEN regexp_replace(b, '^[^?]*\\?', '') ELSE '' END, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{_TRACK}')), lambda p, i: row(split_part(p, '=', 1), i, p))), lambda s: s[3]), '&') ELSE '' END END"""
_ADDR = "(SELECT id, land_id, coalesce(original_url, url) AS url, string_split(coalesce(original_url, url), '#')[1] AS b FROM expression)"


@query(f"SELECT id, {_NORM} AS norm FROM {_ADDR} a")
def url_normalize(m):
    return m.expression.select("id", urls.normalize_native(F.coalesce("original_url", "url")).alias("norm"))


@query()
def url_normalize_full(m):
    return m.expression.select("id", urls.normalize(F.coalesce("original_url", "url")).alias("norm"))


@query("""SELECT id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)) IN ('web.archive.org', 'archive.org', 'ghostarchive.org') AS is_archive, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) AS scheme,
    regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(url, '#(.+)$', 1) <> '' AS has_anchor, regexp_extract(url, '^[^#]*?\\?([^#]+)', 1) <> '' AS has_query FROM (SELECT id, coalesce(original_url, url) AS url FROM expression)""")
def url_classify(m):
    return m.expression.select("id", urls.classified(F.coalesce("original_url", "url")).alias("c")).select("id", "c.*")


@query("""SELECT pos, CASE WHEN regexp_extract(b, '^([A-Za-z]+://)', 1) = '' THEN b ELSE lower(regexp_extract(b, '^([A-Za-z]+://[^/?]*)', 1)) || CASE WHEN length(p) > 1 AND p LIKE '%/' THEN left(p, length(p) - 1) ELSE p END END AS canonical
    FROM (SELECT pos, b, regexp_extract(b, '^[A-Za-z]+://[^/?]*(/[^?]*)?', 1) AS p FROM (SELECT pos, string_split(url, '#')[1] AS b FROM result))""")
def url_canonical(m):
    return m.result.select("pos", urls.canonical(F.col("url")).alias("canonical"))


@query("""SELECT id, lower(rtrim(url, '/')) AS relaxed, CASE WHEN h <> '' THEN h || rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') || CASE WHEN q <> '' THEN '?' || q ELSE '' END END AS host_path
    FROM (SELECT id, url, regexp_replace(lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1)), '^www\\.', '') AS h, regexp_extract(url, '^[^#?]*\\?([^#]*)', 1) AS q FROM (SELECT id, coalesce(original_url, url) AS url FROM expression))""")
def url_keys(m):
    url = F.coalesce("original_url", "url")
    return m.expression.select("id", urls.relaxed_key(url).alias("relaxed"), urls.host_path_key(url).alias("host_path"))


@query("SELECT regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, count(*) AS n FROM expression GROUP BY 1")
def host(m):
    return m.expression.groupBy(urls.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


_FILES = "CASE WHEN id % 5 = 0 THEN concat(url, '/file.PDF') WHEN id % 7 = 0 THEN concat(url, '/a.pdf?x=1') WHEN id % 9 = 0 THEN concat('ftp', substr(url, 6)) WHEN id % 11 = 0 THEN concat(url, '/page?f=a.zip') ELSE url END"


@query(f"SELECT id, regexp_matches(url, '^https?://') AND NOT regexp_matches(lower(regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)), '\\.(jpg|jpeg|png|gif|bmp|webp|svg|ico|pdf|txt|csv|xls|xlsx|doc|docx|ppt|pptx|zip|mp4|webm|mp3|wav)$') AS crawlable FROM (SELECT id, {_FILES} AS url FROM expression)")
def crawlable(m):
    return m.expression.select("id", F.expr(_FILES).alias("url")).select("id", urls.crawlable(F.col("url")).alias("crawlable"))


_SNAPS = "CASE WHEN id % 3 = 0 THEN concat('https://web.archive.org/web/20200101000000/', url) WHEN id % 3 = 1 THEN concat('http://web.archive.org/web/2019id_/https://ghostarchive.org/archive/ab12/', url) ELSE url END"


@query(f"SELECT id, url AS target FROM expression")
def archive_unwrap(m):
    return m.expression.select("id", F.expr(_SNAPS).alias("u")).select("id", urls.unwrapped("u").alias("target"))


@query("""SELECT id, url AS new_url FROM (SELECT id, land_id, url, row_number() OVER (PARTITION BY land_id, url ORDER BY id) AS rn FROM expression WHERE id % 3 <> 2) x
    WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM expression y WHERE y.id % 3 = 2 AND y.land_id = x.land_id AND y.url = x.url)""")
def snapshot_renames(m):
    pages = m.expression.select("id", "land_id", F.expr(_SNAPS).alias("url"))
    return select.snapshot_renames(pages).select("id", "new_url")


@query("SELECT id, regexp_replace(concat(url, '?a=1&api_key=', id, '&b=2'), 'api_key=[^&\\s]+', 'api_key=***', 'g') AS url FROM expression")
def redacted(m):
    return m.expression.select("id", urls.redacted(F.concat("url", F.lit("?a=1&api_key="), F.col("id"), F.lit("&b=2"))).alias("url"))


@query("SELECT id, regexp_replace(url, '/+$', '') AS strip, CASE WHEN url LIKE '%/' OR contains(string_split(regexp_replace(url, '^[A-Za-z]+://[^/]*', ''), '/')[-1], '.') THEN url ELSE url || '/' END AS add_slash, CASE WHEN strpos(o, '#') > 1 THEN string_split(o, '#')[1] ELSE o END AS no_anchor FROM (SELECT id, url, coalesce(original_url, url) AS o FROM expression)")
def url_slashes(m):
    return m.expression.select("id", urls.with_slash_policy(F.col("url"), "strip").alias("strip"), urls.with_slash_policy(F.col("url"), "add").alias("add_slash"), urls.without_anchor(F.coalesce("original_url", "url")).alias("no_anchor"))


_COPIES = "SELECT id, land_id, url FROM expression UNION ALL SELECT id + 10000000, land_id, concat(url, '?utm_source=x') FROM expression WHERE id % 4 = 0 UNION ALL SELECT id + 20000000, land_id, concat(url, '-new?gclid=1') FROM expression WHERE id % 9 = 0"


def _copies(m):
    return m.spark.sql(_COPIES.replace("FROM expression", "FROM {e}"), e=m.expression.select("id", "land_id", "url"))


_PLAN = f"""WITH x AS ({_COPIES}), a AS (SELECT *, string_split(url, '#')[1] AS b FROM x), n AS (SELECT id, land_id, url, {_NORM} AS new_url FROM a), h AS (SELECT land_id, url, max(id) AS canonical_id FROM x GROUP BY 1, 2),
    plan AS (SELECT n.id, n.url, n.new_url, CASE WHEN h.canonical_id <> n.id THEN h.canonical_id END AS canonical_id FROM n LEFT JOIN h ON h.land_id = n.land_id AND h.url = n.new_url WHERE n.new_url <> n.url)"""


@query(f"{_PLAN} SELECT id, new_url, canonical_id, CASE WHEN canonical_id IS NULL THEN 'rename' ELSE 'merge' END AS action FROM plan")
def rename_merge_split(m):
    return normalize.plan(_copies(m), native=True).select("id", "new_url", "canonical_id", "action")


_CLINKS = "SELECT source_id, target_id FROM edge UNION SELECT CASE WHEN source_id % 4 = 0 THEN source_id + 10000000 ELSE source_id END, CASE WHEN target_id % 8 = 0 THEN target_id + 10000000 ELSE target_id END FROM edge"


@query(f"""{_PLAN}, l AS ({_CLINKS}), mapped AS (SELECT coalesce(s.canonical_id, l.source_id) AS source_id, coalesce(t.canonical_id, l.target_id) AS target_id, s.id IS NOT NULL OR t.id IS NOT NULL AS moved
    FROM l LEFT JOIN (SELECT * FROM plan WHERE canonical_id IS NOT NULL) s ON s.id = l.source_id LEFT JOIN (SELECT * FROM plan WHERE canonical_id IS NOT NULL) t ON t.id = l.target_id)
    SELECT DISTINCT source_id, target_id FROM mapped WHERE NOT (moved AND source_id = target_id)""")
def merge_links(m):
    link = m.spark.sql(_CLINKS.replace("FROM edge", "FROM {l}"), l=m.link)
    return normalize.merged_links(link, normalize.plan(_copies(m), native=True))


@query()
def domain_from_url(m):
    return m.expression.select("id", domains.resolved("url").alias("domain"))


@query()
def domain_from_html(m):
    return m.expression.select("id", domains.resolved("url", "html").alias("domain"))


_PLATFORM_URL = "CASE id % 4 WHEN 0 THEN concat('https://www.youtube.com/@Chan', id % 50, '/videos') WHEN 1 THEN concat('https://github.com/user', id % 30, '/repo?x=1') WHEN 2 THEN concat('https://www.youtube.com/watch?v=', id) ELSE url END"
_PLATFORM_PAGE = "CASE WHEN id % 4 = 2 AND id % 3 <> 0 THEN concat('<span itemprop=\"author\"><link itemprop=\"url\" href=\"http://www.youtube.com/@Own', id % 9, '\"></span>') END"


def _platform_pages(m):
    return m.expression.select("id", F.expr(_PLATFORM_URL).alias("url"), F.expr(_PLATFORM_PAGE).alias("html"))


@query("""SELECT id, CASE id % 4 WHEN 0 THEN concat('www.youtube.com/@Chan', id % 50) WHEN 1 THEN concat('github.com/user', id % 30) WHEN 2 THEN CASE WHEN id % 3 <> 0 THEN concat('www.youtube.com/@Own', id % 9) ELSE 'www.youtube.com' END
    ELSE regexp_extract(url, '^https?://([^/?#]+)', 1) END AS domain FROM expression""")
def domain_platforms(m):
    return _platform_pages(m).select("id", domains.resolved("url", "html").alias("domain"))


@query("""SELECT coalesce(suffix, 'TOTAL') AS suffix, count(*) AS pages, count(*) FILTER (id % 3 <> 0) AS with_html, count(*) FILTER (id % 3 <> 0) AS improved, round(1.0, 4) AS rate FROM (SELECT 'youtube.com' AS suffix, id FROM expression WHERE id % 4 = 2) GROUP BY ROLLUP (suffix)""")
def domain_resolution_rates(m):
    return normalize.resolution_rates(_platform_pages(m))


@query("""SELECT d.name AS old_domain, regexp_extract(e.url, '^https?://([^/?#]+)', 1) AS new_domain, count(*) AS n FROM expression e JOIN webdomain d ON e.domain_id = d.id WHERE d.name <> regexp_extract(e.url, '^https?://([^/?#]+)', 1)
    GROUP BY 1, 2 ORDER BY n DESC, old_domain, new_domain LIMIT 25""")
def domain_transitions(m):
    return normalize.transitions(normalize.reassigned(m.expression, m.domain, only_listed=False))


# --- pages and Markdown --------------------------------------------------------------


@query("SELECT id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title FROM expression WHERE html IS NOT NULL")
def html_title(m):
    return m.expression.filter("html IS NOT NULL").select("id", html.title_element(F.col("html")).alias("title"))


@query("SELECT id, regexp_extract(html, '(?i)<html[^>]*?\\slang=\"([^\"]*)\"', 1) AS lang FROM expression WHERE html IS NOT NULL")
def html_lang(m):
    return m.expression.filter("html IS NOT NULL").select("id", html.lang_attribute(F.col("html")).alias("lang"))


@query("SELECT id, len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=\"([^\"]*)\"', 1)) AS n FROM expression WHERE html IS NOT NULL")
def html_links(m):
    return m.expression.filter("html IS NOT NULL").select("id", F.size(html.hrefs(F.col("html"))).cast("long").alias("n"))


@query()
def html_fields(m):
    """Title, description, keywords, language, text, links and media of each page, from one parse."""
    return m.expression.filter("html IS NOT NULL").select("id", html.page_struct("html", "url").alias("p")).select("id", "p.*")


@query()
def html_media(m):
    p = m.expression.filter("html IS NOT NULL").select("id", html.page_struct("html", "url").alias("p"))
    return p.select("id", F.explode("p.media").alias("m")).select("id", "m.url", "m.type")


@query()
def readable_text(m):
    return m.expression.filter("html IS NOT NULL").select("id", html.page_struct("html", "url").alias("p")).select("id", "p.readable")


@query()
def dom_map(m):
    rows = m.expression.filter("html IS NOT NULL").select("id", F.explode(html.link_contexts("html", "url")).alias("x"))
    return rows.select("id", "x.url", "x.dom", "x.context")


@query("SELECT id, CASE WHEN strlen(html) <= 1501 THEN html ELSE left(html, CAST((SELECT max(k) FROM range(375, 1502) r(k) WHERE strlen(left(html, CAST(k AS INT))) <= 1501) AS INT)) END AS html FROM expression WHERE html IS NOT NULL")
def html_truncated(m):
    return m.expression.filter("html IS NOT NULL").select("id", html.truncated(F.col("html"), 1501).alias("html"))


@query()
def md_links(m):
    return m.mercury.filter("markdown IS NOT NULL").select("id", F.explode(markdown.links("markdown", F.concat(F.lit("https://"), F.coalesce("domain", F.lit("x.example"))))).alias("url"))


@query("SELECT id, u.url FROM (SELECT id, regexp_extract_all(markdown, '!\\[([^\\]]*)\\]\\(([^)\\s]+)(?:\\s+\"([^\"]*)\")?\\)', 2) AS us FROM mercuryresult), unnest(us) AS u(url)")
def md_images(m):
    return m.mercury.select("id", F.explode(markdown.images(F.col("markdown"))).alias("i")).select("id", "i.url")


@query("SELECT id, substr(list_filter(regexp_split_to_array(markdown, '\\n\\s*\\n'), lambda p: contains(p, '/p/9'))[1], 1, 1000) AS context FROM mercuryresult WHERE contains(markdown, '/p/9')")
def md_context(m):
    return m.mercury.filter(F.contains("markdown", F.lit("/p/9"))).select("id", markdown.paragraph_of(F.col("markdown"), F.lit("/p/9")).alias("context"))


@query()
def raw_html_network(m):
    return rawlinks.page_edges(m.expression, m.link, LAND, MINREL)


@query()
def raw_html_domains(m):
    return rawlinks.domain_edges(rawlinks.page_edges(m.expression, m.link, LAND, MINREL), m.domain)


_SP = "[\\s\\x0b\\x1c-\\x1f\\x85\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


# --- text ---------------------------------------------------------------------------


@query("SELECT doc_id, len(regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '\\p{L}+')) AS n FROM documents WHERE text IS NOT NULL")
def tokens(m):
    return m.base("documents").filter("text IS NOT NULL").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n"))


_W = "list_filter(regexp_extract_all(lower(coalesce({c}, 'None')), '\\p{{L}}+'), lambda t: t = w.lemma)"


@query(f"SELECT e.id, CAST(coalesce(sum(10 * len({_W.format(c='e.title')}) + len({_W.format(c='e.readable')})), 0) AS INT) AS relevance FROM (SELECT * FROM expression WHERE readable IS NOT NULL) e LEFT JOIN word w ON w.land_id = e.land_id GROUP BY e.id")
def relevance(m):
    return state.relevance(m.expression.filter("readable IS NOT NULL"), m.word, m.land, native=True)


@query()
def relevance_stemmed(m):
    words = state.dictionary(m.word.select("land_id", "term").distinct(), m.land)
    return state.relevance(m.expression.filter("readable IS NOT NULL"), words, m.land)


@query(f"SELECT doc_id, sha256(trim(regexp_replace(text, '{_SP}+', ' ', 'g'))) AS h FROM documents WHERE text IS NOT NULL")
def clean_hash(m):
    return m.base("documents").filter("text IS NOT NULL").select("doc_id", text.text_hash(text.cleaned(F.col("text"))).alias("h"))


_PARTS = f"list_filter(list_transform(regexp_split_to_array(text, '\\n{_SP}*\\n+'), lambda p: trim(regexp_replace(p, '{_SP}+', ' ', 'g'))), lambda p: length(p) BETWEEN 150 AND 6000)"
_WHOLE = f"trim(regexp_replace(text, '{_SP}+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN {_WHOLE} = '' THEN 0 WHEN len({_PARTS}) > 0 THEN len({_PARTS}) ELSE 1 END AS n FROM documents WHERE text IS NOT NULL")
def paragraphs(m):
    return m.base("documents").filter("text IS NOT NULL").select("doc_id", F.size(text.paragraphs(F.col("text"))).cast("long").alias("n"))


@query()
def paragraph_dedup(m):
    return similarity.paragraphs(m.base("documents").select("doc_id", "land_id", "text"), "doc_id", "land_id", "text")


@query("SELECT id, CASE WHEN lower(trim(coalesce(a, ''))) LIKE 'no%' THEN 'non' WHEN lower(trim(coalesce(a, ''))) LIKE 'oui%' OR lower(trim(coalesce(a, ''))) LIKE 'yes%' THEN 'oui' ELSE '?' END AS verdict FROM (SELECT id, CASE id % 5 WHEN 0 THEN 'Oui, sans doute' WHEN 1 THEN ' NO' WHEN 2 THEN 'Yes.' WHEN 3 THEN NULL ELSE validllm END AS a FROM expression)")
def yes_no(m):
    answers = m.expression.select("id", F.expr("CASE id % 5 WHEN 0 THEN 'Oui, sans doute' WHEN 1 THEN ' NO' WHEN 2 THEN 'Yes.' WHEN 3 THEN NULL ELSE validllm END").alias("a"))
    return answers.select("id", text.verdict(F.col("a")).alias("verdict"))


@query("SELECT id, CASE WHEN id % 4 = 0 THEN 'non' WHEN id % 4 = 1 THEN 'oui' ELSE validllm END AS validllm, CASE WHEN id % 4 = 0 THEN 0 ELSE relevance END AS relevance FROM expression")
def verdicts(m):
    asked = m.expression.withColumn("answer", F.expr("CASE id % 4 WHEN 0 THEN 'Non' WHEN 1 THEN 'yes' ELSE 'perhaps' END"))
    return state.judged(asked, "answer").select("id", "validllm", "relevance")


@query()
def stems(m):
    return m.expression.filter("title IS NOT NULL").select("id", text.stemmed("title", F.coalesce("lang", F.lit("en"))).alias("stems"))


@query()
def detected_languages(m):
    return m.base("documents").select("doc_id", text.detected_language(F.col("text"), F.col("lang")).alias("lang"))


@query()
def slugs(m):
    return m.expression.select("id", text.slug("title").alias("slug"))


@query()
def prompts(m):
    rows = m.expression.join(m.land.select(F.col("id").alias("land_id"), F.col("name").alias("land_name"), F.col("description").alias("land_description")), "land_id")
    terms = m.word.groupBy("land_id").agg(F.sort_array(F.collect_set("term")).alias("terms"))
    rows = rows.filter("readable IS NOT NULL").join(terms, "land_id", "left")
    return rows.select("id", text.prompt(F.col("land_name"), F.col("land_description"), F.coalesce("terms", F.array().cast("array<string>")), F.col("title"), F.col("url"), F.col("readable")).alias("prompt"))


# --- vectors ------------------------------------------------------------------------


@query("""SELECT doc_id, array_to_string(list_transform(range(0, 64), lambda b: CAST(len(list_filter(c, lambda x: x = b)) AS VARCHAR)), ',') AS bins
    FROM (SELECT doc_id, list_transform(regexp_extract_all(lower(replace(text, 'İ', 'i̇')), '(?s).'), lambda c: (CAST(unicode(c) AS BIGINT) * 1315423911) % 64) AS c FROM documents WHERE text IS NOT NULL AND text <> '')""")
def fake_embed(m):
    bins = m.base("documents").filter("text IS NOT NULL AND text <> ''").select("doc_id", vectors.hash_bins(F.col("text")).alias("bins"))
    return bins.select("doc_id", F.array_join(F.transform("bins", lambda x: x.cast("long").cast("string")), ",").alias("bins"))


_COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])))"
_PAIRS = f"SELECT a.vec_id AS source_paragraph_id, b.vec_id AS target_paragraph_id, {_COS} AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id AND a.label <> b.label"


def _near(m, **kw):
    return similarity.exact_pairs(m.base("embeddings"), "vec_id", "label", "embedding", threshold=0.3, **kw)


@query(f"SELECT source_paragraph_id, target_paragraph_id, round(s, 6) AS score FROM ({_PAIRS}) WHERE s >= 0.3")
def cosine_pairs(m):
    return _near(m).withColumn("score", F.round("score", 6))


@query(f"SELECT source_paragraph_id, target_paragraph_id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY source_paragraph_id ORDER BY s DESC, target_paragraph_id) AS rn FROM ({_PAIRS}) WHERE s >= 0.3) WHERE rn <= 2")
def cosine_topk(m):
    return _near(m, top_k=2).withColumn("score", F.round("score", 6))


_SIGNS = vectors.planes(64)
_SIG = " + ".join(f"(CASE WHEN list_dot_product(embedding::DOUBLE[], {[float(s) for s in p]}::DOUBLE[]) >= 0 THEN {1 << b} ELSE 0 END)" for b, p in enumerate(_SIGNS))
_FEW = " + ".join(f"(CASE WHEN list_dot_product(embedding::DOUBLE[], {[float(s) for s in p]}::DOUBLE[]) >= 0 THEN {1 << b} ELSE 0 END)" for b, p in enumerate(_SIGNS[:4]))


@query(f"SELECT vec_id, CAST({_SIG} AS BIGINT) AS signature FROM embeddings")
def lsh_signature(m):
    return m.base("embeddings").select("vec_id", vectors.signature(F.col("embedding"), _SIGNS).alias("signature"))


@query(f"WITH v AS (SELECT vec_id, label, embedding, {_FEW} AS sig FROM embeddings) SELECT a.vec_id AS source_paragraph_id, b.vec_id AS target_paragraph_id, round({_COS}, 6) AS score FROM v a JOIN v b ON a.sig = b.sig AND a.vec_id < b.vec_id AND a.label <> b.label WHERE {_COS} >= 0.3")
def lsh_pairs(m):
    return similarity.lsh_pairs(m.base("embeddings"), "vec_id", "label", "embedding", dim=64, bits=4, threshold=0.3).withColumn("score", F.round("score", 6))


@query(f"""WITH n AS (SELECT a.vec_id AS x, b.vec_id AS y, a.label AS la, b.label AS lb, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rn FROM embeddings a CROSS JOIN embeddings b)
    SELECT DISTINCT least(x, y) AS source_paragraph_id, greatest(x, y) AS target_paragraph_id FROM n WHERE rn <= 6 AND x <> y AND la <> lb""")
def ann_candidates(m):
    return similarity.neighbour_pairs(m.base("embeddings"), "vec_id", "label", "embedding", top_k=5).select("source_paragraph_id", "target_paragraph_id")


@query(f"SELECT source_paragraph_id, target_paragraph_id, 0.0::DOUBLE AS score, 0.5::DOUBLE AS score_raw, 'nli' AS method FROM ({_PAIRS}) WHERE s >= 0.3")
def nli_fallback(m):
    return similarity.entailment(_near(m))


_ENDS = """FROM similarity s JOIN paragraph p1 ON p1.id = s.source_paragraph_id JOIN paragraph p2 ON p2.id = s.target_paragraph_id JOIN expression e1 ON e1.id = p1.expression_id JOIN expression e2 ON e2.id = p2.expression_id
    WHERE e1.land_id = 1 AND e2.land_id = 1 AND e1.relevance >= 1 AND s.method IN ('nli', 'cosine', 'cosine_lsh')"""
_MEASURES = """count(*) AS "PairCount", count(*) AS "Weight", count(*) FILTER (s.score = 1) AS "EntailCount", count(*) FILTER (s.score = 0) AS "NeutralCount", count(*) FILTER (s.score = -1) AS "ContradictCount", round(avg(s.score), 6) AS "AvgRelationScore", round(avg(coalesce(s.score_raw, s.score)), 6) AS "AvgConfidence" """


@query(f"""SELECT s.source_paragraph_id AS "Source_ParagraphID", s.target_paragraph_id AS "Target_ParagraphID", s.score AS "RelationScore", coalesce(s.score_raw, s.score) AS "ConfidenceScore", p1.text AS "Source_Text", p2.text AS "Target_Text", e1.id AS "Source_ExpressionID", e2.id AS "Target_ExpressionID" {_ENDS}""")
def pseudolinks(m):
    return similarity.pseudolinks(m.similarity, m.paragraph, m.expression, LAND, MINREL)


@query(f"""SELECT least(e1.id, e2.id) AS "Source_ExpressionID", greatest(e1.id, e2.id) AS "Target_ExpressionID", CASE WHEN e1.id <= e2.id THEN e1.domain_id ELSE e2.domain_id END AS "Source_DomainID", CASE WHEN e1.id <= e2.id THEN e2.domain_id ELSE e1.domain_id END AS "Target_DomainID", {_MEASURES} {_ENDS} GROUP BY 1, 2, 3, 4""")
def pseudolinks_page(m):
    return similarity.pseudolinks_page(m.similarity, m.paragraph, m.expression, LAND, MINREL)


@query(f"""SELECT x.*, a.name AS "Source_Domain", b.name AS "Target_Domain" FROM (SELECT least(e1.domain_id, e2.domain_id) AS "Source_DomainID", greatest(e1.domain_id, e2.domain_id) AS "Target_DomainID", {_MEASURES} {_ENDS} GROUP BY 1, 2) x
    JOIN webdomain a ON a.id = x."Source_DomainID" JOIN webdomain b ON b.id = x."Target_DomainID" """)
def pseudolinks_domain(m):
    return similarity.pseudolinks_domain(m.similarity, m.paragraph, m.expression, m.domain, LAND, MINREL)


@query("SELECT s.source_paragraph_id, s.target_paragraph_id FROM similarity s WHERE NOT (s.method = 'nli' AND s.source_paragraph_id IN (SELECT id FROM expression WHERE land_id = 1))")
def similarity_replaced(m):
    ids = m.expression.filter(F.col("land_id") == LAND).select("id")
    return similarity.replaced(m.similarity, ids, "nli").select("source_paragraph_id", "target_paragraph_id")


@query("SELECT count(*) AS links FROM similarity WHERE source_paragraph_id NOT IN (SELECT id FROM expression WHERE land_id = 2) AND target_paragraph_id NOT IN (SELECT id FROM expression WHERE land_id = 2)")
def similarity_reset(m):
    ids = m.expression.filter("land_id = 2").select("id")
    empty = m.paragraph.select(F.col("id").alias("paragraph_id"))
    return similarity.reset(m.paragraph, empty, m.similarity, ids)[2].agg(F.count(F.lit(1)).alias("links"))


@query("""SELECT (SELECT count(*) FROM paragraph p JOIN expression e ON e.id = p.expression_id WHERE e.land_id = 1) AS paragraphs, (SELECT count(*) FROM paragraph p JOIN expression e ON e.id = p.expression_id WHERE e.land_id = 1 AND p.id % 3 <> 0) AS embeddings,
    (SELECT count(*) FROM similarity s JOIN expression a ON a.id = s.source_paragraph_id JOIN expression b ON b.id = s.target_paragraph_id WHERE a.land_id = 1 AND b.land_id = 1) AS pseudolinks""")
def embedding_summary(m):
    vectors = m.paragraph.filter("id % 3 <> 0").select(F.col("id").alias("paragraph_id"))
    return similarity.summary(m.paragraph, vectors, m.similarity, m.expression, LAND)


@query("""SELECT p.id AS paragraph_id FROM paragraph p JOIN expression e ON e.id = p.expression_id WHERE e.land_id = 1 AND e.relevance >= 4""")
def relevant_vectors(m):
    vectors = m.paragraph.select(F.col("id").alias("paragraph_id"), F.array(F.lit(1.0)).alias("embedding"))
    return similarity.relevant_vectors(vectors, m.paragraph, m.expression, LAND, 4).select("paragraph_id")


# --- search and dates ----------------------------------------------------------------

_CANON = "lower(regexp_extract(string_split(url, '#')[1], '^([A-Za-z]+://[^/?]*)', 1)) || regexp_replace(regexp_extract(string_split(url, '#')[1], '^[A-Za-z]+://[^/?]*(/[^?]*)?', 1), '(.)/$', '\\1')"


@query(f"""SELECT query_id, u AS url, min(rank) AS rank, coalesce(arg_min(title, (batch_no, pos)) FILTER (title <> ''), arg_min(title, (batch_no, pos))) AS title, coalesce(arg_min(snippet, (batch_no, pos)) FILTER (snippet <> ''), NULL) AS snippet,
    array_to_string(list_transform(list_sort(list(DISTINCT (batch_no, providers))), lambda x: x[2]), '+') AS providers FROM (SELECT *, {_CANON} AS u FROM result) GROUP BY query_id, u""")
def search_merge(m):
    return search.merged(m.result, "query_id").drop("_seen")


@query("SELECT r.pos, r.query_id, r.batch_no FROM result r JOIN (SELECT query_id, min(batch_no) AS b FROM result GROUP BY 1) f ON f.query_id = r.query_id AND f.b = r.batch_no")
def search_fallback(m):
    return search.routed(m.result, "fallback", "query_id").select("pos", "query_id", "batch_no")


@query("""SELECT x.pos, CASE WHEN x.pos % 7 = 0 THEN 'skipped' WHEN e.id IS NOT NULL THEN 'duplicate' ELSE 'new' END AS state FROM (SELECT event_id AS pos, concat('https://fresh.example/', event_id) AS url FROM events UNION ALL SELECT 1000000000 + id, url FROM expression) x
    LEFT JOIN (SELECT url, min(id) AS id FROM expression WHERE land_id = 1 GROUP BY 1) e ON e.url = x.url""")
def search_persist(m):
    rows = m.spark.sql("SELECT event_id AS pos, concat('https://fresh.example/', event_id) AS url FROM {ev} UNION ALL SELECT 1000000000 + id, url FROM {e}", ev=m.base("events"), e=m.expression)
    # snapshots and trackers lead to the page itself; files are skipped
    wrapped = F.when(F.col("pos") % 7 == 0, F.concat("url", F.lit(".pdf"))).when(F.col("pos") % 3 == 0, F.concat(F.lit("https://web.archive.org/web/20200102030405/"), "url")).when(F.col("pos") % 3 == 1, F.concat("url", F.lit("?utm_source=x#top"))).otherwise(F.col("url"))
    return search.persisted(rows.withColumn("url", wrapped), m.expression, LAND).select("pos", "state")


@query("""SELECT provider, CAST(sum(calls) AS BIGINT) AS calls, CAST(sum(errors) AS BIGINT) AS errors, arg_max(status, id) FILTER (status <> '') AS status, arg_min(quota, id) AS monthly_quota FROM (SELECT id, json_keys(usage_report)[1] AS provider,
    CAST(json_extract(usage_report, '$.*.calls')[1] AS INT) AS calls, CAST(json_extract(usage_report, '$.*.errors')[1] AS INT) AS errors, json_extract_string(usage_report, '$.*.status')[1] AS status, CAST(json_extract(usage_report, '$.*.monthly_quota')[1] AS INT) AS quota FROM searchquery) GROUP BY provider""")
def usage_rollup(m):
    return search.usage(m.searchquery)


def _payloads(m):
    item = F.struct(F.when(F.col("event_id") % 7 == 0, F.lit(None)).otherwise(F.concat(F.lit("https://r.example/"), "event_id")).alias("link"), F.concat(F.lit("t"), "event_id").alias("title"), F.lit("s").alias("snippet"), F.when(F.col("event_id") % 2 == 0, F.col("event_id").cast("string")).alias("position"))
    grouped = m.base("events").groupBy((F.col("event_id") % 50).alias("query_id")).agg(F.sort_array(F.collect_list(F.struct("event_id", item.alias("i")))).alias("x"))
    return grouped.select("query_id", F.to_json(F.struct(F.transform("x", lambda v: v["i"]).alias("organic_results"))).alias("payload"))


@query("""SELECT query_id, url, title, snippet, CAST(rank AS INT) AS rank, 'serpapi' AS providers FROM (SELECT event_id % 50 AS query_id, concat('https://r.example/', event_id) AS url, concat('t', event_id) AS title, 's' AS snippet,
    row_number() OVER (PARTITION BY event_id % 50 ORDER BY event_id) AS place, CASE WHEN event_id % 2 = 0 AND event_id <> 0 THEN event_id ELSE row_number() OVER (PARTITION BY event_id % 50 ORDER BY event_id) END AS rank, event_id FROM events) WHERE place <= 10 AND event_id % 7 <> 0""")
def provider_results(m):
    return search.parsed_results(_payloads(m), "payload", "serpapi", 10, "query_id")


_START, _END = dt.date(2024, 1, 29), dt.date(2024, 4, 10)


@query("SELECT CAST(s AS DATE) AS win_start, least(CAST(s AS DATE), DATE '2024-04-10') AS win_end FROM generate_series(DATE '2024-01-29', DATE '2024-04-10', INTERVAL 1 DAY) t(s)")
def date_windows_day(m):
    return dates.windows(m.spark, _START, _END, "day")


@query("SELECT CAST(s AS DATE) AS win_start, CAST(least(s + INTERVAL 1 MONTH - INTERVAL 1 DAY, DATE '2024-04-10') AS DATE) AS win_end FROM generate_series(DATE '2024-01-29', DATE '2024-04-10', INTERVAL 1 MONTH) t(s)")
def date_windows_calendar(m):
    return dates.windows(m.spark, _START, _END, "month")


@query("SELECT CAST(s AS DATE) AS win_start, CAST(least(s + INTERVAL 6 DAY, DATE '2024-04-10') AS DATE) AS win_end FROM generate_series(DATE '2024-01-29', DATE '2024-04-10', INTERVAL 7 DAY) t(s)")
def date_windows_week(m):
    return dates.windows(m.spark, _START, _END, "week")


@query()
def date_windows_month(m):
    return dates.windows(m.spark, dt.date(2024, 1, 31), dt.date(2024, 5, 10), "month")


_WRITTEN = "CASE event_id % 5 WHEN 0 THEN concat('Updated: ', {iso}) WHEN 1 THEN concat(event_id % 30, ' days ago') WHEN 2 THEN {slash} WHEN 3 THEN 'no date' ELSE {long} END"


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN CAST(CAST(ts AS DATE) AS TIMESTAMP) WHEN 1 THEN TIMESTAMP '2024-06-01 12:00:00' - to_days(CAST(event_id % 30 AS INT)) WHEN 3 THEN NULL ELSE CAST(CAST(ts AS DATE) AS TIMESTAMP) END AS published FROM events""")
def serp_dates(m):
    day = F.col("ts")
    said = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("Updated: "), F.date_format(day, "yyyy-MM-dd"))).when(F.col("event_id") % 5 == 1, F.concat((F.col("event_id") % 30).cast("string"), F.lit(" days ago"))).when(F.col("event_id") % 5 == 2, F.date_format(day, "MM/dd/yyyy")).when(F.col("event_id") % 5 == 3, F.lit("no date")).otherwise(F.date_format(day, "MMM. d, yyyy"))
    return m.base("events").select("event_id", said.alias("said")).select("event_id", dates.search_date(F.col("said"), F.lit(AS_OF)).alias("published"))


@query("""SELECT id, CASE WHEN regexp_matches(date_published, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}\\.\\d{3}Z$') THEN strptime(date_published, '%Y-%m-%dT%H:%M:%S.%gZ') WHEN regexp_matches(date_published, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}Z$') THEN strptime(date_published, '%Y-%m-%dT%H:%M:%SZ')
    WHEN regexp_matches(date_published, '^\\d{4}-\\d{2}-\\d{2}$') THEN strptime(date_published, '%Y-%m-%d') END AS published FROM mercuryresult""")
def extractor_dates(m):
    return m.mercury.select("id", dates.extractor_date(F.col("date_published")).alias("published"))


@query("SELECT e.id, least(e.published_at, d.published_at) AS earliest FROM expression e JOIN documents d ON d.doc_id = e.id")
def earliest_date(m):
    d = m.base("documents").select(F.col("doc_id").alias("id"), F.col("published_at").alias("other"))
    return m.expression.select("id", "published_at").join(d, "id").select("id", dates.earlier(F.col("published_at"), F.col("other")).alias("earliest"))


# --- states -------------------------------------------------------------------------

_LATEST = "(SELECT expression_id, title, excerpt, markdown FROM (SELECT *, row_number() OVER (PARTITION BY expression_id ORDER BY extraction_timestamp DESC, id DESC) AS rn FROM mercuryresult WHERE error IS NULL) WHERE rn = 1)"


@query(f"SELECT expression_id, title, excerpt FROM {_LATEST} x")
def latest_extraction(m):
    return state.latest_extraction(m.mercury).select("expression_id", "title", "excerpt")


def _smart(cur: str, new: str, longer: bool) -> str:
    best = f"CASE WHEN length({new}) > length({cur}) THEN {new} ELSE {cur} END" if longer else new
    return f"CASE WHEN {new} IS NULL THEN {cur} WHEN {cur} IS NULL OR {cur} = '' THEN {new} WHEN {new} = '' THEN {cur} ELSE {best} END"


@query(f"SELECT e.id, {_smart('e.title', 'x.title', True)} AS title, {_smart('e.description', 'x.excerpt', True)} AS description, {_smart('e.readable', 'x.markdown', False)} AS readable FROM expression e JOIN {_LATEST} x ON x.expression_id = e.id")
def smart_merge(m):
    x = state.latest_extraction(m.mercury).withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    return state.merged_extraction(m.expression, x).select("id", "title", "description", "readable")


@query(f"""SELECT count(*) AS processed, count(*) FILTER (error IS NULL AND changed) AS updated, count(error) AS errors, count(*) FILTER (error IS NULL AND NOT changed) AS skipped, round(count(*) FILTER (error IS NULL AND changed) / count(*), 4) AS success_rate
    FROM (SELECT error, markdown IS NOT NULL AS changed FROM mercuryresult)""")
def pipeline_stats(m):
    return state.extraction_stats(m.mercury.select("error", F.col("markdown").isNotNull().alias("changed")))


@query("SELECT d.id, coalesce(nullif(trim(d.title), ''), 'Website: ' || d.name) AS title, nullif(trim(d.description), '') AS description FROM webdomain d")
def domain_metadata(m):
    d = m.domain.selectExpr("id", "name", "title AS x_title", "CAST(NULL AS STRING) AS h_title", "CAST(NULL AS STRING) AS x_description", "description AS h_description", "keywords AS x_keywords", "CAST(NULL AS STRING) AS h_keywords")
    return state.domain_metadata(d).select("id", "title", "description")


@query("SELECT source_id, target_id FROM edge WHERE source_id NOT IN (SELECT id FROM expression WHERE land_id = 3) AND target_id NOT IN (SELECT id FROM expression WHERE land_id = 3)")
def land_delete(m):
    doomed = m.expression.filter("land_id = 3").select("id")
    return state.deleted(doomed, link=(m.link, ["source_id", "target_id"]))["link"].select("source_id", "target_id")


@query("SELECT DISTINCT w.land_id, w.term, lower(trim(u.lang)) AS lang FROM word w JOIN land l ON l.id = w.land_id, unnest(string_split(l.lang, ',')) AS u(lang) WHERE trim(u.lang) <> ''")
def dictionary(m):
    return state.dictionary(m.word.select("land_id", "term"), m.land).select("land_id", "term", "lang")


@query("""SELECT id AS source_id, url || '-next' AS url, coalesce(depth + 1, 1) AS depth FROM expression WHERE land_id = 1 AND readable IS NOT NULL AND (approved_at IS NOT NULL OR readable_at IS NOT NULL)
    UNION ALL SELECT id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/rel', coalesce(depth + 1, 1) FROM expression WHERE land_id = 1 AND readable IS NOT NULL AND (approved_at IS NOT NULL OR readable_at IS NOT NULL)""")
def consolidated_links(m):
    pages = select.consolidation_set(m.expression.filter("readable IS NOT NULL"), LAND)
    linked = pages.withColumn("readable", F.concat("readable", F.lit("\n\n[next]("), "url", F.lit("-next?utm_source=x) <a href='/rel#top'>rel</a> ![i](/i.png)")))
    return state.consolidated(linked, m.word, m.land)[1].select("source_id", "url", "depth")


@query()
def consolidated_relevance(m):
    pages = select.consolidation_set(m.expression.filter("readable IS NOT NULL"), LAND)
    return state.consolidated(pages, m.word, m.land)[0]


@query("SELECT id, CASE WHEN fetched_at IS NOT NULL AND id % 6 <> 0 THEN '{\"sr\":' || id || '}' ELSE seorank END AS seorank FROM expression")
def enrichment(m):
    answers = m.expression.filter("fetched_at IS NOT NULL").select("id", F.expr("CASE WHEN id % 6 = 0 THEN '{broken' ELSE concat('{\"sr\":', id, '}') END").alias("payload"))
    return state.enriched(m.expression, answers).select("id", "seorank")


@query("SELECT kind, start, n FROM (SELECT event_type AS kind, date_trunc('hour', ts) AS start, count(*) AS n FROM events GROUP BY 1, 2)")
def events_per_hour(m):
    """Batch form of the streaming extension."""
    return m.base("events").groupBy(F.col("event_type").alias("kind"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count(F.lit(1)).alias("n"))


# --- further operators ----------------------------------------------------------------


@query("SELECT CAST(count(*) FILTER (canonical_id IS NULL) AS BIGINT) AS renamed, CAST(count(canonical_id) AS BIGINT) AS merged FROM (" + _PLAN.replace("WITH ", "WITH ", 1) + " SELECT * FROM plan)")
def normalise_totals(m):
    moves = normalize.plan(_copies(m), native=True)
    return normalize.totals(moves, m.link).select("renamed", "merged")


@query("""SELECT id, url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS new_domain, seorank FROM (SELECT id, url, CAST(NULL AS VARCHAR) AS seorank FROM expression e WHERE domain_id IN (SELECT id FROM webdomain WHERE name IN ('web.archive.org', 'archive.org', 'ghostarchive.org') OR id % 10 = 3))""")
def snapshot_domain_pages(m):
    domain = m.domain.select("id", F.when(F.col("id") % 10 == 3, "archive.org").otherwise(F.col("name")).alias("name"))
    wrapped = m.expression.withColumn("url", F.concat(F.lit("https://web.archive.org/web/20200102030405/"), "url"))
    return select.snapshot_domain_pages(wrapped, domain).select("id", "url", "new_domain", "seorank")


@query("SELECT id, regexp_extract(url, '^(https?://[^/]+)', 1) || '/img/' || id || '.png' AS url FROM expression")
def media_addresses(m):
    return m.expression.select("id", urls.joined("url", F.concat(F.lit("/IMG/"), "id", F.lit(".PNG")), lower=True).alias("url"))


@query("SELECT id, id % 2 = 0 AS same FROM expression")
def same_pages(m):
    target = F.when(F.col("id") % 2 == 0, F.concat("url", F.lit("#part"))).otherwise(F.concat("url", F.lit("-other")))
    return m.expression.select("id", urls.same_page("url", target).alias("same"))


@query("SELECT id, concat(url, '/a%20%C3%A9', id, '%5B') AS url FROM expression")
def request_addresses(m):
    return m.expression.select("id", urls.request_url(F.concat(F.lit("https://web.archive.org/web/2020/"), "url", F.lit("/a é"), "id", F.lit("["))).alias("url"))


@query("SELECT id, url || CASE id % 8 WHEN 0 THEN '?a=2&a=1&b=2' WHEN 3 THEN '?q=x' ELSE '' END AS url FROM expression")
def url_cases(m):
    """The whole normaliser: repeated keys, snapshots, fragments, case of the host, doubled schemes, redirects, trackers."""
    url, bare = F.col("url"), F.regexp_replace("url", "^https?://", "")
    cases = [F.concat(url, F.lit("?b=2&a=2&utm_source=n&a=1")), F.concat(F.lit("https://web.archive.org/web/20200102030405/"), url), F.concat(url, F.lit("#part")), F.concat(F.regexp_extract("url", "^(https?://)", 1), F.upper(F.substring_index(bare, "/", 1)), F.regexp_extract(bare, "^[^/]*(.*)$", 1), F.lit("?q=x&fbclid=1")),
             F.concat(F.lit("http://"), url), F.concat(F.lit("https://www.linkedin.com/safety/go?url="), url), F.concat(url, F.lit("?gclid=2&wt_zmc=3")), F.concat(url, F.lit(").,"))]
    made = F.coalesce(*[F.when(F.col("id") % 8 == i, c) for i, c in enumerate(cases)])
    return m.expression.select("id", urls.normalize(made, urls.UrlRules(unwrap_redirect=True)).alias("url"))


@query("""SELECT id, concat('Og ', id) AS title, concat('about ', id) AS description, 'k1, k2' AS keywords, 'fr' AS lang, concat('no See one of two', chr(10), 'next [IMAGE: /I', id, '.PNG]') AS readable,
    concat(url, '/one', id) AS link, 2 AS links, concat('https://img.example/i', id, '.png') AS media, 'html > body > div#m.x > p' AS dom, 'See one of two' AS context FROM expression""")
def page_cases(m):
    """One crafted page for each row, paragraphs without end tags: its head, text, links with their places, and media."""
    i = F.col("id")
    made = F.concat(
        F.lit('<html lang="fr"><head><title>no</title><meta property="og:title" content=" Og '), i, F.lit(' "><meta name="description" content="about '), i, F.lit('"><meta name="keywords" content="k1, k2"></head><body><nav><a href="mailto:x@y">menu</a></nav><div id="m" class="x"><p>See <a href="'), F.col("url"), F.lit("/one"), i,
        F.lit('">one</a> of <a href="https://b.example/">two</a>\n<p>next <img src="/I'), i, F.lit('.PNG"></div><footer>foot</footer></body></html>'),
    )
    rows = m.expression.select("id", "url", made.alias("html")).withColumn("p", html.page_struct("html", F.lit("https://img.example/p"))).withColumn("c", html.link_contexts("html", F.lit("https://img.example/p")))
    first = F.get("c", F.lit(0))
    readable = F.regexp_replace(F.regexp_replace("p.readable", " +", " "), " *\n *", "\n")
    return rows.select("id", "p.title", "p.description", "p.keywords", "p.lang", readable.alias("readable"), F.get("p.links", F.lit(0)).alias("link"), F.size("p.links").alias("links"), F.get("p.media", F.lit(0))["url"].alias("media"), first["dom"].alias("dom"), first["context"].alias("context"))


@query("""SELECT id, u.url FROM (SELECT id, [concat('https://x.example/p', id), concat('https://x.example/auto', id), concat('https://y.example/rel', id)] AS us FROM mercuryresult), unnest(us) AS u(url)""")
def md_cases(m):
    """Links of crafted Markdown: inline with a title, automatic, relative; images and mail addresses are none."""
    i = F.col("id")
    text = F.concat(F.lit("[a](https://x.example/p"), i, F.lit(' "t") ![i](https://x.example/i.png) <https://x.example/auto'), i, F.lit("> [b](/rel"), i, F.lit(") [c](mailto:x@y)"))
    return m.mercury.select("id", F.explode(markdown.links(text, F.lit("https://y.example/d"))).alias("url"))


@query("SELECT l.source_id AS id, count(*) AS links FROM edge l JOIN expression e ON e.id = l.source_id WHERE e.relevance > 0 AND e.depth < 3 GROUP BY 1")
def crawl_links(m):
    targets = m.link.join(m.expression.select(F.col("id").alias("target_id"), F.concat("url", F.lit("?n="), "id").alias("u")), "target_id").groupBy("source_id").agg(F.collect_list("u").alias("links"))
    pages = m.expression.join(targets.withColumnRenamed("source_id", "id"), "id")
    return state.crawl_links(pages, "links").groupBy(F.col("source_id").alias("id")).agg(F.count(F.lit(1)).alias("links"))


@query("WITH c AS (SELECT id FROM expression WHERE depth = 1) SELECT source_id, target_id FROM edge WHERE source_id NOT IN (SELECT id FROM c) UNION SELECT source_id, target_id + 1 FROM edge WHERE source_id IN (SELECT id FROM c)")
def replaced_links(m):
    crawled = m.expression.filter("depth = 1").select("id")
    found = m.link.join(crawled.select(F.col("id").alias("source_id")), "source_id", "left_semi").select("source_id", (F.col("target_id") + 1).alias("target_id"))
    return state.replaced_links(m.link, crawled, found)


@query("""SELECT DISTINCT land_id, url || '-new' AS url, min(depth) + 1 AS depth FROM expression GROUP BY land_id, url""")
def pages_to_add(m):
    found = m.expression.select("land_id", F.concat("url", F.lit("-new#x")).alias("url"), (F.col("depth") + 1).alias("depth"))
    return state.expressions_to_add(found, m.expression).select("land_id", "url", "depth")


@query("""SELECT e.id, coalesce(nullif(trim(e.title), ''), e.url) AS title, CASE WHEN e.id % 6 = 0 THEN 0 WHEN NOT (e.lang IS NULL OR trim(e.lang) = '' OR EXISTS (SELECT 1 FROM unnest(string_split(l.lang, ',')) a(x), unnest(string_split(e.lang, ',')) b(y) WHERE lower(string_split(trim(a.x), '-')[1]) = lower(string_split(trim(b.y), '-')[1]) AND trim(b.y) <> '')) THEN 0
    ELSE coalesce(e.relevance, 0) END AS relevance FROM expression e JOIN land l ON l.id = e.land_id""")
def post_crawl(m):
    rows = m.expression.join(m.land.select(F.col("id").alias("land_id"), F.col("lang").alias("land_langs")), "land_id")
    rows = rows.withColumns({"x_title": F.col("title"), "x_description": F.col("description"), "x_keywords": F.col("keywords"), "x_lang": F.col("lang"), "x_relevance": F.col("relevance"), "x_allowed": F.col("id") % 6 != 0})
    return state.post_crawl(rows, F.lit(AS_OF)).select("id", "title", "relevance")


@query("SELECT term, lang FROM word WHERE land_id <> 1")
def orphan_words(m):
    word = m.word.withColumn("id", F.concat_ws("/", F.col("land_id"), "term", "lang"))
    bridge = word.filter("land_id = 1").select(F.col("id").alias("word_id"))
    return state.orphan_words(word, bridge).select("term", "lang")


@query("""SELECT e.id, CASE WHEN coalesce(e.title, '') = '' AND g.t IS NOT NULL THEN g.t ELSE e.title END AS title FROM (SELECT id, url, land_id, CASE WHEN id % 5 = 0 THEN ' ' WHEN id % 5 < 3 THEN NULL ELSE title END AS title FROM expression) e
    LEFT JOIN (SELECT url, concat('given ', max(id)) AS t FROM expression WHERE depth > 0 GROUP BY url) g ON g.url = e.url WHERE e.land_id = 1""")
def listed_urls(m):
    pages = m.expression.withColumn("title", F.when(F.col("id") % 5 == 0, " ").when(F.col("id") % 5 < 3, None).otherwise(F.col("title")))
    listed = m.expression.filter("depth > 0").select(F.concat("url", F.when(F.col("id") % 2 == 0, "#part").otherwise("")).alias("url"), F.concat(F.lit("given "), "id").alias("title"), F.lit(None).cast("timestamp_ntz").alias("published_at"), (-F.col("id")).alias("pos"))
    return search.added_urls(listed, pages, LAND, "pos")[0].select("id", "title")


@query("""SELECT DISTINCT concat('https://new.example/', event_id % 100) AS url, concat('t ', min(event_id) OVER (PARTITION BY event_id % 100)) AS title FROM events WHERE event_id % 10 <> 3""")
def listed_new_urls(m):
    address = F.concat(F.lit("HTTPS://New.Example/"), F.col("event_id") % 100, F.when(F.col("event_id") % 10 == 3, ".pdf").otherwise("#a"))
    listed = m.base("events").select(address.alias("url"), F.concat(F.lit("t "), "event_id").alias("title"), F.lit(None).cast("timestamp_ntz").alias("published_at"), F.col("event_id").alias("pos"))
    return search.added_urls(listed, m.expression, LAND, "pos")[1].select("url", F.col("new_title").alias("title"))


@query("SELECT row_number() OVER (ORDER BY name) + (SELECT max(id) FROM webdomain) AS id, name FROM (SELECT DISTINCT concat('new-', name) AS name FROM webdomain) UNION ALL SELECT id, name FROM webdomain")
def new_domain_ids(m):
    seen = m.domain.select(F.concat(F.lit("new-"), "name").alias("name")).unionByName(m.domain.select("name"))
    return search.first_seen_ids(seen, ["name"], m.domain.select("id", "name"))


@query("SELECT event_id % 40 AS query_id, event_id AS win FROM events e WHERE event_id % 11 <> 0 AND NOT EXISTS (SELECT 1 FROM events f WHERE f.event_id % 40 = e.event_id % 40 AND f.event_id % 97 = 0 AND f.event_id <= e.event_id)")
def search_windows_kept(m):
    status = F.when(F.col("event_id") % 97 == 0, "fatal").when(F.col("event_id") % 11 == 0, "transient").otherwise("ok")
    rows = m.base("events").select((F.col("event_id") % 40).alias("query_id"), F.col("event_id").alias("win_start"), status.alias("status"))
    return search.kept_windows(rows, "query_id").select("query_id", F.col("win_start").alias("win"))


@query("SELECT strftime(s, 'cdr:1,cd_min:%m/%d/%Y') || strftime(s, ',cd_max:%m/%d/%Y') AS google, strftime(s, '%Y-%m-%d') || '..' || strftime(s, '%Y-%m-%d') AS duckduckgo FROM generate_series(DATE '2024-01-29', DATE '2024-04-10', INTERVAL 1 DAY) t(s)")
def search_date_filters(m):
    w = dates.windows(m.spark, _START, _END, "day")
    return w.select(search.date_filter("google", F.col("win_start"), F.col("win_end")).alias("google"), search.date_filter("duckduckgo", F.col("win_start"), F.col("win_end")).alias("duckduckgo"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN 'direct' ELSE CASE WHEN id % 3 = 1 AND id % 2 = 0 THEN 'tls' ELSE CASE WHEN id % 5 = 0 THEN 'archive' ELSE 'direct' END END END AS strategy FROM expression")
def fetch_cascade(m):
    attempt = lambda s, status, page: F.struct(F.lit(s).alias("strategy"), status.alias("status"), page.alias("html"))
    i = F.col("id")
    none = F.lit(None).cast("string")
    direct = attempt("direct", F.when(i % 3 == 0, "200").when(i % 3 == 1, "403").otherwise("404"), F.when(i % 3 == 0, "<p>"))
    tls = attempt("tls", F.lit("200"), F.when(i % 2 == 0, "<p>").otherwise(none))
    archive = attempt("archive", F.lit("200"), F.when(i % 5 == 0, "<p>").otherwise(none))
    return m.expression.select("id", select.attempts(F.array(direct, tls, archive))["strategy"].alias("strategy"))


@query("SELECT id, concat('#', printf('%02x', CAST(least(255, ceil((id % 256 - 25.5) / 51) * 51) AS INT)), '3300') AS hex FROM (SELECT id FROM media) WHERE id % 256 >= 0")
def palettes(m):
    colours = m.media.select(F.col("id").alias("media_id"), (F.col("id") % 256).cast("int").alias("r"), F.lit(50).alias("g"), F.lit(3).alias("b"), F.lit(100.0).alias("percentage"))
    return media.palette(colours).select(F.col("media_id").alias("id"), F.map_keys("websafe")[0].alias("hex"))


@query()
def dominant_colours(m):
    pixel = lambda k: F.array((F.col("id") * k % 7 * 40).cast("int"), (F.col("id") % 5 * 60).cast("int"), F.lit(10))
    images = m.media.select(F.col("id").alias("media_id"), F.array(*[pixel(k) for k in range(1, 30)]).alias("pixels"))
    return media.dominant_colours(images)


@query()
def lazy_media(m):
    rows = m.expression.filter("html IS NOT NULL").select("id", F.explode(html.lazy_media("html", "url")).alias("m"))
    return rows.select("id", "m.url", "m.type")


@query()
def main_texts(m):
    rows = m.expression.filter("html IS NOT NULL")
    return rows.select("id", html.main_text(F.col("readable"), "html", "url").alias("text"))


@query()
def md_links_raw(m):
    base = F.concat(F.lit("https://"), F.coalesce("domain", F.lit("x.example")))
    return m.mercury.filter("markdown IS NOT NULL").select("id", F.explode(markdown.links_with_raw("markdown", base)).alias("l")).select("id", "l.url", "l.raw_url")


@query("SELECT count(*) AS pages FROM expression WHERE land_id = 1 AND relevance >= 1")
def land_frames(m):
    return graph.link_frames(m.expression, m.domain, m.link, LAND, MINREL)["pagesnodes"].agg(F.count(F.lit(1)).alias("pages"))


@query("SELECT query_id, count(*) AS n FROM result WHERE providers IN ('view', 'click') GROUP BY 1")
def search_parallel(m):
    return search.routed(m.result, "parallel", "query_id", allowed=["View", "CLICK"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT id, k.name, json_extract_string(j, '$.' || k.name) AS value FROM (SELECT id, json(usage_report) AS j FROM searchquery) s, unnest(json_keys(j)) AS k(name)")
def report_members(m):
    return jsons.members(m.searchquery, "id", "usage_report")


@query()
def applied_extraction(m):
    x = state.latest_extraction(m.mercury).withColumn("published_at", dates.extractor_date(F.col("date_published")))
    return state.applied_extraction(m.expression, x, m.word, m.land)[0].select("id", "title", "description", "readable", "published_at", "relevance")


@query("SELECT e.id, CASE WHEN x.expression_id IS NULL THEN e.title ELSE " + _smart("e.title", "x.title", True) + f" END AS title FROM expression e LEFT JOIN {_LATEST} x ON x.expression_id = e.id")
def applied_titles(m):
    x = state.latest_extraction(m.mercury).withColumn("published_at", F.lit(None).cast("timestamp_ntz"))
    return state.applied_extraction(m.expression, x, m.word, m.land)[0].select("id", "title")


@query("""SELECT id, CASE id % 4 WHEN 0 THEN '200' WHEN 1 THEN '301' WHEN 2 THEN 'REQ_NO_HTML' ELSE http_status END AS http_status, CASE id % 4 WHEN 0 THEN 'T' WHEN 1 THEN 'Website: ' || name WHEN 2 THEN NULL ELSE title END AS title FROM webdomain""")
def domains_fetched(m):
    tries = [("extractor", 0, "200", 0, "<title>T</title>"), ("extractor", 0, "ERR_TRAFI", 1, None), ("archive", 1, "301", 1, "<p>x"), ("extractor", 0, None, 2, None), ("archive", 1, "ARC_NO_HTML", 2, None), ("direct", 2, "REQ_NO_HTML", 2, "")]
    made = m.spark.createDataFrame(tries, "method string, ord int, status string, kind bigint, html string")
    attempts = m.domain.select(F.col("id").alias("domain_id"), (F.col("id") % 4).alias("kind")).join(made, "kind").drop("kind")
    return state.domains_fetched(m.domain, attempts, F.lit(AS_OF)).select("id", "http_status", "title")


@query("SELECT count(analyzed_at) AS analysed, count(*) FILTER (analyzed_at IS NOT NULL AND (width IS NULL OR width < 400 OR height IS NULL OR height < 300 OR file_size > 1200000)) AS doomed, count(*) FILTER (analyzed_at IS NULL) AS unanalysed FROM media")
def media_counts(m):
    return select.media_counts(m.media, min_width=400, min_height=300, max_bytes=1_200_000)


@query(f"SELECT source_paragraph_id, target_paragraph_id FROM ({_PAIRS}) WHERE s >= 0.3 ORDER BY source_paragraph_id, s DESC, target_paragraph_id LIMIT 40")
def cosine_capped(m):
    """The cap on pairs is the feature here."""
    return _near(m, max_pairs=40).select("source_paragraph_id", "target_paragraph_id")


_ADAPTERS = {"searxng": ("url", "content"), "brave": ("url", "description"), "serper": ("link", "snippet"), "tavily": ("url", "content")}


@query("""SELECT event_id % 20 AS query_id, p AS providers, concat('https://r.example/', event_id) AS url, CASE WHEN event_id % 3 = 0 THEN NULL ELSE concat('t', event_id) END AS title, concat('s', event_id) AS snippet, CAST(CASE WHEN p = 'serper' AND event_id % 2 = 1 THEN event_id ELSE place END AS INT) AS rank
    FROM (SELECT event_id, row_number() OVER (PARTITION BY event_id % 20 ORDER BY event_id) AS place FROM events), unnest(['searxng', 'brave', 'serper', 'tavily']) AS t(p) WHERE place <= 7 AND event_id % 5 <> 0""")
def provider_adapters(m):
    """The payloads of the other services, each in its own form, parsed into one."""
    i = F.col("event_id")
    out = None
    for name, (address, text) in _ADAPTERS.items():
        item = F.struct(F.when(i % 5 != 0, F.concat(F.lit("https://r.example/"), i)).alias(address), F.when(i % 3 != 0, F.concat(F.lit("t"), i)).otherwise("").alias("title"), F.concat(F.lit("s"), i).alias(text), F.when(i % 2 == 1, i.cast("string")).alias("position"))
        grouped = m.base("events").groupBy((i % 20).alias("query_id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", item.alias("item")))), lambda x: x["item"]).alias("items"))
        where = search.PAYLOADS[name][0].split(".")[1:]
        body = F.col("items").alias(where[-1])
        for part in reversed(where[:-1]):
            body = F.struct(body).alias(part)
        rows = search.parsed_results(grouped.select("query_id", F.to_json(F.struct(body)).alias("payload")), "payload", name, 7, "query_id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("SELECT event_id AS id, CAST(CASE event_id % 4 WHEN 0 THEN event_id + 10 WHEN 1 THEN event_id + 20 WHEN 2 THEN NULL ELSE event_id + 7 END AS BIGINT) AS next FROM events")
def next_offsets(m):
    """The next page: as the payload says, as its link carries, none without a link, else behind this one."""
    i = F.col("event_id")
    page = lambda *fields: F.to_json(F.struct(F.struct(*fields).alias("serpapi_pagination")))
    payload = F.when(i % 4 == 0, page(F.lit("https://s.example/?q=x").alias("next_link"), (i + 10).cast("string").alias("next_offset"))).when(i % 4 == 1, page(F.concat(F.lit("https://s.example/?q=x&start="), i + 20).alias("next"))).when(i % 4 == 2, page(F.lit("").alias("next"))).otherwise(page(F.lit("https://s.example/?q=x&start=0").alias("next")))
    return m.base("events").select(i.alias("id"), search.next_offset(payload, i, F.lit(7)).alias("next"))


@query("SELECT e.id, d.name AS old_domain, concat('www.youtube.com/@chan', e.id % 5) AS new_domain FROM expression e JOIN webdomain d ON d.id = e.domain_id WHERE e.id % 2 = 0")
def listed_domains(m):
    """Pages on a listed platform get the platform's entity as their domain; others are not asked about."""
    url = F.when(F.col("id") % 2 == 0, F.concat(F.lit("https://www.youtube.com/@chan"), F.col("id") % 5, F.lit("/videos"))).otherwise(F.col("url"))
    return normalize.reassigned(m.expression.withColumn("url", url), m.domain)


@query("""SELECT id, url, CASE WHEN id % 3 = 0 THEN coalesce(original_url, url || '#top') ELSE original_url END AS original_url, regexp_extract(url, '^https?://([^/?#]*)', 1) AS domain FROM expression""")
def renamed_pages(m):
    """Pages with an anchor take their normal address, and keep the first one they had."""
    pages = m.expression.select("id", F.lit(1).alias("land_id"), F.when(F.col("id") % 3 == 0, F.concat("url", F.lit("#top"))).otherwise(F.col("url")).alias("url"), "original_url", "http_status")
    moves = pages.filter("id % 3 = 0").select("id", F.lit("rename").alias("action"), F.substring_index("url", "#", 1).alias("new_url"))
    return normalize.renamed(pages, moves).select("id", "url", "original_url", "domain")


@query("SELECT id FROM media WHERE expression_id % 4 <> 0")
def media_of_the_unmerged(m):
    moves = m.expression.select("id", F.when(F.col("id") % 4 == 0, "merge").otherwise("rename").alias("action"))
    extra = m.media.select((F.col("expression_id") * 4).alias("id"), F.lit("merge").alias("action"))
    return normalize.without_merged(m.media, moves.unionByName(extra), "expression_id").select("id")
