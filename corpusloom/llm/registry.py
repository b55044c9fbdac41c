"""Queries of the ten problems; ``__spark_entry__`` adds them if this package can be imported."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import boilerplate, contributors, languages, lines, markup, packing, residue, sites, spans, tokenizer, truncation
from corpusloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def _sites(spark: SparkSession, d: str) -> DataFrame:
    return sites.spellings(table(spark, d, "webdomain"), "id", "name")


def _residue(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_pages(table(spark, d, "expression"), "id", "domain_id", "content", status="http_status", same=_sites(spark, d))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return markup.markup_kinds(table(spark, d, "mercuryresult"), "id", ["content", "markdown"]).withColumnRenamed("key", "result_id")


def p1_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every field as clean text, with weights learned from the stored pages."""
    return markup.clean_fields(table(spark, d, "mercuryresult"), "id", ["content", "markdown"], p1_weights(spark, d)).withColumnRenamed("key", "result_id")


def p1_weights(spark: SparkSession, d: str) -> DataFrame:
    """Word and tag weights, learned from labelled pages."""
    return markup.fit_weights(table(spark, d, "expression"), "id", "html")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    found = languages.label_issues(table(spark, d, "expression"), "id", "lang", "content", without=_residue(spark, d))
    return found.withColumnRenamed("key", "expression_id")


def p2_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every page with its language and confidence."""
    return languages.languages(table(spark, d, "expression"), "id", "lang", "content").select(F.col("key").alias("expression_id"), "lang", "confidence")


def p2_segments(spark: SparkSession, d: str) -> DataFrame:
    """The segments of pages that mix languages."""
    judged = languages.languages(table(spark, d, "expression"), "id", "lang", "content")
    return judged.select(F.col("key").alias("expression_id"), F.inline("segments"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    found = lines.repeated_lines(table(spark, d, "expression"), "id", "domain_id", "content", without=_residue(spark, d), same=_sites(spark, d))
    return found.selectExpr("doc as expression_id", "line_no")


def p3_blocks(spark: SparkSession, d: str) -> DataFrame:
    return lines.repeated_blocks(table(spark, d, "expression"), "id", "domain_id", "content", without=_residue(spark, d), same=_sites(spark, d))


def p3_clean(spark: SparkSession, d: str) -> DataFrame:
    """Every page without the lines that its site repeats."""
    pages = table(spark, d, "expression")
    gone = lines.repeated_lines(pages, "id", "domain_id", "content", without=_residue(spark, d), same=_sites(spark, d))
    return lines.without_lines(pages, "id", "content", gone).withColumnRenamed("doc", "expression_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _residue(spark, d).selectExpr("doc as expression_id")


def p4_templates(spark: SparkSession, d: str) -> DataFrame:
    """The message templates with their verdicts."""
    return residue.residue_templates(table(spark, d, "expression"), "id", "domain_id", "content", status="http_status", same=_sites(spark, d))


def p4_open_slots(spark: SparkSession, d: str) -> DataFrame:
    return residue.open_slots(table(spark, d, "expression"), "id", "content").withColumnRenamed("doc", "expression_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "expression")
    found = boilerplate.furniture_lines(pages, "id", "domain_id", "url", "content", "html", without=_residue(spark, d), same=_sites(spark, d))
    return found.withColumnRenamed("doc", "expression_id")


def p5_body(spark: SparkSession, d: str) -> DataFrame:
    """The main body of each page."""
    pages = table(spark, d, "expression")
    gone = boilerplate.furniture_lines(pages, "id", "domain_id", "url", "content", "html", same=_sites(spark, d))
    return lines.without_lines(pages, "id", "content", gone).withColumnRenamed("doc", "expression_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    rows = sites.by_site(table(spark, d, "expression").select("id", "domain_id", "relevance"), "domain_id", _sites(spark, d))
    capped = contributors.cap_contributors(rows, "domain_id", "relevance", "id", max_share=Fraction(1, 50))
    return capped.filter("not kept").selectExpr("id as expression_id")


def p6_kept_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The corpus in which no site holds more than a twentieth of the output itself."""
    rows = sites.by_site(table(spark, d, "expression").select("id", "domain_id", "relevance"), "domain_id", _sites(spark, d))
    capped = contributors.cap_contributors(rows, "domain_id", "relevance", "id", max_share=Fraction(1, 20), share_of="output")
    return capped.filter("kept").selectExpr("id as expression_id", "domain_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    cuts = truncation.truncated(table(spark, d, "expression"), "id", "domain_id", "html", same=_sites(spark, d))
    return cuts.filter("cut").selectExpr("doc as expression_id")


def p7_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each site truncates; a site has the smallest of its domain ids."""
    return truncation.truncation_rates(table(spark, d, "expression"), "id", "domain_id", "html", same=_sites(spark, d)).withColumnRenamed("source", "domain_id")


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """The lengths tested, with hazards and significance; a site has the smallest of its domain ids."""
    return truncation.limits(table(spark, d, "expression"), "id", "domain_id", "html", same=_sites(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encode_ids(table(spark, d, "documents"), "doc_id", "text")


def p8_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Round trip: each text from its ids."""
    return tokenizer.decode_ids(p8_ids(spark, d), "doc_id", "ids")


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(table(spark, d, "documents"), "doc_id", "text", "source")


def p9_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p9_containers(spark, d))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_shared(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_amount(table(spark, d, "documents"), "doc_id", "text")


def p10_clusters(spark: SparkSession, d: str) -> DataFrame:
    return spans.removal_clusters(table(spark, d, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1].isdigit() and callable(f)}


P6_SQL = """
WITH s AS (SELECT id AS domain_id, regexp_replace(regexp_replace(lower(name), '^www\\.', ''), '\\.$', '') AS site FROM webdomain),
     r AS (SELECT e.id, row_number() OVER (PARTITION BY s.site ORDER BY e.relevance DESC NULLS LAST, e.id) AS k, (SELECT count(*) FROM expression) // 50 AS cap
           FROM expression e JOIN s ON s.domain_id = e.domain_id)
SELECT id AS expression_id FROM r WHERE k > cap
"""

P8_DECODED_SQL = "SELECT doc_id, coalesce(text, '') AS text FROM documents"


def oracle_sql() -> dict[str, str]:
    return {"p6_found": P6_SQL, "p8_decoded": P8_DECODED_SQL}
