"""Page and domain graphs of a land."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.jsons import object_map
from corpusloom.operators.select import qualified


def edges(expressionlink: DataFrame) -> DataFrame:
    """One row for each pair of pages; rows with a null end are no links. Of repeats one row stays whole: that of the smallest context, then the smallest dom, nulls last."""
    rows = expressionlink.filter(F.col("source_id").isNotNull() & F.col("target_id").isNotNull())
    order = F.struct(F.col("context").isNull(), "context", F.col("dom").isNull(), "dom")
    return rows.groupBy("source_id", "target_id").agg(F.min_by(F.struct("context", "dom"), order).alias("kept")).select("source_id", "target_id", "kept.*")


def closed_links(expression: DataFrame, link: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """Links of which both ends qualify, with the pages at their ends."""
    nodes = qualified(expression, land_id, minrel).select("id", "url", "domain_id")
    s = nodes.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"), F.col("domain_id").alias("source_domain_id"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("url").alias("target_url"), F.col("domain_id").alias("target_domain_id"))
    return link.join(s, "source_id").join(t, "target_id")


def _domain(domain: DataFrame, *columns: str) -> DataFrame:
    return domain.select(F.col("id").alias("domain_id"), *[F.col(c).alias(f"domain_{c}") for c in columns])


def page_links(expression: DataFrame, link: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """Links within the land, also within one domain."""
    rows = closed_links(expression, link, land_id, minrel)
    return rows.select("source_id", "source_url", "source_domain_id", "target_id", "target_url", "target_domain_id", "context", "dom")


def page_edges(expression: DataFrame, link: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """(source, target, weight) between pages of different domains, for graph files."""
    rows = closed_links(expression, link, land_id, minrel).filter("source_domain_id <> target_domain_id")
    return rows.select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.lit(1).alias("weight"))


def page_nodes(expression: DataFrame, domain: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    columns = "id url domain_id domain_name title description keywords lang relevance depth http_status created_at published_at fetched_at approved_at readable_at validllm validmodel seorank".split()
    return qualified(expression, land_id, minrel).join(_domain(domain, "name"), "domain_id").select(*columns)


def tag_names(tag: DataFrame, content: DataFrame) -> DataFrame:
    """(expression_id, tags): the distinct names of a page's tags, in order, joined by commas."""
    named = content.join(tag.select(F.col("id").alias("tag_id"), "name"), "tag_id", "left")
    return named.groupBy("expression_id").agg(F.array_join(F.sort_array(F.collect_set("name")), ",").alias("tags"))


def page_rows(expression: DataFrame, domain: DataFrame, tag: DataFrame, content: DataFrame, land_id: int, minrel: int = 1, readable: bool = False) -> DataFrame:
    """Pages with domain and tags, as for CSV; with or without the readable text."""
    columns = "id url title description keywords".split() + (["readable"] if readable else []) + "published_at relevance depth domain_id domain_name domain_description domain_keywords tags".split()
    rows = qualified(expression, land_id, minrel).join(_domain(domain, "name", "description", "keywords"), "domain_id")
    names = tag_names(tag, content).select(F.col("expression_id").alias("id"), F.nullif("tags", F.lit("")).alias("tags"))
    return rows.join(names, "id", "left").select(*columns)


def ranking_members(expression: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """(id, name, value): the members of the pages' rankings, which become columns of a file."""
    return qualified(expression, land_id, minrel).select("id", F.explode(object_map(F.col("seorank"))).alias("name", "value"))


def domain_nodes(expression: DataFrame, domain: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """Domains with number, mean relevance and first and last date of their pages."""
    per = qualified(expression, land_id, minrel).groupBy("domain_id").agg(
        F.count(F.lit(1)).alias("nbexpressions"), F.round(F.avg("relevance"), 2).alias("average_relevance"), F.min("published_at").alias("first_expression_date"), F.max("published_at").alias("last_expression_date")
    )
    return domain.join(per, domain["id"] == per["domain_id"]).drop("domain_id")


def domain_links(expression: DataFrame, domain: DataFrame, link: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """Links between different domains, counted."""
    rows = closed_links(expression, link, land_id, minrel).filter("source_domain_id <> target_domain_id")
    per = rows.groupBy("source_domain_id", "target_domain_id").agg(F.count(F.lit(1)).alias("link_count"))
    s = domain.select(F.col("id").alias("source_domain_id"), F.col("name").alias("source_domain_name"))
    t = domain.select(F.col("id").alias("target_domain_id"), F.col("name").alias("target_domain_name"))
    return per.join(s, "source_domain_id").join(t, "target_domain_id").select("source_domain_id", "source_domain_name", "target_domain_id", "target_domain_name", "link_count")


def domain_graph_nodes(expression: DataFrame, domain: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """Nodes of a domain graph file, one for each name; of several domains with one name that of the smallest id lends the rest."""
    d = domain.select(F.col("id").alias("domain_id"), "name", F.struct("id", "title", "description", "keywords").alias("d"))
    rows = qualified(expression, land_id, minrel).select("domain_id", "relevance").join(d, "domain_id")
    per = rows.groupBy("name").agg(F.count(F.lit(1)).alias("expressions"), F.round(F.avg("relevance"), 2).alias("average_relevance"), F.min_by("d", "domain_id").alias("d"))
    return per.select("d.id", "name", "d.title", "d.description", "d.keywords", "expressions", "average_relevance")


def domain_corpus(expression: DataFrame, domain: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """Domain nodes with their pages as an array in order of address."""
    pages = F.sort_array(F.collect_list(F.struct(F.col("url").alias("urlarticle"), "title", "description", F.col("published_at").cast("string").alias("published_at"))))
    per = qualified(expression, land_id, minrel).groupBy("domain_id").agg(
        F.count(F.lit(1)).alias("nbexpressions"), F.round(F.avg("relevance"), 2).alias("average_relevance"), F.min("published_at").alias("first_expression_date"), F.max("published_at").alias("last_expression_date"), pages.alias("corpus")
    )
    d = domain.select("id", "name", "title", "description", "keywords")
    return d.join(per, d["id"] == per["domain_id"]).drop("domain_id")


def page_graph(expression: DataFrame, domain: DataFrame, tag: DataFrame, content: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """Nodes of the page graph in JSON: tags as a sorted array, the ranking as an object; null stays null."""
    rows = page_rows(expression, domain, tag, content, land_id, minrel).drop("depth")
    tags = F.when(F.col("tags").isNull(), F.array().cast("array<string>")).otherwise(F.sort_array(F.split("tags", ",")))
    ranking = expression.select("id", object_map(F.col("seorank")).alias("seorank"))
    return rows.withColumn("tags", tags).join(ranking, "id")


def status_counts(expression: DataFrame, land_id: int) -> DataFrame:
    """Fetched pages by status; pages without a status count 0."""
    rows = expression.filter((F.col("land_id") == land_id) & F.col("fetched_at").isNotNull())
    return rows.groupBy("http_status").agg(F.count("http_status").alias("n"))


def fetch_methods(expression: DataFrame, land_id: int) -> DataFrame:
    rows = expression.filter((F.col("land_id") == land_id) & F.col("fetched_at").isNotNull())
    return rows.groupBy(F.coalesce("fetch_method", F.lit("unknown")).alias("fetch_method")).agg(F.count("id").alias("n"))


def land_list(land: DataFrame, expression: DataFrame, words: DataFrame) -> DataFrame:
    """Lands with their terms and number of pages; each side is counted on its own before they meet."""
    terms = words.groupBy(F.col("land_id").alias("id")).agg(F.array_join(F.sort_array(F.collect_set("term")), ",").alias("terms"))
    pages = expression.groupBy(F.col("land_id").alias("id")).agg(F.countDistinct("id").alias("pages"), F.count_if(F.col("fetched_at").isNull()).alias("remaining"))
    return land.select("id", "name").join(terms, "id", "left").join(pages, "id", "left").na.fill(0, ["pages", "remaining"])


def stored_pages(expression: DataFrame, land_id: int) -> DataFrame:
    rows = expression.filter((F.col("land_id") == land_id) & F.col("html").isNotNull())
    return rows.agg(F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.length("html")), F.lit(0)).alias("chars"))


def page_manifest(expression: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """What a dump of stored pages lists; whole seconds are written without a fraction."""
    rows = qualified(expression, land_id, minrel).filter(F.col("html").isNotNull())
    fetched = F.regexp_replace(F.date_format("fetched_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "\\.000000$", "")
    return rows.select("id", "url", "http_status", "fetch_method", F.coalesce(fetched, F.lit("")).alias("fetched_at"), "relevance", F.octet_length("html").alias("size_bytes"))


def shown(value, numeric: bool = False):
    """Value as graph and CSV files show it: ``na`` for null, blank or unknown; numbers as they are."""
    if numeric:
        return value
    return F.when(value.isNull() | (F.trim(value) == "") | (F.lower(F.trim(value)) == "unknown"), "na").otherwise(F.trim(value))


def link_frames(expression: DataFrame, domain: DataFrame, link: DataFrame, land_id: int, minrel: int = 1, fullhtml: bool = False) -> dict[str, DataFrame]:
    """The four frames of a node and link export; ``fullhtml`` takes the links of the stored pages instead of those of the texts."""
    from corpusloom.operators import rawlinks

    frames = {"pagesnodes": page_nodes(expression, domain, land_id, minrel), "domainnodes": domain_nodes(expression, domain, land_id, minrel)}
    if fullhtml:
        edges_ = rawlinks.page_edges(expression, link, land_id, minrel)
        return frames | {"pageslinksfullhtml": edges_, "domainlinksfullhtml": rawlinks.domain_edges(edges_, domain)}
    return frames | {"pageslinks": page_links(expression, link, land_id, minrel), "domainlinks": domain_links(expression, domain, link, land_id, minrel)}
