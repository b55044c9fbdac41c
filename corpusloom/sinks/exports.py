"""The exports of a land: each kind is a frame or two, and the file that it goes to.

``tables`` is any object with the model tables as attributes (land, domain, expression, link, tag,
content, media, paragraph, similarity); ``plans.model.Model`` is one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.jsons import widened
from corpusloom.operators import graph, media, similarity, tags
from corpusloom.operators.select import qualified
from corpusloom.sinks import files

KINDS = ("pagecsv", "fullpagecsv", "nodecsv", "nodesjson", "pagesjson", "mediacsv", "nodelinkcsv", "pagegexf", "nodegexf", "pseudolinks", "pseudolinkspage", "pseudolinksdomain", "corpus", "htmldump")


def ranking_names(tables, land_id: int, minrel: int) -> list[str]:
    """The members of the pages' rankings in order: they are the columns of a file."""
    return [r["name"] for r in graph.ranking_members(tables.expression, land_id, minrel).select("name").distinct().orderBy("name").collect()]


def with_ranking(df: DataFrame, tables, land_id: int, minrel: int) -> DataFrame:
    """``df`` (with column id) and one column for each member of a ranking."""
    names = ranking_names(tables, land_id, minrel)
    wide = widened(tables.expression.select("id", F.col("seorank").alias("_ranking")), "_ranking", names).drop("_ranking")
    return df.join(wide, "id")


def shown(df: DataFrame) -> DataFrame:
    """Text columns as graph files show them: ``na`` for null, blank or unknown; null numbers too."""
    return df.select([graph.shown(F.col(f"`{c}`")).alias(c) if t == "string" else F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("na")).alias(c) for c, t in df.dtypes])


def frames(tables, kind: str, land_id: int, minrel: int = 1, fullhtml: bool = False) -> dict[str, DataFrame]:
    """The frames of an export by name; a graph has ``nodes`` and ``links``."""
    t = tables
    e, d, link = t.expression, t.domain, t.link
    if kind == "pagecsv":
        return {kind: with_ranking(graph.page_rows(e, d, t.tag, t.content, land_id, minrel), t, land_id, minrel).orderBy("id")}
    if kind == "fullpagecsv":
        return {kind: graph.page_rows(e, d, t.tag, t.content, land_id, minrel, readable=True).orderBy("id")}
    if kind == "nodecsv":
        nodes = graph.domain_nodes(e, d, land_id, minrel).withColumnRenamed("nbexpressions", "expressions")
        return {kind: nodes.select("id", "name", "title", "description", "keywords", "expressions", "average_relevance").orderBy("id")}
    if kind == "nodesjson":
        dates = [F.col(c).cast("string").alias(c) for c in ("first_expression_date", "last_expression_date")]
        nodes = graph.domain_corpus(e, d, land_id, minrel).select("id", "name", "title", "description", "keywords", "nbexpressions", "average_relevance", *dates, "corpus")
        links = graph.domain_links(e, d, link, land_id, minrel).select(F.col("source_domain_id").alias("source"), F.col("target_domain_id").alias("target"), F.col("link_count").alias("value"))
        return {"nodes": nodes.orderBy(F.col("nbexpressions").desc(), "id"), "links": links.orderBy(F.col("value").desc(), "source", "target")}
    if kind == "pagesjson":
        links = graph.closed_links(e, link, land_id, minrel).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
        nodes = graph.page_graph(e, d, t.tag, t.content, land_id, minrel).withColumn("published_at", F.col("published_at").cast("string"))
        return {"nodes": nodes.orderBy("id"), "links": links.orderBy("source", "target")}
    if kind == "mediacsv":
        return {kind: media.media_list(t.media, e, land_id, minrel).orderBy("id")}
    if kind == "nodelinkcsv":
        four = graph.link_frames(e, d, link, land_id, minrel, fullhtml)
        four["pagesnodes"] = with_ranking(four["pagesnodes"].drop("seorank", "domain_name"), t, land_id, minrel)
        orders = {
            "pagesnodes": [F.col("relevance").desc(), "id"], "pageslinks": ["source_id", "target_id"], "domainnodes": [F.col("nbexpressions").desc(), "id"],
            "domainlinks": [F.col("link_count").desc(), "source_domain_id", "target_domain_id"],
        }
        four = {k: v.orderBy(*orders[k]) if k in orders else v for k, v in four.items()}
        return {k: shown(v) if k.endswith("nodes") else v for k, v in four.items()}
    if kind == "pagegexf":
        nodes = qualified(e, land_id, minrel).select("id", "url", "title", "description", "keywords", "domain_id", "relevance", "depth")
        return {"nodes": with_ranking(nodes, t, land_id, minrel), "links": graph.page_edges(e, link, land_id, minrel)}
    if kind == "nodegexf":
        nodes = graph.domain_graph_nodes(e, d, land_id, minrel)
        links = graph.domain_links(e, d, link, land_id, minrel).select(F.col("source_domain_id").alias("source"), F.col("target_domain_id").alias("target"), F.col("link_count").alias("weight"))
        return {"nodes": nodes, "links": links}
    if kind == "pseudolinks":
        return {kind: similarity.pseudolinks(t.similarity, t.paragraph, e, land_id, minrel).orderBy(F.col("RelationScore").desc(), "Source_ParagraphID", "Target_ParagraphID")}
    if kind == "pseudolinkspage":
        return {kind: similarity.pseudolinks_page(t.similarity, t.paragraph, e, land_id, minrel).orderBy(F.col("PairCount").desc(), "Source_ExpressionID", "Target_ExpressionID")}
    if kind == "pseudolinksdomain":
        columns = ["Source_DomainID", "Source_Domain", "Target_DomainID", "Target_Domain", "PairCount", "Weight", "EntailCount", "NeutralCount", "ContradictCount", "AvgRelationScore", "AvgConfidence"]
        return {kind: similarity.pseudolinks_domain(t.similarity, t.paragraph, e, d, land_id, minrel).select(*columns).orderBy(F.col("PairCount").desc(), "Source_DomainID", "Target_DomainID")}
    if kind == "corpus":
        names = d.select(F.col("id").alias("domain_id"), F.col("name").alias("domain_name"))
        return {kind: qualified(e, land_id, minrel).join(names, "domain_id").select("id", "url", "title", "description", "readable", "domain_name")}
    if kind == "htmldump":
        pages = qualified(e, land_id, minrel).filter(F.col("html").isNotNull()).select("id", "html")
        return {"pages": pages, "manifest": graph.page_manifest(e, land_id, minrel)}
    raise ValueError(f"no such export: {kind}")


def export_parts(tables, kind: str, land_id: int, stem: str, minrel: int = 1, fullhtml: bool = False) -> list[str]:
    """Writes an export of any size from the executors, to folders (archives for ``corpus``) whose names begin with ``stem`` and which all executors share.

    Tables become CSV parts, the nodes and links of graph JSON one JSON object a line, stored pages a Parquet table; the rows of a
    part keep the export's order, and so do the parts. Returns the paths.
    """
    made = frames(tables, kind, land_id, minrel, fullhtml)
    if kind == "corpus":
        files.write_corpus_parts(made[kind], stem)
        return [stem]
    paths = []
    for name, df in made.items():
        path = f"{stem}_{name}"
        if kind in ("nodesjson", "pagesjson"):
            df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode("overwrite").text(path)
        elif name == "pages":
            df.write.mode("overwrite").parquet(path)
        else:
            files.write_csv_parts(df, path)
        paths.append(path)
    return paths


def export(tables, kind: str, land_id: int, stem: str, minrel: int = 1, fullhtml: bool = False) -> int:
    """Writes an export to single files whose names begin with ``stem``, through the driver; ``export_parts`` is the form for any size. Returns the rows or nodes written."""
    made = frames(tables, kind, land_id, minrel, fullhtml)
    path = files.file_name(kind, stem)
    if kind == "nodelinkcsv":
        return sum(files.write_csv(df, f"{stem}_{name}.csv", header=name.endswith("fullhtml")) for name, df in made.items())
    if kind in ("nodesjson", "pagesjson"):
        return files.write_graph_json(made["nodes"], made["links"], path)
    if kind in ("pagegexf", "nodegexf"):
        label, size = ("url", "relevance") if kind == "pagegexf" else ("name", "average_relevance")
        attributes = [c for c in made["nodes"].columns if c not in ("id", label)]
        return files.write_gexf(made["nodes"], made["links"], path, key="id", label=label, size=size, attributes=attributes)
    if kind == "corpus":
        return files.write_corpus(made[kind], stem)
    if kind == "htmldump":
        return files.write_html_dump(made["pages"], made["manifest"], path)
    return files.write_csv(made[kind], path)


def export_tags(tables, kind: str, land_id: int, stem: str) -> int:
    """``matrix`` (pages by tag path) or ``content`` (tagged texts) as CSV with a header in any case."""
    if kind == "matrix":
        return files.write_csv(tags.tag_matrix(tables.tag, tables.content, land_id).orderBy("expression_id"), f"{stem}.csv", header=True)
    return files.write_csv(tags.tagged_texts(tables.tag, tables.content, land_id).orderBy("path", "expression_id"), f"{stem}.csv", header=True)
