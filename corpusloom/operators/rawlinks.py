"""The network of all links in stored pages, beside that of the readable texts.

The stored page is read once and leaves as an array of addresses; only addresses, not
pages, go into the shuffles.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.functions.html import parse
from corpusloom.operators.select import qualified


def _hrefs(html: pd.Series, base: pd.Series) -> pd.Series:
    return pd.Series([[urls.normalize_url(u) for u, _ in parse(t).links(b or "")] if t else [] for t, b in zip(html, base)])


def raw_links(pages: DataFrame) -> DataFrame:
    """(source_id, href) of every link in the stored pages, normal form, repeats kept."""
    found = pages.filter("html IS NOT NULL").select(F.col("id").alias("source_id"), F.pandas_udf(_hrefs, "array<string>")("html", "url").alias("hrefs"))
    return found.select("source_id", F.explode("hrefs").alias("href")).filter("href <> ''")


def _index(nodes: DataFrame, key, name: str) -> DataFrame:
    """Keys that belong to exactly one page."""
    return nodes.select(key.alias("key"), "id").filter("key IS NOT NULL").groupBy("key").agg(F.min("id").alias(name), F.max("id").alias("other")).filter(F.col(name) == F.col("other")).drop("other")


def page_edges(expression: DataFrame, link: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """(source_id, target_id, weightbody, weighthtml) with addresses and domains of both ends.

    Links of the readable texts weigh 1 and 0; links found only in the stored page 0 and their number. An address is
    looked up by its normal form, then without case and final slashes, then by host and path; a key of several pages finds none.
    """
    nodes = qualified(expression, land_id, minrel).select("id", "url", "domain_id", "html")
    keyed = nodes.select("id", urls.normalize("url").alias("norm"))
    raw = raw_links(nodes)
    href = F.col("href")
    tiers = [(F.col("norm"), href, "t1"), (urls.relaxed_key(F.col("norm")), urls.relaxed_key(href), "t2"), (urls.host_path_key(F.col("norm")), urls.host_path_key(href), "t3")]
    for own, asked, name in tiers:
        raw = raw.withColumn("_k", asked).join(_index(keyed, own, name).withColumnRenamed("key", "_k"), "_k", "left").drop("_k")
    hits = raw.select("source_id", F.coalesce("t1", "t2", "t3").alias("target_id")).filter("target_id IS NOT NULL AND source_id <> target_id")
    weighed = hits.groupBy("source_id", "target_id").agg(F.count(F.lit(1)).alias("weighthtml"))
    ids = nodes.select("id")
    body = link.join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(ids.select(F.col("id").alias("target_id")), "target_id", "left_semi").select("source_id", "target_id").distinct()
    only = weighed.join(body, ["source_id", "target_id"], "left_anti").select("source_id", "target_id", F.lit(0).cast("long").alias("weightbody"), "weighthtml")
    both = body.filter("source_id <> target_id").select("source_id", "target_id", F.lit(1).cast("long").alias("weightbody"), F.lit(0).cast("long").alias("weighthtml")).unionByName(only)
    s = nodes.select(F.col("id").alias("source_id"), F.col("url").alias("source_url"), F.col("domain_id").alias("source_domain_id"))
    t = nodes.select(F.col("id").alias("target_id"), F.col("url").alias("target_url"), F.col("domain_id").alias("target_domain_id"))
    return both.join(s, "source_id").join(t, "target_id")


def domain_edges(edges: DataFrame, domain: DataFrame) -> DataFrame:
    """Page edges summed by pair of different domains."""
    per = edges.filter("source_domain_id <> target_domain_id").groupBy("source_domain_id", "target_domain_id").agg(F.sum("weightbody").alias("in_body"), F.sum("weighthtml").alias("out_html"))
    s = domain.select(F.col("id").alias("source_domain_id"), F.col("name").alias("source_domain_name"))
    t = domain.select(F.col("id").alias("target_domain_id"), F.col("name").alias("target_domain_name"))
    return per.join(s, "source_domain_id").join(t, "target_domain_id")
