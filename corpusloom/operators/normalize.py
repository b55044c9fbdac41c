"""Retro-active normalisation: renames, merges and the rewriting of links."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.functions.domains import resolved
from corpusloom.sources.tables import ensure_checkpoint_dir


def plan(expression: DataFrame, *, native: bool = False) -> DataFrame:
    """(id, land_id, url, new_url, canonical_id, action) of the pages whose address changes.

    ``merge`` into the page that already has the new address (the last of them, should there be several), else ``rename``.
    Two pages that take the same free address are both renamed.
    """
    rows = expression.select("id", "land_id", "url", (urls.normalize_native(F.col("url")) if native else urls.normalize("url")).alias("new_url"))
    have = expression.groupBy("land_id", F.col("url").alias("new_url")).agg(F.max("id").alias("canonical_id"))
    moved = rows.filter("new_url <> url").join(have, ["land_id", "new_url"], "left")
    merge = F.col("canonical_id").isNotNull() & (F.col("canonical_id") != F.col("id"))
    return moved.select("id", "land_id", "url", "new_url", F.when(merge, F.col("canonical_id")).alias("canonical_id"), F.when(merge, "merge").otherwise("rename").alias("action"))


def limited(moves: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` moves by id, renames before merges."""
    return moves.orderBy(F.col("action").desc(), "id").limit(limit)


def renamed(expression: DataFrame, moves: DataFrame, reset_status: bool = False) -> DataFrame:
    """Pages with their new addresses and domains' names in ``domain``; the first original address stays."""
    m = moves.filter("action = 'rename'").select(F.col("id").alias("mid"), "new_url")
    rows = expression.join(m, F.col("id") == F.col("mid"), "left")
    changed = F.col("new_url").isNotNull()
    out = rows.withColumns({
        "original_url": F.when(changed, F.coalesce("original_url", "url")).otherwise(F.col("original_url")),
        "url": F.coalesce("new_url", "url"),
        "http_status": F.when(changed & F.lit(reset_status), F.lit(None)).otherwise(F.col("http_status")),
    })
    return out.withColumn("domain", resolved("url")).drop("mid", "new_url")


def terminals(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b): each start with the end of its chain; what runs into a cycle is dropped.

    Pointer jumping: every round doubles the length of the known chains, and writes them to the checkpoint folder.
    """
    ensure_checkpoint_dir(pairs.sparkSession)
    now = pairs.select(F.col(a).alias("x"), F.col(b).alias("y")).filter("x <> y").groupBy("x").agg(F.min("y").alias("y")).checkpoint()
    total = now.count()
    rounds = max(1, total.bit_length() + 1)
    for _ in range(rounds):
        step = now.select(F.col("x").alias("k"), F.col("y").alias("z"))
        joined = now.join(step, F.col("y") == F.col("k"), "left")
        open_ = joined.filter("k IS NOT NULL").limit(1).count()
        now = joined.select("x", F.coalesce("z", "y").alias("y")).checkpoint()
        if not open_:
            break
    # whoever still points into the starts runs round a cycle
    ends = now.join(now.select(F.col("x").alias("k")), F.col("y") == F.col("k"), "left_anti")
    return ends.select(F.col("x").alias(a), F.col("y").alias(b))


def merged_links(link: DataFrame, moves: DataFrame) -> DataFrame:
    """Links after the merges: both ends follow their page; new self-links go, of equal links that of the canonical page stays.

    Links from a page to itself that no merge touched stay.
    """
    m = terminals(moves.filter("action = 'merge'").select("id", "canonical_id"), "id", "canonical_id")
    s = m.select(F.col("id").alias("s0"), F.col("canonical_id").alias("s1"))
    t = m.select(F.col("id").alias("t0"), F.col("canonical_id").alias("t1"))
    rows = link.join(s, F.col("source_id") == F.col("s0"), "left").join(t, F.col("target_id") == F.col("t0"), "left")
    moved = F.col("s1").isNotNull() | F.col("t1").isNotNull()
    rows = rows.withColumns({"was_s": F.col("source_id"), "was_t": F.col("target_id"), "moved": moved}).withColumns({"source_id": F.coalesce("s1", "source_id"), "target_id": F.coalesce("t1", "target_id")})
    rows = rows.filter(~(F.col("moved") & (F.col("source_id") == F.col("target_id"))))
    best = Window.partitionBy("source_id", "target_id").orderBy("moved", "was_s", "was_t")
    return rows.withColumn("rn", F.row_number().over(best)).filter("rn = 1").select(*link.columns)


def without_merged(table: DataFrame, moves: DataFrame, key: str) -> DataFrame:
    """A table without the rows of the pages that were merged away."""
    return table.join(moves.filter("action = 'merge'").select(F.col("id").alias(key)), key, "left_anti")


def totals(moves: DataFrame, link: DataFrame, media: DataFrame | None = None) -> DataFrame:
    """One row: renamed, merged, links kept, links dropped, media lost."""
    after = merged_links(link, moves)
    counts = moves.agg(F.count_if(F.col("action") == "rename").alias("renamed"), F.count_if(F.col("action") == "merge").alias("merged"))
    a, b = link.agg(F.count(F.lit(1)).alias("before")), after.agg(F.count(F.lit(1)).alias("links"))
    out = counts.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).withColumn("dropped", F.col("before") - F.col("links")).drop("before")  # single rows
    if media is not None:
        gone = moves.filter("action = 'merge'").select(F.col("id").alias("expression_id"))
        out = out.crossJoin(F.broadcast(media.join(gone, "expression_id", "left_semi").agg(F.count(F.lit(1)).alias("media_lost"))))
    return out


# --- logical domains ---------------------------------------------------------------


def reassigned(expression: DataFrame, domain: DataFrame, *, use_html: bool = False, only_listed: bool = True) -> DataFrame:
    """(id, old_domain, new_domain) of the pages whose logical domain differs; by default only on listed platforms."""
    from corpusloom.functions.platforms import PLATFORMS

    rows = expression.join(domain.select(F.col("id").alias("domain_id"), F.col("name").alias("old_domain")), "domain_id")
    if only_listed:
        host = F.regexp_replace(F.lower(F.coalesce(urls.host(F.col("url")), F.lit(""))), "^www\\.", "")
        labels = F.split(host, "\\.")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.lit(99)), "."))
        listed = F.array(*[F.lit(p[0]) for p in PLATFORMS])
        rows = rows.filter(F.arrays_overlap(suffixes, listed))
    new = resolved("url", "html") if use_html else resolved("url")
    return rows.withColumn("new_domain", new).filter("new_domain <> old_domain AND new_domain <> ''").select("id", "old_domain", "new_domain")


def transitions(changes: DataFrame, limit: int = 25) -> DataFrame:
    """The most frequent changes of domain."""
    return changes.groupBy("old_domain", "new_domain").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "old_domain", "new_domain").limit(limit)


def resolution_rates(expression: DataFrame) -> DataFrame:
    """By platform suffix: pages, with stored HTML, improved by it, and the rate; one row TOTAL."""
    from corpusloom.functions.domains import is_open

    host = F.regexp_replace(F.lower(F.coalesce(urls.host(F.col("url")), F.lit(""))), "^www\\.", "")
    # addresses that tell all by themselves go before any page is parsed
    rows = expression.select(host.alias("suffix"), "url", "html").filter(is_open("url")).withColumn("by_url", resolved("url")).withColumn("by_page", resolved("url", "html"))
    better = F.col("by_page") != F.col("by_url")
    per = rows.rollup("suffix").agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.col("html").isNotNull()).alias("with_html"), F.count_if(better).alias("improved"))
    return per.select(F.coalesce("suffix", F.lit("TOTAL")).alias("suffix"), "pages", "with_html", "improved", F.round(F.col("improved") / F.nullif("with_html", F.lit(0)), 4).alias("rate"))
