"""Row selection: the queues that decide which pages, domains and media come next.

A queue is a filter, an order and a limit over the present tables. Filters are plain
column expressions, so they reach the parquet scan; a limit always stands behind a total order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import urls


def _limited(df: DataFrame, limit: int) -> DataFrame:
    return df.limit(limit) if limit > 0 else df


def qualified(expression: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    """Pages of a land with at least the relevance; pages without relevance do not qualify."""
    return expression.filter((F.col("land_id") == land_id) & (F.col("relevance") >= minrel))


def frontier(expression: DataFrame, land_id: int, *, http: str | None = None, depth: int | None = None, retry_status: list[str] | None = None, limit: int = 0) -> DataFrame:
    """Pages to fetch: those with a status to retry, else of one status, else never fetched; shallow ones first."""
    rows = expression.filter(F.col("land_id") == land_id)
    if retry_status:
        rows = rows.filter(F.col("http_status").isin(*retry_status))
    elif http:
        rows = rows.filter(F.col("http_status") == http)
    else:
        rows = rows.filter(F.col("fetched_at").isNull())
    if depth is not None:
        rows = rows.filter(F.col("depth") == depth)
    return _limited(rows.orderBy("depth", "id") if limit else rows, limit)


def readable_queue(expression: DataFrame, land_id: int, limit: int = 0) -> DataFrame:
    """Fetched pages without readable text, first fetched first."""
    rows = expression.filter((F.col("land_id") == land_id) & F.col("fetched_at").isNotNull() & F.col("readable_at").isNull())
    return _limited(rows.orderBy(F.col("fetched_at").asc_nulls_first(), "depth", "id") if limit else rows, limit)


def consolidation_set(expression: DataFrame, land_id: int, *, depth: int | None = None, minrel: int = 0, limit: int = 0) -> DataFrame:
    rows = expression.filter((F.col("land_id") == land_id) & (F.col("approved_at").isNotNull() | F.col("readable_at").isNotNull()))
    if depth is not None:
        rows = rows.filter(F.col("depth") == depth)
    if minrel > 0:
        rows = rows.filter(F.col("relevance") >= minrel)
    return _limited(rows.orderBy("id") if limit else rows, limit)


def seo_queue(expression: DataFrame, land_id: int, *, depth: int | None = None, http_status: str | None = "200", minrel: int = 0, force: bool = False, limit: int = 0) -> DataFrame:
    rows = expression.filter(F.col("land_id") == land_id)
    if depth is not None:
        rows = rows.filter(F.col("depth") == depth)
    if http_status and http_status.lower() not in ("all", "any", "none"):
        rows = rows.filter(F.col("http_status") == http_status)
    if minrel > 0:
        rows = rows.filter(F.col("relevance") >= minrel)
    if not force:
        rows = rows.filter(F.col("seorank").isNull())
    return _limited(rows.orderBy("id") if limit else rows, limit)


def llm_queue(expression: DataFrame, land_id: int, *, force: bool = False, least: int = 140, limit: int = 0) -> DataFrame:
    """Pages without a verdict, with ``force`` also those judged non, whose readable text is long enough."""
    open_ = F.col("validllm").isNull() | ~F.col("validllm").isin("oui", "non")
    if force:
        open_ = open_ | (F.col("validllm") == "non")
    rows = expression.filter((F.col("land_id") == land_id) & F.col("readable").isNotNull() & (F.length("readable") >= least) & open_)
    return _limited(rows.orderBy("id") if limit else rows, limit)


def domain_queue(domain: DataFrame, http: str | None = None) -> DataFrame:
    """Domains to fetch: failed ones for ``ERR``, those of a status, else never fetched."""
    if http is None:
        return domain.filter(F.col("fetched_at").isNull())
    if http.upper() == "ERR":
        return domain.filter(F.col("http_status").startswith("ERR") | F.col("http_status").isin("000", "ARC_NO_HTML", "REQ_NO_HTML"))
    return domain.filter(F.col("http_status") == http)


def below_relevance(expression: DataFrame, land_id: int, maxrel: int) -> DataFrame:
    """Fetched pages under a relevance."""
    return expression.filter((F.col("land_id") == land_id) & (F.col("relevance") < maxrel) & F.col("fetched_at").isNotNull())


def orphans(expression: DataFrame, link: DataFrame, land_id: int, *, dry_run_maxrel: int | None = None) -> DataFrame:
    """Pages below the seeds, never fetched, to which no link points.

    A real run counts links from anywhere. A dry run counts only those from pages of the land that would survive a
    deletion under ``dry_run_maxrel``.
    """
    rows = expression.filter((F.col("land_id") == land_id) & F.col("fetched_at").isNull() & (F.col("depth") > 0))
    if dry_run_maxrel is not None:
        land = expression.filter(F.col("land_id") == land_id).select(F.col("id").alias("source_id"), "relevance", "fetched_at")
        doomed = (F.col("relevance") < dry_run_maxrel) & F.col("fetched_at").isNotNull()
        link = link.join(land.filter(~F.coalesce(doomed, F.lit(False))).select("source_id"), "source_id", "left_semi")
    return rows.join(link.select(F.col("target_id").alias("id")), "id", "left_anti")


def malformed(url: Column) -> Column:
    """Addresses that Markdown leaked into."""
    low = F.lower(url)
    signs = F.lit(False)
    for sign in (")(", "](", ")[", "javascript:"):
        signs = signs | F.contains(low, F.lit(sign))
    opened, closed = (F.length(url) - F.length(F.replace(url, F.lit(c), F.lit(""))) for c in "()")
    return signs | (opened > closed)


def malformed_orphans(expression: DataFrame, link: DataFrame) -> DataFrame:
    rows = expression.filter(F.col("readable").isNull() & malformed(F.col("url")))
    return rows.join(link.select(F.col("target_id").alias("id")), "id", "left_anti")


def snapshot_domain_pages(expression: DataFrame, domain: DataFrame) -> DataFrame:
    """Pages filed under a snapshot host: unwrapped, filed under the domain (``new_domain``) of the page itself, their ranking reset."""
    from corpusloom.functions.domains import resolved

    hosts = domain.filter(F.col("name").isin(*urls.SNAPSHOT_FORMS)).select(F.col("id").alias("domain_id"))
    pages = expression.join(F.broadcast(hosts), "domain_id", "left_semi")  # three hosts at most
    pages = pages.withColumn("seorank", F.lit(None).cast("string")).withColumn("url", urls.unwrapped("url"))
    return pages.withColumn("new_domain", resolved("url"))


def snapshot_renames(expression: DataFrame) -> DataFrame:
    """(id, land_id, url, new_url): snapshot addresses to unwrap; where the target is already in the land, or an earlier row takes it, the row stays."""
    forms = "^https?://(web\\.archive\\.org/web/|archive\\.org/web/|ghostarchive\\.org/archive/)"
    rows = expression.filter(F.col("url").rlike(forms)).select("id", "land_id", "url", urls.unwrapped("url").alias("new_url")).filter("new_url <> url")
    there = expression.select("land_id", F.col("url").alias("new_url"))
    first = Window.partitionBy("land_id", "new_url").orderBy("id")
    return rows.join(there, ["land_id", "new_url"], "left_anti").withColumn("rn", F.row_number().over(first)).filter("rn = 1").select("id", "land_id", "url", "new_url")


def media_conforming(media: DataFrame, *, min_width: int = 0, min_height: int = 0, max_bytes: int = 0) -> DataFrame:
    """Media within the active bounds (those above 0); a missing size counts as 0."""
    ok = F.lit(True)
    if min_width > 0:
        ok = ok & (F.coalesce("width", F.lit(0)) >= min_width)
    if min_height > 0:
        ok = ok & (F.coalesce("height", F.lit(0)) >= min_height)
    if max_bytes > 0:
        ok = ok & (F.coalesce("file_size", F.lit(0)) <= max_bytes)
    return media.filter(ok)


def media_doomed(media: DataFrame, *, min_width: int = 0, min_height: int = 0, max_bytes: int = 0) -> DataFrame:
    """Analysed media that break an active bound; without an active bound, none."""
    bad = F.lit(False)
    if min_width > 0:
        bad = bad | F.col("width").isNull() | (F.col("width") < min_width)
    if min_height > 0:
        bad = bad | F.col("height").isNull() | (F.col("height") < min_height)
    if max_bytes > 0:
        bad = bad | F.coalesce(F.col("file_size") > max_bytes, F.lit(False))
    return media.filter(F.col("analyzed_at").isNotNull() & bad)


def media_counts(media: DataFrame, **bounds: int) -> DataFrame:
    """One row (analysed, doomed, unanalysed): what a clean-up by the given bounds would do; media not analysed yet are told apart, not judged."""
    doomed = media_doomed(media, **bounds).agg(F.count(F.lit(1)).alias("doomed"))
    seen = media.agg(F.count("analyzed_at").alias("analysed"), F.count_if(F.col("analyzed_at").isNull()).alias("unanalysed"))
    return seen.crossJoin(F.broadcast(doomed)).select("analysed", "doomed", "unanalysed")  # single rows


def media_scope(media: DataFrame, expression: DataFrame, *, depth: int, minrel: int) -> DataFrame:
    pages = expression.filter((F.col("depth") <= depth) & (F.col("relevance") >= minrel)).select(F.col("id").alias("expression_id"))
    return media.join(pages, "expression_id", "left_semi")


def reanalysis_order(media: DataFrame) -> DataFrame:
    """Never analysed first, then those with errors, then by id."""
    return media.orderBy(F.col("analyzed_at").isNotNull(), F.col("analysis_error").isNull(), "id")


def attempts(statuses: Column, retry: tuple[str, ...] = ("403", "406", "429", "503", "520", "521", "523", "526", "ERR")) -> Column:
    """Which attempt of a fetch cascade counts: the first with a page; else the first of all, which keeps the site's own status.

    ``statuses`` is an array of struct(strategy, status, html) in the order of the strategies. The second strategy counts only
    after a status that is worth it.
    """
    allowed = F.filter(statuses, lambda a, i: (i != 1) | F.get(statuses, F.lit(0))["status"].isin(*retry))
    return F.coalesce(F.get(F.filter(allowed, lambda a: F.coalesce(a["html"], F.lit("")) != ""), F.lit(0)), F.get(statuses, F.lit(0)))


def batches(df: DataFrame, order: list[str], size: int = 1000) -> DataFrame:
    """``df`` with its position and the number of its batch, counted from 1.

    Positions come from a range-partitioned sort: each partition counts its rows, and starts where the
    partitions before it end, so no task sees all rows. ``order`` must be a total order.
    """
    from corpusloom.sources.tables import ensure_checkpoint_dir

    ensure_checkpoint_dir(df.sparkSession)
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    spread = df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_part", F.spark_partition_id()).withColumn("_pos", F.monotonically_increasing_id()).checkpoint()
    sizes = spread.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    starts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = spread.join(F.broadcast(starts.select("_part", "_first", "_before")), "_part")  # one row a partition
    return at.withColumn("position", F.col("_before") + F.col("_pos") - F.col("_first") + 1).withColumn("batch", F.ceil(F.col("position") / size).cast("long")).drop("_part", "_pos", "_first", "_before")
