"""Results of search services: payloads, merging, routing, persistence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import urls
from corpusloom.functions.dates import earlier
from corpusloom.functions.jsons import merged_names

# Where each service keeps its results, and the names of address, title, snippet and rank in them.
PAYLOADS = {
    "searxng": ("$.results", "url", "title", "content", None),
    "brave": ("$.web.results", "url", "title", "description", None),
    "serper": ("$.organic", "link", "title", "snippet", "position"),
    "serpapi": ("$.organic_results", "link", "title", "snippet", "position"),
    "tavily": ("$.results", "url", "title", "content", None),
}


def parsed_results(payload: DataFrame, column: str, provider: str, num: int, *keep: str) -> DataFrame:
    """(keep…, url, title, snippet, rank, providers) of the first ``num`` items of each payload.

    An item without address is left out but keeps its place in the count; broken payloads have no items.
    """
    where, url, title, snippet, position = PAYLOADS[provider]
    # names with a leading underscore would be hidden, so the item's fields are read by name from a map
    items = F.from_json(F.get_json_object(F.col(column), where), "array<map<string,string>>")
    rows = payload.select(*keep, F.posexplode(F.slice(items, 1, num)).alias("_pos", "_item"))
    own = F.expr(f"try_cast(_item['{position}'] AS INT)") if position else F.lit(None).cast("int")
    rows = rows.select(*keep, F.col("_item")[url].alias("url"), F.nullif(F.col("_item")[title], F.lit("")).alias("title"), F.nullif(F.col("_item")[snippet], F.lit("")).alias("snippet"), F.coalesce(F.nullif(own, F.lit(0)), F.col("_pos") + 1).alias("rank"), F.lit(provider).alias("providers"))
    return rows.filter("url IS NOT NULL AND url <> ''")


def merged(results: DataFrame, *by: str) -> DataFrame:
    """(by…, url, title, snippet, rank, providers): results with one canonical address made one.

    Rows come with ``batch_no`` and ``pos``, the order of first sight. Providers are named in that order, the rank is the
    least, title and snippet are the first that are not empty.
    """
    order = F.struct("batch_no", "pos")
    first = lambda c: F.coalesce(F.min_by(c, F.when(F.coalesce(F.col(c), F.lit("")) != "", order)), F.min_by(c, order)).alias(c)
    rows = results.filter(F.coalesce("url", F.lit("")) != "").withColumn("url", urls.canonical(F.col("url")))
    names = merged_names(F.transform(F.sort_array(F.collect_list(F.struct("batch_no", "pos", "providers"))), lambda x: x["providers"]))
    return rows.groupBy(*by, "url").agg(first("title"), first("snippet"), F.min("rank").alias("rank"), names.alias("providers"), F.min(order).alias("_seen"))


def ranked(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("rank").asc_nulls_last(), "_seen")


def routed(results: DataFrame, strategy: str, *by: str, allowed: list[str] | None = None) -> DataFrame:
    """``fallback``: results of the first provider that has any; ``parallel``: all of them."""
    if allowed:
        results = results.filter(F.lower("providers").isin(*[a.lower() for a in allowed]))
    if strategy == "parallel":
        return results
    if strategy != "fallback":
        raise ValueError(f"no such strategy: {strategy}")
    first = results.groupBy(*by).agg(F.min("batch_no").alias("batch_no"))
    return results.join(first, [*by, "batch_no"], "left_semi")


def persisted(results: DataFrame, expression: DataFrame, land_id: int) -> DataFrame:
    """Results with their normal address and what becomes of them: new, duplicate or skipped (not crawlable)."""
    rows = results.withColumn("url", urls.normalize("url"))
    there = expression.filter(F.col("land_id") == land_id).groupBy(F.col("url")).agg(F.min("id").alias("expression_id"))
    rows = rows.join(there, "url", "left")
    state = F.when(~F.coalesce(urls.crawlable(F.col("url")), F.lit(False)), "skipped").when(F.col("expression_id").isNotNull(), "duplicate").otherwise("new")
    return rows.withColumn("state", state)


def added_urls(listed: DataFrame, expression: DataFrame, land_id: int, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages of the land after the list, rows to add as url, new_title, new_date).

    An address that the land has as it is given belongs to that page, crawlable or not; any other is taken by its normal
    form and left out if that is not crawlable. A page without a title (null or empty; blanks are a title) takes the first one given that is not
    empty, in ``order`` (a column of the list; without it the smallest), and the earliest date counts.
    """
    land = expression.filter(F.col("land_id") == land_id)
    known = land.select("url").distinct().withColumn("_known", F.lit(True))
    place = F.col(order) if order else F.col("title")
    rows = listed.filter(F.coalesce("url", F.lit("")) != "").select("url", F.nullif("title", F.lit("")).alias("title"), "published_at", place.alias("_place")).join(known, "url", "left")
    normal = urls.normalize("url")
    rows = rows.withColumn("url", F.when(F.col("_known"), F.col("url")).otherwise(F.when(urls.crawlable(normal), normal))).filter("url IS NOT NULL")
    given = rows.groupBy("url").agg(F.min_by("title", F.when(F.col("title").isNotNull(), F.col("_place"))).alias("new_title"), F.min("published_at").alias("new_date"))
    pages = land.join(given, "url", "left")
    empty = F.coalesce("title", F.lit("")) == ""
    updated = pages.withColumns({"title": F.when(empty, F.coalesce("new_title", "title")).otherwise(F.col("title")), "published_at": earlier(F.col("published_at"), F.col("new_date"))}).drop("new_title", "new_date")
    return updated, given.join(known.select("url"), "url", "left_anti")


def usage(queries: DataFrame, report: str = "usage_report", order: str = "id") -> DataFrame:
    """Usage of each provider over the reports of all queries: sums, the last status that is not empty (else the first), the quota of the first report."""
    kind = "map<string,struct<calls:int,errors:int,status:string,monthly_quota:int>>"
    rows = queries.select(order, F.explode(F.from_json(report, kind)).alias("provider", "u")).select(order, "provider", "u.*")
    return rows.groupBy("provider").agg(
        F.sum(F.coalesce("calls", F.lit(0))).alias("calls"), F.sum(F.coalesce("errors", F.lit(0))).alias("errors"),
        F.coalesce(F.max_by("status", F.when(F.coalesce("status", F.lit("")) != "", F.col(order))), F.min_by("status", order)).alias("status"), F.min_by("monthly_quota", order).alias("monthly_quota"),
    )


def next_offset(payload: Column, current: Column, size: Column) -> Column:
    """Where the next page of results starts; null without a next link.

    What the payload says or its link carries counts if it lies further on; else the next page follows the ``size`` results of this one.
    """
    at = lambda name: F.get_json_object(payload, f"$.serpapi_pagination.{name}")
    link = F.coalesce(F.nullif(at("next_link"), F.lit("")), at("next"))
    said = [F.regexp_extract(at("next_offset"), "^\\s*(\\d+)\\s*$", 1), *[F.regexp_extract(link, f"[?&]{k}=(\\d+)", 1) for k in ("start", "first", "offset")]]
    further = [F.when(F.coalesce(x, F.lit("")) != "", F.when(x.cast("long") > current, x.cast("long"))) for x in said]
    return F.when(F.coalesce(link, F.lit("")) != "", F.coalesce(*further, F.when(size > 0, current + size)))


def first_seen_ids(rows: DataFrame, key: list[str], known: DataFrame, id_name: str = "id") -> DataFrame:
    """``known`` rows and new keys with ids after the greatest known one, in order of the key."""
    new = rows.select(*key).distinct().join(known.select(*key), key, "left_anti")
    top = known.agg(F.coalesce(F.max(id_name), F.lit(0)).alias("_top"))
    from corpusloom.operators.select import batches

    numbered = batches(new, key).crossJoin(F.broadcast(top))  # one row
    return known.select(id_name, *key).unionByName(numbered.select((F.col("position") + F.col("_top")).alias(id_name), *key))


def by_created(queries: DataFrame) -> DataFrame:
    return queries.orderBy(F.col("created_at").desc(), "id")


def ordinal(rows: DataFrame, by: str, *order: str) -> DataFrame:
    """Rank from 1 within a group."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order)))


def kept_windows(outcomes: DataFrame, *by: str) -> DataFrame:
    """Windows of a dated search whose results are kept: failures that pass are skipped, the first fatal one ends the search but keeps what came before.

    Rows come with ``win_start`` and ``status`` (ok, transient, fatal).
    """
    before = Window.partitionBy(*by).orderBy("win_start").rowsBetween(Window.unboundedPreceding, 0)
    fatal = F.max((F.col("status") == "fatal").cast("int")).over(before)
    return outcomes.withColumn("_stop", fatal).filter((F.col("_stop") == 0) & (F.col("status") == "ok")).drop("_stop")


def date_filter(engine: str, start: Column, end: Column) -> Column:
    """The parameter that limits a search to a window, as each engine writes it; null where it has none."""
    if engine == "google":
        return F.concat(F.lit("cdr:1,cd_min:"), F.date_format(start, "MM/dd/yyyy"), F.lit(",cd_max:"), F.date_format(end, "MM/dd/yyyy"))
    if engine == "duckduckgo":
        return F.concat(F.date_format(start, "yyyy-MM-dd"), F.lit(".."), F.date_format(end, "yyyy-MM-dd"))
    return F.lit(None).cast("string")
