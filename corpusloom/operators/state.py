"""State transitions: what a crawl, an extraction or a verdict changes in the tables.

A transition is a function from tables to new versions of them. What a service would
answer comes in as columns, so every rule can be tested without one.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions import markdown, urls
from corpusloom.functions import text as T
from corpusloom.functions.domains import resolved

#: Pages deeper than this give no links.
MAX_DEPTH = 3


def expressions_to_add(candidates: DataFrame, expression: DataFrame) -> DataFrame:
    """(land_id, url, original_url, depth, domain) of the crawlable addresses that a land lacks; the shallowest of equal ones."""
    rows = candidates.withColumn("new_url", urls.normalize("url")).filter(urls.crawlable(F.col("new_url")))
    rows = rows.groupBy("land_id", "new_url").agg(F.min(F.struct("depth", F.when(F.col("url") != F.col("new_url"), F.col("url")).alias("original_url"))).alias("first"))
    rows = rows.select("land_id", F.col("new_url").alias("url"), "first.original_url", "first.depth")
    return rows.join(expression.select("land_id", "url"), ["land_id", "url"], "left_anti").withColumn("domain", resolved("url"))


def crawl_links(pages: DataFrame, links: str) -> DataFrame:
    """(source_id, land_id, url, depth): links of relevant pages above the greatest depth, each once."""
    rows = pages.filter((F.col("relevance") > 0) & (F.col("depth") < MAX_DEPTH))
    return rows.select(F.col("id").alias("source_id"), "land_id", (F.col("depth") + 1).alias("depth"), F.explode(links).alias("url")).withColumn("url", urls.normalize("url")).filter(urls.crawlable(F.col("url"))).distinct()


def replaced_links(link: DataFrame, crawled: DataFrame, found: DataFrame) -> DataFrame:
    """Links without the old ones of crawled pages (column id), with the new ones, each pair once."""
    kept = link.join(crawled.select(F.col("id").alias("source_id")), "source_id", "left_anti").select("source_id", "target_id")
    return kept.unionByName(found.select("source_id", "target_id")).distinct()


def relevance(pages: DataFrame, words: DataFrame, land: DataFrame, *, native: bool = False) -> DataFrame:
    """(id, relevance): hits of the land's lemmas, those in the title ten times.

    Every lemma of the land counts, in whatever language; a lemma that two languages share counts twice. A null title or
    text reads as the word none. ``native`` keeps words as they are instead of stemming them, inside generated code.
    """
    lang = T.text_language(F.col("lang"), F.col("land_langs"))
    rows = pages.join(land.select(F.col("id").alias("land_id"), F.col("lang").alias("land_langs")), "land_id").withColumn("_lang", lang)
    if native:
        stems = lambda c: F.array_join(T.tokens(F.coalesce(F.col(c), F.lit("None"))), " ")
        rows = rows.withColumn("_t", stems("title")).withColumn("_r", stems("readable"))
    else:
        rows = rows.withColumn("_t", T.stemmed(F.coalesce("title", F.lit("None")), "_lang")).withColumn("_r", T.stemmed(F.coalesce("readable", F.lit("None")), "_lang"))
    # the dictionary of a land has hundreds of terms: it goes to its pages as one array
    terms = words.groupBy("land_id").agg(F.collect_list("lemma").alias("_lemmas"))
    rows = rows.join(terms, "land_id", "left")
    hits = lambda c: F.aggregate(F.coalesce("_lemmas", F.array().cast("array<string>")), F.lit(0), lambda s, w: s + T.phrase_hits(F.col(c), w))
    return rows.select("id", (hits("_t") * T.TITLE_WEIGHT + hits("_r")).alias("relevance"))


def post_crawl(pages: DataFrame, now: Column) -> DataFrame:
    """Pages after extraction, from the columns x_title, x_description, x_keywords, x_lang, x_relevance, x_allowed and land_langs.

    Another language than the land's, or a refusal, sets the relevance to 0; only relevant pages are approved.
    """
    accepted = T.language_accepted(F.col("x_lang"), F.col("land_langs"))
    score = F.when(~accepted | (F.col("x_allowed") == F.lit(False)), 0).otherwise(F.coalesce("x_relevance", F.lit(0)))
    filled = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    out = pages.withColumns({"title": F.coalesce(filled("x_title"), F.col("url")), "description": filled("x_description"), "keywords": filled("x_keywords"), "lang": filled("x_lang"), "relevance": score.cast("int"), "readable_at": now})
    out = out.withColumn("approved_at", F.when(F.col("relevance") > 0, now))
    return out.drop("x_title", "x_description", "x_keywords", "x_lang", "x_relevance", "x_allowed")


def merged_field(current: Column, extracted: Column, strategy: str, field: str) -> Column:
    """The value of a field after an extraction; an empty side always loses."""
    if field == "published_at":
        chosen = {"priority": extracted, "preserve": current, "smart": F.least(current, extracted)}[strategy]
        return F.when(current.isNull(), extracted).when(extracted.isNull(), current).otherwise(chosen)
    longer = F.when(F.length(extracted) > F.length(current), extracted).otherwise(current)
    smart = longer if field in ("title", "description") else extracted
    chosen = {"priority": extracted, "preserve": current, "smart": smart}[strategy]
    empty = lambda c: c.isNull() | (c == "")
    return F.when(extracted.isNull(), current).when(empty(current), extracted).when(empty(extracted), current).otherwise(chosen)


def merged_extraction(pages: DataFrame, extraction: DataFrame, strategy: str = "smart") -> DataFrame:
    """(id, title, description, readable, published_at, changed) of pages with an extraction (expression_id, title, excerpt, markdown, published_at)."""
    x = extraction.select(F.col("expression_id").alias("id"), F.col("title").alias("x_title"), F.col("excerpt").alias("x_description"), F.col("markdown").alias("x_readable"), F.col("published_at").alias("x_published_at"))
    rows = pages.select("id", "title", "description", "readable", "published_at").join(x, "id")
    new = {f: merged_field(F.col(f), F.col(f"x_{f}"), strategy, f) for f in ("title", "description", "readable", "published_at")}
    changed = F.lit(False)
    for f, c in new.items():
        changed = changed | ~c.eqNullSafe(F.col(f))
    return rows.select("id", *[c.alias(f) for f, c in new.items()], changed.alias("changed"))


def extraction_stats(results: DataFrame) -> DataFrame:
    """processed, updated, errors, skipped and success rate from rows (error, changed)."""
    error, changed = F.col("error").isNotNull(), F.coalesce("changed", F.lit(False))
    per = results.agg(F.count(F.lit(1)).alias("processed"), F.count_if(~error & changed).alias("updated"), F.count_if(error).alias("errors"), F.count_if(~error & ~changed).alias("skipped"))
    return per.withColumn("success_rate", F.coalesce(F.round(F.col("updated") / F.nullif("processed", F.lit(0)), 4), F.lit(0.0)))


def latest_extraction(mercury: DataFrame) -> DataFrame:
    """The last extraction of each page that did not fail."""
    order = F.struct("extraction_timestamp", "id")
    ok = mercury.filter("error IS NULL")
    return ok.groupBy("expression_id").agg(F.max_by(F.struct("id", "title", "excerpt", "markdown", "content", "date_published"), order).alias("x")).select("expression_id", "x.*")


def consolidated(pages: DataFrame, words: DataFrame, land: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(relevance, links, media) rebuilt from the readable texts of the given pages.

    Links are those of the text and of its HTML anchors; a refused page has relevance 0.
    Targets lie one deeper, at depth 1 where the page has none.
    """
    from corpusloom.functions.html import parse, text_media

    def found(t: pd.Series, b: pd.Series) -> pd.DataFrame:
        links, media = [], []
        for text, base in zip(t, b):
            both = dict.fromkeys([*markdown.resolved_links(text, base), *(u for u, _ in parse(text or "").links(base or ""))])
            links.append([u for u in both if u.lower().startswith(("http://", "https://"))])
            media.append([{"url": u, "type": k} for u, k in dict([*parse(text or "").media(base or ""), *text_media(text or "", base or "")]).items()])
        return pd.DataFrame({"links": links, "media": media})

    out = pages.withColumn("x", F.pandas_udf(found, "links array<string>, media array<struct<url: string, type: string>>")("readable", "url"))
    links = out.select(F.col("id").alias("source_id"), "land_id", F.coalesce(F.col("depth") + 1, F.lit(1)).alias("depth"), F.explode("x.links").alias("url"))
    links = links.withColumn("url", urls.normalize("url")).filter(urls.crawlable(F.col("url"))).distinct()
    media = out.select(F.col("id").alias("expression_id"), F.explode("x.media").alias("m")).select("expression_id", "m.url", "m.type").distinct()
    scores = relevance(pages, words, land)
    judged = pages.select("id", "validllm").join(scores, "id").select("id", F.when(F.col("validllm") == "non", 0).otherwise(F.col("relevance")).alias("relevance"))
    return judged, links, media


def dictionary(terms: DataFrame, land: DataFrame) -> DataFrame:
    """(land_id, term, lang, lemma): a word for each term and each language of its land."""
    langs = land.select(F.col("id").alias("land_id"), F.explode(F.filter(F.transform(F.split(F.coalesce("lang", F.lit("fr")), ","), lambda x: F.lower(F.trim(x))), lambda x: x != "")).alias("lang"))
    return terms.join(langs, "land_id").select("land_id", "term", "lang", T.lemma("term", "lang").alias("lemma")).distinct()


def orphan_words(word: DataFrame, bridge: DataFrame) -> DataFrame:
    return word.join(bridge.select(F.col("word_id").alias("id")), "id", "left_anti")


def judged(pages: DataFrame, answer: str) -> DataFrame:
    """Pages after a language model's answers: oui and non are kept, non sets the relevance to 0, anything else changes nothing."""
    v = T.verdict(F.col(answer))
    return pages.withColumns({"validllm": F.when(v != "?", v).otherwise(F.col("validllm")), "relevance": F.when(v == "non", 0).otherwise(F.col("relevance"))})


def domain_metadata(domain: DataFrame) -> DataFrame:
    """Domains from the columns x_title, h_title and so on: the extractor's value, else the page's, else for the title the name."""
    pick = lambda f: F.coalesce(F.nullif(F.trim(F.col(f"x_{f}")), F.lit("")), F.nullif(F.trim(F.col(f"h_{f}")), F.lit("")))
    out = domain.withColumns({"title": F.coalesce(pick("title"), F.concat(F.lit("Website: "), F.col("name"))), "description": pick("description"), "keywords": pick("keywords")})
    return out.drop(*[p + f for p in ("x_", "h_") for f in ("title", "description", "keywords")])


def deleted(doomed: DataFrame, **tables: tuple[DataFrame, list[str]]) -> dict[str, DataFrame]:
    """The tables without rows of the doomed pages (column id); each is given with the columns that refer to a page."""
    out = {}
    for name, (df, columns) in tables.items():
        left = df
        for c in columns:
            left = left.join(doomed.select(F.col("id").alias(c)), c, "left_anti")
        out[name] = left.select(*df.columns)
    return out


def enriched(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """Pages with the rankings (id, payload) that arrived; broken payloads change nothing."""
    good = answers.filter(F.try_parse_json("payload").isNotNull())
    return pages.join(good, "id", "left").withColumn("seorank", F.coalesce("payload", "seorank")).drop("payload")


def applied_extraction(pages: DataFrame, extraction: DataFrame, words: DataFrame, land: DataFrame, strategy: str = "smart") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pages, links, media) after an extraction: fields are merged; where the readable text changes, relevance, links and media are made anew."""
    merged = merged_extraction(pages, extraction, strategy).withColumnsRenamed({f: f"n_{f}" for f in ("title", "description", "readable", "published_at")})
    both = pages.join(merged, "id", "left").withColumn("_new", F.col("changed").isNotNull() & ~F.col("readable").eqNullSafe(F.col("n_readable")))
    have = F.col("changed").isNotNull()
    for f in ("title", "description", "readable", "published_at"):
        both = both.withColumn(f, F.when(have, F.col(f"n_{f}")).otherwise(F.col(f)))
    after = both.select(*pages.columns, "_new")
    fresh = after.filter("_new").drop("_new")
    scores, links, media = consolidated(fresh, words, land)
    out = after.join(scores.withColumnRenamed("relevance", "_score"), "id", "left").withColumn("relevance", F.when(F.col("_new"), F.col("_score").cast("int")).otherwise(F.col("relevance")))
    return out.select(*pages.columns), links, media


def domain_outcomes(attempts: DataFrame) -> DataFrame:
    """(domain_id, http_status, method, html) of fetched home pages from attempts (domain_id, ord, method, status, html).

    The first attempt with a page counts; without one, the status of the last attempt that has one, else ERR_NO_STATUS. Attempts
    carry the codes of their method: ERR_… and 000 for failures, ARC_NO_HTML and REQ_NO_HTML for answers that are no pages.
    """
    page = F.coalesce("html", F.lit("")) != ""
    won = F.min_by(F.struct("status", "method", "html"), F.when(page, F.col("ord")))
    last = F.max_by("status", F.when(F.col("status").isNotNull(), F.col("ord")))
    per = attempts.groupBy("domain_id").agg(won.alias("w"), last.alias("last"))
    return per.select("domain_id", F.coalesce("w.status", F.when(F.col("w").isNotNull(), F.lit("200")), "last", F.lit("ERR_NO_STATUS")).alias("http_status"), "w.method", "w.html")


def domains_fetched(domain: DataFrame, attempts: DataFrame, now: Column) -> DataFrame:
    """Domains after their home pages were fetched: status, time, and the title, description and keywords of the page; what failed has none."""
    from corpusloom.functions.html import page_struct

    got = domain_outcomes(attempts).withColumnRenamed("http_status", "_status").withColumn("_p", page_struct("html", F.lit("")))
    rows = domain.join(got, domain["id"] == got["domain_id"], "left")
    tried, won = F.col("_status").isNotNull(), F.col("method").isNotNull()
    filled = lambda f: F.nullif(F.trim(F.col(f"_p.{f}")), F.lit(""))
    title = F.coalesce(filled("title"), F.concat(F.lit("Website: "), F.col("name")))
    out = rows.withColumns({
        "http_status": F.coalesce("_status", "http_status"), "fetched_at": F.when(tried, now).otherwise(F.col("fetched_at")), "title": F.when(won, title).when(~tried, F.col("title")),
        "description": F.when(won, filled("description")).when(~tried, F.col("description")), "keywords": F.when(won, filled("keywords")).when(~tried, F.col("keywords")),
    })
    return out.select(*domain.columns)
