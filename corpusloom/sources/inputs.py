"""Other inputs: address lists, payloads, pages fetched by a function."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What a fetch returns for an address.
ATTEMPT = "url string, strategy string, status string, html string"


def url_argument(spark: SparkSession, text: str) -> DataFrame:
    """(url) of a list with commas: empty items go before blanks are cut, so an item of blanks stays as an empty one."""
    one = spark.range(1).select(F.explode(F.filter(F.split(F.lit(text), ","), lambda x: x != "")).alias("url"))
    return one.select(F.trim("url").alias("url"))


def url_file(spark: SparkSession, path: str) -> DataFrame:
    """(url), one a line, blank lines left out."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")


def table_where(df: DataFrame, columns: dict[str, str], land_id: int, minrel: int) -> DataFrame:
    """A parameterised scan: named expressions of the qualified pages."""
    view = df.sparkSession.sql("SELECT * FROM {t} WHERE land_id = :land AND relevance >= :minrel", args={"land": land_id, "minrel": minrel}, t=df)
    return view.select([F.expr(e).alias(k) for k, e in columns.items()])


def offline(urls: pd.Series) -> pd.DataFrame:
    """The default fetcher: nothing can be reached."""
    return pd.DataFrame({"url": urls, "strategy": "offline", "status": "ERR", "html": None})


def fetched(frontier: DataFrame, url: str = "url", fetch: Callable[[pd.Series], pd.DataFrame] = offline) -> DataFrame:
    """Attempts (url, strategy, status, html) by a function that runs on the executors, batch by batch."""

    def run(batches):
        for batch in batches:
            yield fetch(batch[url])[["url", "strategy", "status", "html"]]

    return frontier.select(url).mapInPandas(run, ATTEMPT)
