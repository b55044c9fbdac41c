"""Sites: a site may stand in the domain table under several spellings of its name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def site_name(name: Column) -> Column:
    """A name in lower case without a leading ``www.`` and without a final dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "^www\\.", ""), "\\.$", "")


def spellings(domain: DataFrame, key: str, name: str) -> DataFrame:
    """(source, site): each domain id with the smallest id of its site. Ids whose name is null are sites of their own."""
    rows = domain.select(F.col(f"`{key}`").alias("source"), site_name(F.col(f"`{name}`")).alias("_name"))
    first = rows.filter("_name IS NOT NULL").groupBy("_name").agg(F.min("source").alias("site"))
    return rows.join(first, "_name", "left").select("source", F.coalesce("site", "source").alias("site")).filter("source IS NOT NULL").dropDuplicates(["source"])


def by_site(df: DataFrame, column: str, same: DataFrame | None) -> DataFrame:
    """``df`` with the ids in ``column`` replaced by their site's; ids that ``same`` lacks, and nulls, stay.

    The join is on the id alone, so the rows should be narrow: call it on counts or identifiers, not on texts.
    """
    if same is None:
        return df
    s = same.select(F.col("source").alias("_source"), F.col("site").alias("_site"))
    return df.join(s, F.col(column) == F.col("_source"), "left").withColumn(column, F.coalesce("_site", column)).drop("_source", "_site")
