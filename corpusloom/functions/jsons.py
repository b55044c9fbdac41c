"""JSON and map functions; broken JSON never fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def object_map(text: Column) -> Column:
    """map<string, string> of an object's members; an empty map for null, broken or other JSON."""
    ok = F.try_parse_json(text)
    return F.when(F.coalesce(F.schema_of_variant(ok).startswith("OBJECT"), F.lit(False)), F.from_json(text, "map<string,string>")).otherwise(F.create_map().cast("map<string,string>"))


def members(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, value) of each member: the long form of columns that only the data name."""
    return df.select(F.col(key), F.explode(object_map(F.col(text))).alias("name", "value"))


def widened(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    """``df`` with one column for each of the given names."""
    m = object_map(F.col(text))
    return df.select("*", *[m[n].alias(n) for n in names])


def merged_names(ordered: Column) -> Column:
    """``a+b`` of an array of such values: each name once, in order of first sight."""
    return F.array_join(F.array_distinct(F.filter(F.flatten(F.transform(ordered, lambda x: F.split(F.coalesce(x, F.lit("")), "\\+"))), lambda n: n != "")), "+")
