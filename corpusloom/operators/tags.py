"""Tag trees and what is tagged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tag_paths(tag: DataFrame) -> DataFrame:
    """(id, land_id, parent_id, sorting, path): names from the root, joined by ``_``.

    The tree is walked over all lands' tags by a recursive query; tags below a missing parent have no path.
    """
    return tag.sparkSession.sql(
        """
        WITH RECURSIVE tree AS (
            SELECT id, land_id, parent_id, sorting, name AS path FROM {tag} WHERE parent_id IS NULL
            UNION ALL
            SELECT c.id, c.land_id, c.parent_id, c.sorting, concat(p.path, '_', c.name) FROM {tag} c JOIN tree p ON c.parent_id = p.id)
        SELECT * FROM tree
        """,
        tag=tag,
    )


def tag_counts(tag: DataFrame, content: DataFrame, land_id: int | None = None) -> DataFrame:
    """(expression_id, path, n): the matrix of pages and tags in long form."""
    paths = tag_paths(tag)
    if land_id is not None:
        paths = paths.filter(F.col("land_id") == land_id)
    rows = content.join(paths.select(F.col("id").alias("tag_id"), "path"), "tag_id")
    return rows.groupBy("expression_id", "path").agg(F.count(F.lit(1)).alias("n"))


def tag_matrix(tag: DataFrame, content: DataFrame, land_id: int | None = None) -> DataFrame:
    """One row for each page, one column for each path, 0 where there is nothing."""
    paths = tag_paths(tag)
    if land_id is not None:
        paths = paths.filter(F.col("land_id") == land_id)
    names = [r["path"] for r in paths.select("parent_id", "sorting", "path").orderBy(F.col("parent_id").asc_nulls_first(), "sorting", "path").collect()]  # the columns of the file
    rows = content.join(paths.select(F.col("id").alias("tag_id"), "path"), "tag_id")
    return rows.groupBy("expression_id").pivot("path", names).agg(F.count(F.lit(1))).na.fill(0)


def tagged_texts(tag: DataFrame, content: DataFrame, land_id: int | None = None) -> DataFrame:
    paths = tag_paths(tag)
    if land_id is not None:
        paths = paths.filter(F.col("land_id") == land_id)
    return content.join(paths.select(F.col("id").alias("tag_id"), "path"), "tag_id").select("path", F.col("text").alias("content"), "expression_id")
