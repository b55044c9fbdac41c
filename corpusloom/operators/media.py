"""Counts and lists of media."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.select import qualified

KB, MB = 1024, 1024 * 1024


def media_list(media: DataFrame, expression: DataFrame, land_id: int, minrel: int = 1) -> DataFrame:
    pages = qualified(expression, land_id, minrel).select(F.col("id").alias("expression_id"))
    return media.join(pages, "expression_id", "left_semi").select("id", "expression_id", "url", "type")


def formats(media: DataFrame) -> DataFrame:
    return media.groupBy(F.coalesce("format", F.lit("unknown")).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def dimensions(media: DataFrame) -> DataFrame:
    """Counts of unknown, small (either side under 200), large (both from 1000) and other sizes, in one pass."""
    w, h = F.col("width"), F.col("height")
    unknown = w.isNull() | h.isNull()
    small = ~unknown & ((w < 200) | (h < 200))
    large = ~unknown & (w >= 1000) & (h >= 1000)
    return media.agg(F.count_if(unknown).alias("unknown"), F.count_if(small).alias("small"), F.count_if(~unknown & ~small & ~large).alias("medium"), F.count_if(large).alias("large"))


def file_sizes(media: DataFrame) -> DataFrame:
    s = F.col("file_size")
    return media.agg(F.count_if(s.isNull()).alias("unknown"), F.count_if(s < 100 * KB).alias("small"), F.count_if((s >= 100 * KB) & (s < MB)).alias("medium"), F.count_if(s >= MB).alias("large"))


def duplicates(media: DataFrame) -> DataFrame:
    """Groups of equal images and the files in them."""
    groups = media.filter("image_hash IS NOT NULL").groupBy("image_hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("files"))


def totals(media: DataFrame) -> DataFrame:
    return media.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("analyzed_at").isNotNull()).alias("analysed"), F.count_if(F.col("analysis_error").isNotNull()).alias("errors"))


def palette(colours: DataFrame) -> DataFrame:
    """(media_id, websafe): share of each web-safe colour from rows (media_id, r, g, b, percentage)."""
    from corpusloom.functions.vectors import web_safe_hex

    per = colours.groupBy("media_id", web_safe_hex(F.col("r"), F.col("g"), F.col("b")).alias("hex")).agg(F.sum("percentage").alias("share"))
    return per.groupBy("media_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("hex", "share")))).alias("websafe"))


def dominant_colours(images: DataFrame, k: int = 5, seed: int = 42) -> DataFrame:
    """(media_id, rank, r, g, b, percentage) of arrays of pixels (media_id, pixels: array<array<int>>), by k-means on each image."""
    import numpy as np
    import pandas as pd

    def run(batches):
        for batch in batches:
            rows = []
            for key, pixels in zip(batch["media_id"], batch["pixels"]):
                x = np.array([list(p) for p in pixels], float).reshape(-1, 3)
                if not len(x):
                    continue
                kinds = np.unique(x, axis=0)
                centres = kinds[np.random.default_rng(seed).permutation(len(kinds))[:k]]
                for _ in range(25):
                    at = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
                    moved = np.array([x[at == j].mean(0) if (at == j).any() else c for j, c in enumerate(centres)])
                    if np.allclose(moved, centres):
                        break
                    centres = moved
                n = np.bincount(at, minlength=len(centres))
                for rank, j in enumerate(np.argsort(-n, kind="stable")):
                    rows.append((key, rank, *map(int, centres[j].round()), 100.0 * n[j] / len(x)))
            yield pd.DataFrame(rows, columns=["media_id", "rank", "r", "g", "b", "percentage"])

    return images.select("media_id", "pixels").mapInPandas(run, "media_id bigint, rank int, r int, g int, b int, percentage double")
