"""Problem 6: capping the records of dominant contributors.

``share_cap`` solves a share limit by water-filling over the sorted contributor
counts; ``cap_contributors`` then keeps each contributor's best records.

No contributor is ever gathered in one task. Records are counted by
(contributor, quality); running sums over those counts name the one quality at which the cap
falls. Its records are counted again by ranges of the tie-break, of equal width and as many as hold about ``RANGE``
records each, however far apart the values lie; and only the one range in which the cap falls is
ranked row by row.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Records of a tie-break range, about, where their values are spread evenly.
RANGE = 100_000


def contributor_counts(df: DataFrame, contributor: str) -> DataFrame:
    """(contributor, n); null is a contributor of its own."""
    return df.groupBy(F.col(contributor).alias("contributor")).agg(F.count(F.lit(1)).alias("n"))


def share_cap(counts: DataFrame, share: Fraction, of: str = "input") -> DataFrame:
    """One row (cap): the largest count that a contributor may keep.

    ``of="input"``: ``floor(share * all rows)``. ``of="output"``: the largest integer
    ``c`` with ``c <= share * sum(min(n, c))``, so that the shares hold in the
    output itself. It is found on the histogram of counts, which has at most
    ``sqrt(2 * rows)`` distinct values, by one window over the sorted values: above a
    water level the contributors count ``c`` each, below it they count in full.
    Where ``share`` times the number of contributors is below 1 no output but the empty
    one is consistent, and the cap is 0. An empty table has the cap 0.
    """
    num, den = share.numerator, share.denominator
    if of == "input":
        return counts.agg(F.expr(f"(coalesce(sum(n), 0) * {num}L) div {den}L").alias("cap"))
    hist = counts.groupBy("n").agg(F.count(F.lit(1)).alias("k"))
    w = Window.orderBy(F.col("n").desc())
    above = w.rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("n").asc()).rowsBetween(Window.unboundedPreceding, 0)
    levels = hist.select(
        "n",
        F.coalesce(F.sum("k").over(above), F.lit(0)).alias("k_above"),
        F.lag("n").over(w).alias("next_n"),
        F.sum(F.col("n") * F.col("k")).over(rest).alias("rest"),
    )
    # c * (den - num * k_above) <= num * rest; without a limit where the left factor is not positive
    factor = F.expr(f"{den}L - {num}L * k_above")
    limit = F.when(factor > 0, F.expr(f"({num}L * rest) div ({den}L - {num}L * k_above)"))
    level = F.least(limit, F.coalesce("next_n", "n"))
    level = F.when(limit.isNull(), F.coalesce("next_n", "n")).otherwise(level)
    return levels.select(F.when(level >= F.col("n"), level).alias("c")).agg(F.coalesce(F.max("c"), F.lit(0)).alias("cap"))


def cap_contributors(
    df: DataFrame,
    contributor: str,
    quality: str,
    tie: str,
    *,
    max_count: int | None = None,
    max_share: Fraction | None = None,
    share_of: str = "input",
) -> DataFrame:
    """``df`` with the boolean column ``kept``.

    Each contributor keeps at most ``max_count`` records and at most the count that
    ``share_cap`` allows, by highest ``quality`` (null below all values), then smallest
    ``tie`` (an integer column; null last). Null contributors form one
    contributor. Equal (quality, tie) rows at the cap are told apart arbitrarily, but
    exactly the allowed number is kept. A column ``kept`` of the input is replaced.
    """
    if max_count is None and max_share is None:
        raise ValueError("name a count or a share")
    rows = df.drop("kept").select(
        F.struct(*[F.col(f"`{c}`") for c in df.columns if c != "kept"]).alias("_row"),
        F.col(f"`{contributor}`").alias("_who"),
        F.col(f"`{quality}`").alias("_q"),
        F.col(f"`{tie}`").cast("long").alias("_tie"),
    )
    # The same plan without the other columns: the parquet scan reads three columns for the counts.
    grouped = rows.groupBy("_who", "_q").agg(F.count(F.lit(1)).alias("_n"), F.min("_tie").alias("_lo"), F.max("_tie").alias("_hi"))
    counts = grouped.groupBy(F.col("_who").alias("contributor")).agg(F.sum("_n").alias("n"))
    caps = [F.lit(max_count).cast("long")] if max_count is not None else []
    if max_share is not None:
        over = counts.crossJoin(F.broadcast(share_cap(counts, max_share, share_of)))  # one row
        caps.append(F.col("cap"))
    else:
        over = counts
    limit = F.least(*caps) if len(caps) > 1 else caps[0]
    over = over.withColumn("_cap", limit).filter(F.col("n") > F.col("_cap")).select(F.col("contributor").alias("_who2"), "_cap")
    order = Window.partitionBy("_who").orderBy(F.col("_q").desc_nulls_last())
    span = (F.col("_hi").cast("double") - F.col("_lo").cast("double") + 1) / F.ceil(F.col("_n") / RANGE)
    # one row for each contributor beyond its cap: the quality at which the cap falls
    cut = (
        grouped.join(over, F.col("_who").eqNullSafe(F.col("_who2")))
        .withColumn("_upto", F.sum("_n").over(order))
        .filter((F.col("_upto") > F.col("_cap")) & (F.col("_upto") - F.col("_n") <= F.col("_cap")))
        .select("_who2", F.col("_q").alias("_cq"), (F.col("_cap") - F.col("_upto") + F.col("_n")).alias("_need"), F.col("_lo").cast("double").alias("_from"), F.greatest(F.lit(1.0), span).alias("_width"))
    )
    joined = rows.join(cut, F.col("_who").eqNullSafe(F.col("_who2")), "left")
    same_q = F.col("_need").isNotNull() & F.col("_q").eqNullSafe(F.col("_cq"))
    better = F.when(F.col("_cq").isNull(), F.col("_q").isNotNull()).otherwise(F.coalesce(F.col("_q") > F.col("_cq"), F.lit(False)))
    ranges = F.when(same_q, F.coalesce(F.floor((F.col("_tie").cast("double") - F.col("_from")) / F.col("_width")), F.lit(2**62)))
    joined = joined.withColumn("_range", ranges).withColumn("_better", F.col("_need").isNull() | better)
    by_range = joined.filter("_range IS NOT NULL").groupBy("_who", "_range", "_need").agg(F.count(F.lit(1)).alias("_n"))
    along = Window.partitionBy("_who").orderBy("_range")
    edges = (
        by_range.withColumn("_upto", F.sum("_n").over(along))
        .filter((F.col("_upto") > F.col("_need")) & (F.col("_upto") - F.col("_n") <= F.col("_need")))
        .select(F.col("_who").alias("_who3"), F.col("_range").alias("_crange"), (F.col("_need") - F.col("_upto") + F.col("_n")).alias("_left"))
    )
    marked = joined.join(edges, F.col("_who").eqNullSafe(F.col("_who3")), "left")
    marked = marked.withColumn("_edge", F.coalesce(F.col("_range") == F.col("_crange"), F.lit(False))).withColumn("_sure", F.col("_better") | F.coalesce(F.col("_range") < F.col("_crange"), F.lit(False)))
    plain = marked.filter(~F.col("_edge")).select("_row.*", F.col("_sure").alias("kept"))
    in_edge = Window.partitionBy("_who").orderBy(F.col("_tie").asc_nulls_last())
    ranked = marked.filter("_edge").withColumn("_rank", F.row_number().over(in_edge)).select("_row.*", (F.col("_rank") <= F.col("_left")).alias("kept"))
    return plain.unionByName(ranked)
