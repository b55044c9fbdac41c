"""Joins of many rows with a counted table, safe for keys that a third of all rows hold."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of one key beyond which it is sent to the rows instead of gathering them.
HOT = 1_000_000


def join_counted(rows: DataFrame, counted: DataFrame, keys: list[str], n: str, hot: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``counted``, which has one row for each key and in ``n`` the number of rows that hold it.

    Keys of more than ``hot`` (``HOT``) rows are broadcast: there is at most one for every ``hot`` rows, so a billion rows send
    a thousand keys. The others meet in a shuffle, in which no key has more than ``hot`` rows. Null keys are equal.
    ``rows`` is read twice and should be a written table.
    """
    hot = HOT if hot is None else hot
    other = counted.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in counted.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    drop = [f"_{k}" for k in keys]
    often, seldom = other.filter(F.col(n) > hot), other.filter(F.col(n) <= hot)
    sent = rows.join(F.broadcast(often), on)
    met = rows.join(F.broadcast(often.select(*drop)), on, "left_anti").join(seldom, on)
    return sent.unionByName(met).drop(*drop)
