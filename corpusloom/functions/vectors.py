"""Vector and number functions."""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bins of the hash embedding, and the factor that spreads code points over them.
BINS, FACTOR = 64, 1_315_423_911


def dot(a: Column, b: Column) -> Column:
    """Sum of products in order, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    """Euclidean length; 1 for a zero vector."""
    length = F.sqrt(dot(a, a))
    return F.when(length == 0, 1.0).otherwise(length)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def unit(a: Column) -> Column:
    length = norm(a)
    return F.transform(a, lambda x: x.cast("double") / length)


def hash_bins(text: Column) -> Column:
    """Counts of the code points of the lower-case text by bin.

    One bin count a text in numpy: nested higher-order functions would pass over the text once for each bin.
    """

    def run(t: pd.Series) -> pd.Series:
        out = []
        for x in t:
            points = np.frombuffer((x or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            out.append(np.bincount(points * FACTOR % BINS, minlength=BINS).astype(float))
        return pd.Series(out)

    return F.pandas_udf(run, "array<double>")(text)


def hash_embedding(text: Column) -> Column:
    return unit(hash_bins(text))


def planes(dim: int, bits: int = 16, seed: int = 42) -> list[list[int]]:
    """Random signs, plane by plane."""
    draw = random.Random(seed)
    return [[1 if draw.random() > 0.5 else -1 for _ in range(dim)] for _ in range(bits)]


def signature(vector: Column, signs: list[list[int]]) -> Column:
    """Bit b is set where the vector lies on the positive side of plane b, or on it."""
    bits = [F.when(dot(vector, F.array(*[F.lit(float(s)) for s in plane])) >= 0, F.lit(1 << b)).otherwise(F.lit(0)) for b, plane in enumerate(signs)]
    total = bits[0]
    for bit in bits[1:]:
        total = total + bit
    return total.cast("long")


def web_safe(level: Column) -> Column:
    """Nearest of the six levels of a colour channel, the lower one of two as near."""
    return (F.ceil((level - 25.5) / 51).cast("int") * 51).cast("int")


def web_safe_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", web_safe(r), web_safe(g), web_safe(b))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when(F.coalesce(height, F.lit(0)) == 0, 0.0).otherwise(F.round(width / height, 2))
