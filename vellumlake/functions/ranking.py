"""Arithmetic of ranked lists, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def significant(x: Column, digits: int = 4) -> Column:
    """x rounded to so many significant digits."""
    scale = F.pow(F.lit(10.0), digits - 1 - F.floor(F.log10(F.abs(x))))
    return F.when(x == 0, F.lit(0.0)).otherwise(F.round(x * scale) / scale)


def reciprocal_rank(rank: Column) -> Column:
    """1/(60 + rank), with 0.05 more for the first and 0.02 for the next two."""
    return 1.0 / (60 + rank) + F.when(rank == 1, 0.05).when(rank <= 3, 0.02).otherwise(0.0)


def min_max(x: Column, low: Column, high: Column) -> Column:
    return F.when(high == low, 0.5).otherwise((x - low) / (high - low))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def blend(fused: Column, reranked: Column, rank: Column) -> Column:
    """Of two normalised scores; the better the fused rank, the more the fused score counts."""
    weight = F.when(rank <= 3, 0.75).when(rank <= 10, 0.5).otherwise(0.4)
    return weight * fused + (1 - weight) * reranked


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
