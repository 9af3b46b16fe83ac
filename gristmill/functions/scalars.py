"""Scalar and vector expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def inverse_log_rank(rank: Column) -> Column:
    """1 / log2(rank + 1); 0 for no rank."""
    return F.when(rank.isNull(), 0.0).otherwise(math.log(2) / F.log(rank.cast("double") + 1))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def unit(v: Column) -> Column:
    """At unit length; a zero vector stays zero."""
    size = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: F.when(size > 0, x.cast("double") / size).otherwise(0.0))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 6371.0 * 2 * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(50.0)), F.lit(-50.0))))


def bands(value: Column, edges: list[tuple[float, str]], last: str) -> Column:
    """The label of the first edge that the value doesn't exceed."""
    out = None
    for edge, label in edges:
        out = F.when(value <= edge, label) if out is None else out.when(value <= edge, label)
    return out.otherwise(last)


def pre_rank_band(rank: Column) -> Column:
    return bands(rank, [(10, "001_010"), (30, "011_030"), (80, "031_080"), (150, "081_150")], "151_plus")


def learned_rank_band(rank: Column) -> Column:
    return bands(rank, [(10, "001_010"), (30, "011_030"), (60, "031_060"), (100, "061_100")], "101_plus")


def scaled_round(value: Column, places: int) -> Column:
    """As DuckDB rounds a double: its product with the power of ten, half away from zero, and back. ``F.round`` takes the shortest
    decimal of the double instead, and parts from it where that ends in a 5 that the product falls short of (0.575 times 100)."""
    return F.round(value * float(10**places)) / float(10**places)
