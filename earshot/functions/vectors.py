"""Expressions over vectors (array<double>)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Distances are rounded before they are compared, so that engines agree on ties.
DECIMALS = 9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine, null where a vector is zero."""
    return F.round(1 - F.try_divide(dot(a, b), norm(a) * norm(b)), DECIMALS) + 0.0  # no negative zero


def score(distance: Column, mode: str = "distance") -> Column:
    """Order is always by distance; only what is shown differs."""
    if mode not in ("distance", "similarity"):
        raise ValueError(f"unknown score mode {mode!r}")
    return distance if mode == "distance" else F.round(1 - distance, DECIMALS)
