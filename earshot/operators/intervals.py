"""Joins of intervals of flat tables: by bins of a width, so that they are equi-joins.

An interval stands in every bin that it touches, so long ones are split over their bins, and a pair is given by one bin alone, the later one of
the two in which its intervals begin. A bin that holds more than one in ``HOT_SHARE`` of the left rows is dealt into parts, and its right rows
are repeated for each; there are at most ``HOT_SHARE`` such bins, and only their list is broadcast.

Intervals are half-open: [start, stop). Those that are empty, or have a null bound or key, join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE, LEAST_HOT = 500, 10_000


def _binned(rows: DataFrame, start: Column, stop: Column, width: float) -> DataFrame:
    """``rows`` with ``__first``, their first bin, once for each ``__bin``; a stop on a bin's edge doesn't touch it."""
    first, last = F.floor(start / width), F.ceil(stop / width) - 1
    return rows.where(start < stop).withColumn("__first", first).withColumn("__bin", F.explode(F.sequence(first, F.greatest(first, last))))


def join_intervals(
    left: DataFrame, right: DataFrame, on: list[str], left_bounds: tuple[str, str], right_bounds: tuple[str, str], width: float, kind: str = "overlaps",
) -> DataFrame:
    """Pairs of rows with equal ``on`` (columns of both) whose intervals overlap, or, for ``covers``, of which the left one holds all of the right
    one. Other columns need different names on both sides; ``width`` should be about the length of most intervals."""
    if kind not in ("overlaps", "covers"):
        raise ValueError(f"unknown kind of interval join: {kind!r}")
    (a, b), (c, d) = (tuple(F.col(x) for x in bounds) for bounds in (left_bounds, right_bounds))
    own, other = _binned(left, a, b, width), _binned(right, c, d, width).withColumnRenamed("__first", "__other")
    keys = [*on, "__bin"]
    counted = own.groupBy(*keys).agg(F.count("*").alias("__n"))
    limit = max(LEAST_HOT, left.count() // HOT_SHARE)
    hot = F.broadcast(counted.where(F.col("__n") > limit).select(*keys, F.ceil(F.col("__n") / limit).cast("int").alias("__parts")))
    parts = F.coalesce("__parts", F.lit(1))
    own = own.join(hot, keys, "left").withColumn("__part", F.floor(F.rand(1) * parts).cast("int")).drop("__parts")
    other = other.join(hot, keys, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("__parts")
    pairs = own.join(other, [*keys, "__part"]).where(F.col("__bin") == F.greatest("__first", "__other"))
    pairs = pairs.where((a <= c) & (b >= d)) if kind == "covers" else pairs.where((a < d) & (c < b))
    return pairs.drop("__bin", "__first", "__other", "__part")
