"""Joins of points with time windows of the same aircraft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000


def points_within(windows: DataFrame, points: DataFrame, w0: Column, w1: Column, columns: list[str], bucket: int = DAY) -> DataFrame:
    """Each window with the points of its aircraft in [w0, w1).

    Windows are dealt into the time buckets that they touch and points into their own, so that aircraft and
    bucket are equal in the join: no aircraft has to be gathered whole, and windows far apart never meet.
    A null bound or time matches nothing.
    """
    left = windows.withColumn("__w0", w0).withColumn("__w1", w1).where("__w1 > __w0")
    left = left.withColumn("__cell", F.explode(F.sequence(F.floor(F.col("__w0") / bucket), F.floor((F.col("__w1") - 1) / bucket))))
    right = points.select("icao24", *columns, F.floor(F.col("t") / bucket).alias("__cell"))
    return left.join(right, ["icao24", "__cell"]).where("t >= __w0 AND t < __w1").drop("__cell", "__w0", "__w1")
