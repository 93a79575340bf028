"""Distances between the contours of small groups (the channels of one cell): computed inside one row per pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfloom.functions.arrays import let, mean


def nearest(points: Column, to: Column) -> Column:
    """Distance of each point to the nearest of the others."""
    return F.transform(points, lambda p: F.array_min(F.transform(to, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"]))))


def distances(rows: DataFrame, group: list[str], identity: str, points: str) -> DataFrame:
    """a, b (a < b), hausdorff, mean_symmetric of the contours of a group.

    ``group`` must name few contours (channels of a cell): their pairs are the answer. The points of
    a pair are compared inside its row, so no pair of points is ever a row. Null group keys match nothing.
    """
    side = lambda name: rows.select(*group, F.col(identity).alias(name), F.col(points).alias(f"points_{name}"))
    both = side("a").join(side("b"), group).where("a < b")
    near = both.select("a", "b", nearest(F.col("points_a"), F.col("points_b")).alias("there"), nearest(F.col("points_b"), F.col("points_a")).alias("back"))
    return near.select("a", "b", F.greatest(F.array_max("there"), F.array_max("back")).alias("hausdorff"), let(lambda s: (s["t"] + s["b"]) / 2, t=mean(F.col("there")), b=mean(F.col("back"))).alias("mean_symmetric"))
