"""Pairwise and neighbourhood operators between small, bounded sides (pixels of one map, contours of one cell)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rfloom.functions.arrays import mean
from rfloom.operators import cellwise, contours


def node_signs(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Sign of the summed weights at each node, edges counted at both ends."""
    ends = edges.select(*keys, F.col("p").alias("node"), "weight").unionByName(edges.select(*keys, F.col("q").alias("node"), "weight"))
    return ends.groupBy(*keys, "node").agg(F.sign(F.sum("weight")).alias("sign"), F.count("*").alias("degree"))


def hausdorff(points: DataFrame, keys: list[str], side: str, one: str, other: str) -> DataFrame:
    """Per map: directed Hausdorff distances between two sets of its points (keys, side, x, y), their maximum and the mean of both mean distances.

    The points of a map stand in its row as two arrays and are compared there; no pair of points is a row.
    """
    of = lambda name: F.collect_list(F.when(F.col(side) == name, F.struct(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))))
    both = points.groupBy(*keys).agg(of(one).alias("a"), of(other).alias("b")).where((F.size("a") > 0) & (F.size("b") > 0))
    near = both.select(*keys, contours.nearest(F.col("a"), F.col("b")).alias("there"), contours.nearest(F.col("b"), F.col("a")).alias("back"))
    return near.select(*keys, F.array_max("there").alias("there"), F.array_max("back").alias("back"), F.greatest(F.array_max("there"), F.array_max("back")).alias("hausdorff"), ((mean(F.col("there")) + mean(F.col("back"))) / 2).alias("mean_nearest"))


def cosine_distances(vectors: DataFrame, identity: str, data: str, blocks: int = 16) -> DataFrame:
    """a, b, distance: 1 - cosine of all pairs a < b, each once (null for a vector of zeros).

    The answer is a matrix of all rows, so it is quadratic in them; rows are put
    into blocks by hash and each pair of blocks is joined by its own key, so
    that the pairs spread over ``blocks`` squared groups.
    """
    length = F.sqrt(F.aggregate(data, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    unit = vectors.select(identity, F.transform(data, lambda v: v.cast("double") / F.nullif(length, F.lit(0.0))).alias("u"), F.pmod(F.xxhash64(identity), F.lit(blocks)).alias("block"))
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint")))
    left = unit.select(F.col(identity).alias("a"), F.col("u").alias("ua"), F.col("block").cast("bigint").alias("block_a"), every.alias("block_b"))
    right = unit.select(F.col(identity).alias("b"), F.col("u").alias("ub"), F.col("block").cast("bigint").alias("block_b"), every.alias("block_a"))
    dot = F.aggregate(F.zip_with("ua", "ub", lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return left.join(right, ["block_a", "block_b"]).where("a < b").select("a", "b", (1 - dot).alias("distance"))


def argmin_match(rows: DataFrame, groups: list[str], item: str, distance: Callable[[Column, Column], Column], value: str) -> DataFrame:
    """groups, item, closest, distance: the other item of its (small) group that each is nearest to; the smaller one among equals."""
    others = rows.select(*groups, F.col(item).alias("_other"), F.col(value).alias("_value"))
    near = rows.join(others, groups).where(F.col(item) != F.col("_other")).withColumn("_d", distance(F.col(value), F.col("_value")))
    best = near.groupBy(*groups, item).agg(F.min(F.struct("_d", "_other")).alias("_best"))
    return best.select(*groups, item, F.col("_best._other").alias("closest"), F.col("_best._d").alias("distance"))


def best_shift(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Offset (dy, dx) with the largest cross-correlation of two maps (y, x, v); the smallest offset among equals.

    A map is an array in one row, both maps of a key meet there and are correlated by Fourier transforms.
    """
    pixel = F.struct("y", "x", "v")
    one, other = (rows.groupBy(*keys).agg(F.collect_list(pixel).alias(name)) for rows, name in ((left, "a"), (right, "b")))
    return one.join(other, keys).select(*keys, cellwise.shift_between(F.col("a"), F.col("b")).alias("top")).select(*keys, "top.*")


def neighbours(pixels: DataFrame, keys: list[str], ring: int = 1) -> DataFrame:
    """Each pixel with those at most ``ring`` away in its map (itself left out)."""
    offset = F.explode(F.sequence(F.lit(-ring), F.lit(ring)))
    moved = pixels.select(*keys, "y", "x").withColumn("dy", offset).withColumn("dx", offset).where("dy <> 0 or dx <> 0")
    near = moved.select(*keys, "y", "x", (F.col("y") + F.col("dy")).alias("ny"), (F.col("x") + F.col("dx")).alias("nx"))
    return near.join(pixels.select(*keys, F.col("y").alias("ny"), F.col("x").alias("nx"), F.col("v").alias("nv")), [*keys, "ny", "nx"])


def drop_singled(pixels: DataFrame, keys: list[str], share: float, rounds: int = 1) -> DataFrame:
    """Removes pixels of which fewer than ``share`` of the eight neighbours are left, ``rounds`` times."""
    for _ in range(rounds):
        counts = neighbours(pixels, keys).groupBy(*keys, "y", "x").agg(F.count("*").alias("n"))
        pixels = pixels.join(counts.where(F.col("n") >= share * 8).drop("n"), [*keys, "y", "x"], "left_semi")
    return pixels
