"""Gaussian smoothing of image stacks over space and time, with the stack's median outside.

Space is smoothed inside each image's row; time by a window over each pixel's
series, so no stack has to fit into a task. The median is exact: one buffer of
a stack's values per key while it is aggregated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfloom.operators import cellwise, kernels


def _over_time(value: str, keys: list[str], time: str, sigma: float) -> Column:
    series = Window.partitionBy(*keys).orderBy(time)
    weights = kernels.gaussian_weights(sigma)
    radius = len(weights) // 2
    moved = lambda k: F.lead(value, -k) if k < 0 else F.lag(value, k)
    total = F.lit(0.0)
    for k, w in zip(range(-radius, radius + 1), weights.tolist()):
        total = total + F.lit(w) * F.coalesce(moved(k).over(series), F.lit(0.0))
    return total


def smoothed_stack(images: DataFrame, keys: list[str], time: str, data: str, shape: tuple[int, int], sigma: float) -> DataFrame:
    """keys, time, i, y, x, v of the stacks made of ``images`` (keys, time, data)."""
    fills = images.select(*keys, F.explode(data).alias("v")).groupBy(*keys).agg(F.median("v").alias("fill"))
    centred = images.join(fills, keys).select(*keys, time, "fill", F.transform(data, lambda v: v - F.col("fill")).alias("d"))
    flat = centred.select(*keys, time, "fill", F.posexplode(cellwise.smoothed_about(F.col("d"), shape, sigma)).alias("i", "d"))
    long = flat.withColumn("d", _over_time("d", [*keys, "i"], time, sigma))
    return long.select(*keys, time, "i", F.floor(F.col("i") / shape[1]).cast("int").alias("y"), (F.col("i") % shape[1]).alias("x"), (F.col("d") + F.col("fill")).alias("v"))
