"""Group-wise statistics of receptive fields, keyed by whatever identifies a cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfloom.operators.tensors import argmax_first
from rfloom.tables import finite


def variance_map(pixels: DataFrame, keys: list[str]) -> DataFrame:
    return pixels.groupBy(*keys, "y", "x").agg(F.var_pop("v").alias("var"))


def rf_quality(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """quality = largest / median variance over time, centre = first pixel of the largest (x-major); quality null where the median is 0."""
    return variance_map(pixels, keys).groupBy(*keys).agg(
        (F.max("var") / F.nullif(F.median("var"), F.lit(0.0))).alias("quality"), argmax_first(F.col("var"), F.col("x"), F.col("y")).alias("centre")
    ).select(*keys, "quality", F.col("centre.x").alias("center_x"), F.col("centre.y").alias("center_y"))


def max_square_deviation(pixels: DataFrame, spikes: DataFrame, keys: list[str], count: str, level: float = 0.5) -> DataFrame:
    """Per pixel the largest (v / spikes - level)^2; cells without spikes have no rows."""
    rows = pixels.join(spikes.where(F.col(count) > 0), keys)
    deviation = F.col("v") / F.col(count) - level
    return rows.groupBy(*keys, "y", "x").agg(F.max(deviation * deviation).alias("rms"))


def weighted_positions(rows: DataFrame, keys: list[str], quality: str, threshold: float, floor: float = 1e-6) -> DataFrame:
    """Quality-weighted mean of x_um and y_um over channels; weights below the threshold become ``floor``."""
    weight = F.when(F.col(quality) >= threshold, F.col(quality)).otherwise(F.lit(floor))
    known = rows.where(finite(F.col(quality)) & F.col("x_um").isNotNull() & F.col("y_um").isNotNull()).withColumn("w", weight)
    return known.groupBy(*keys).agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in ("x_um", "y_um")], F.count("*").alias("channels"))


def covariance_with_reference(pixels: DataFrame, reference: DataFrame, keys: list[str], time: str) -> DataFrame:
    """covar_samp over time of every pixel with each cell's reference series (keys, time, r)."""
    return pixels.join(reference, [*keys, time]).groupBy(*keys, "y", "x").agg(F.covar_samp("v", "r").alias("cov"))


def covariance_row_sum(pixels: DataFrame, keys: list[str], time: str) -> DataFrame:
    """Sum over all other pixels q of cov(p, q), as cov(p, sum of all) - var(p): linear, not quadratic, in the pixels."""
    whole = pixels.groupBy(*keys, time).agg(F.sum("v").alias("all"))
    return pixels.join(whole, [*keys, time]).groupBy(*keys, "y", "x").agg((F.covar_samp("v", "all") - F.var_samp("v")).alias("total"))


def explode_mean(rows: DataFrame, keys: list[str], data: str) -> DataFrame:
    """Element-wise mean of arrays without NaN: keys, position, mean."""
    flat = rows.select(*keys, F.posexplode(data).alias("position", "v")).where(finite(F.col("v")))
    return flat.groupBy(*keys, "position").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def concat_groups(rows: DataFrame, keys: list[str], order: str, data: str) -> DataFrame:
    """The arrays of a group one after another, in the order of ``order``. Groups are channels of a cell: few."""
    parts = F.array_sort(F.collect_list(F.struct(order, data)))
    return rows.groupBy(*keys).agg(F.flatten(F.transform(parts, lambda p: p[data])).alias(data))


def histogram(values: DataFrame, column: str, width: float) -> DataFrame:
    return values.groupBy(F.floor(F.col(column) / width).alias("bin")).agg(F.count("*").alias("n"))


def quantile_split(rows: DataFrame, keys: list[str], value: str, low: float, high: float) -> DataFrame:
    """Each row marked 'low', 'high' or 'middle' by its group's exact quantiles."""
    limits = rows.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(low), F.lit(high))).alias("limits"))
    side = F.when(F.col(value) > F.col("limits")[1], "high").when(F.col(value) < F.col("limits")[0], "low").otherwise("middle")
    return rows.join(limits, keys).withColumn("side", side).drop("limits")


def polarity(value: Column) -> Column:
    """Aggregate: sign of the value with the largest magnitude (the larger value among equals)."""
    return F.sign(F.max_by(value, F.struct(F.abs(value), value)))


def triggered_average(snippets: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Weighted average of each pixel over snippets."""
    return snippets.groupBy(*keys, "y", "x").agg((F.sum(F.col(weight) * F.col("v")) / F.nullif(F.sum(weight), F.lit(0.0))).alias("sta"))


def signed_projection(snippets: DataFrame, average: DataFrame, keys: list[str], level: float) -> DataFrame:
    """Per snippet row sum of (s - level) * (sta - level) over pixels."""
    product = (F.col("v") - level) * (F.col("sta") - level)
    return snippets.join(average, [*keys, "y", "x"]).groupBy(*keys, "t").agg(F.sum(product).alias("projection"))


def zscored(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """z over each group: the group's moments are aggregated (map-side first) and joined back, so no group sits in one task."""
    moments = rows.groupBy(*keys).agg(F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sigma"))
    return rows.join(moments, keys).withColumn("z", (F.col(value) - F.col("_mean")) / F.nullif(F.col("_sigma"), F.lit(0.0))).drop("_mean", "_sigma")


def robust_scaled(rows: DataFrame, keys: list[str], value: str, normal_span: float = 1.3489795003921634) -> DataFrame:
    """(v - median) / (IQR / normal span); a constant feature is only centred."""
    q = rows.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"))
    span = F.coalesce(F.nullif((F.col("q")[2] - F.col("q")[0]) / normal_span, F.lit(0.0)), F.lit(1.0))
    return rows.join(q, keys).withColumn("scaled", (F.col(value) - F.col("q")[1]) / span).drop("q")


def best_per_group(rows: DataFrame, keys: list[str], score: str, item: str) -> DataFrame:
    """The item with the largest score (NaN doesn't count; the smaller item among equals)."""
    return rows.where(finite(F.col(score))).groupBy(*keys).agg(F.max(F.struct(F.col(score).alias("s"))).alias("top"), F.min(F.struct((-F.col(score)).alias("s"), F.col(item).alias("item"))).alias("first")).select(*keys, F.col("first.item").alias(item), F.col("top.s").alias(score))


def shared_by_all(rows: DataFrame, item: str, owner: str) -> DataFrame:
    """Items that every owner has (intersection over owners)."""
    owners = rows.agg(F.count_distinct(owner).alias("owners"))
    return rows.groupBy(item).agg(F.count_distinct(owner).alias("n")).join(F.broadcast(owners), F.col("n") == F.col("owners")).select(item)


def grey_levels(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Each row with ``g``: its value on 0..255 by its group's range (0 for a constant group)."""
    span = rows.groupBy(*keys).agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    level = F.floor((F.col(value) - F.col("_low")) / F.nullif(F.col("_high") - F.col("_low"), F.lit(0.0)) * 255 + 0.5)
    return rows.join(span, keys).withColumn("g", F.coalesce(level, F.lit(0)).cast("int")).drop("_low", "_high")


def otsu_cuts(rows: DataFrame, keys: list[str], level: str) -> DataFrame:
    """keys, cut: the level after which the variance between both sides is largest (the lowest among equals), from at most 256 counts a group."""
    counts = rows.groupBy(*keys, level).agg(F.count("*").alias("n"))
    below, whole = Window.partitionBy(*keys).orderBy(level), Window.partitionBy(*keys)
    moment = F.col("n") * F.col(level)
    sums = counts.select(*keys, level, *[F.sum(c).over(w).cast("double").alias(a) for a, c, w in (("w0", F.col("n"), below), ("s0", moment, below), ("w", F.col("n"), whole), ("s", moment, whole))])
    rest = F.nullif(F.col("w") - F.col("w0"), F.lit(0.0))
    gap = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / rest
    return sums.withColumn("between", F.coalesce(F.round(F.col("w0") * rest * gap * gap, 3), F.lit(0.0))).groupBy(*keys).agg(F.max_by(level, F.struct("between", -F.col(level))).alias("cut"))


def robust_z(rows: DataFrame, value: str) -> DataFrame:
    """Each row with ``z``: its deviation from the median of all rows in scaled median deviations (null if these are 0)."""
    middle = rows.agg(F.median(value).alias("_mid"))
    off = rows.join(F.broadcast(middle), F.col(value).isNotNull())
    spread = off.agg(F.median(F.abs(F.col(value) - F.col("_mid"))).alias("_mad"))
    return off.join(F.broadcast(spread), F.col(value).isNotNull()).withColumn("z", F.lit(0.6744897501960817) * (F.col(value) - F.col("_mid")) / F.nullif(F.col("_mad"), F.lit(0.0))).drop("_mid", "_mad")
