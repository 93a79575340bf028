"""Image stacks as tensor rows and as long rows (keys, t, y, x, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def long_view(rows: DataFrame, keys: list[str], data: str, width: int) -> DataFrame:
    """One row per pixel: keys, i, y, x, v."""
    flat = rows.select(*keys, F.posexplode(data).alias("i", "v"))
    return flat.select(*keys, "i", F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).alias("x"), F.col("v").cast("double").alias("v"))


def cube_view(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Tensor rows with ``shape`` (T, H, W), ``data``, ``t0``, ``dt_ms`` as keys, t, time_ms, y, x, v."""
    h, w = F.col("shape")[1], F.col("shape")[2]
    flat = rows.select(*keys, "shape", "t0", "dt_ms", F.posexplode("data").alias("i", "v"))
    t = F.floor(F.col("i") / (h * w)).cast("int")
    return flat.select(*keys, t.alias("t"), ((t - F.col("t0")) * F.col("dt_ms")).alias("time_ms"), F.floor(F.col("i") / w).cast("int").alias("yy"), (F.col("i") % w).alias("x"), h.alias("h"), F.col("v").cast("double").alias("v")).withColumn("y", F.col("yy") % F.col("h")).drop("yy", "h")


def in_square(x: Column, y: Column, centre: tuple[int, int], size: tuple[int, int], extent: tuple[int, int] | None = None) -> Column:
    """Rectangular mask, clamped at the near edge; with ``extent`` it is shifted to keep its size at the far edge."""
    found = F.lit(True)
    for axis, (value, middle, length) in enumerate(zip((x, y), centre, size)):
        low = max(middle - length // 2, 0)
        if extent is not None:
            low = max(min(low, extent[axis] - length), 0)
        found = found & (value >= low) & (value < low + length)
    return found


def in_circle(x: Column, y: Column, centre: tuple[int, int], radius: float) -> Column:
    return F.hypot(x - centre[0], y - centre[1]) <= radius


def bounding_boxes(pixels: DataFrame, keys: list[str], keep: Column, inset: int = 0) -> DataFrame:
    box = pixels.where(keep).groupBy(*keys)
    return box.agg(*[f(c).alias(f"{c}_{n}") for c in ("x", "y") for n, f in (("min", F.min), ("max", F.max))]).select(
        *keys, *[(F.col(f"{c}_min") + inset).alias(f"{c}_min") for c in ("x", "y")], *[(F.col(f"{c}_max") - inset).alias(f"{c}_max") for c in ("x", "y")]
    )


def cropped(pixels: DataFrame, keys: list[str], keep: Column) -> DataFrame:
    """Pixels inside the bounding box of those to keep; a map without any gives no rows."""
    boxes = bounding_boxes(pixels, keys, keep)
    return pixels.join(boxes, keys).where("x between x_min and x_max and y between y_min and y_max").select(pixels.columns)


def border_is_clear(pixels: DataFrame, keys: list[str], on: Column, height: int, width: int) -> DataFrame:
    edge = F.col("y").isin(0, height - 1) | F.col("x").isin(0, width - 1)
    return pixels.groupBy(*keys).agg((~F.coalesce(F.bool_or(on & edge), F.lit(False))).alias("clear"))


def argmax_first(value: Column, *position: Column) -> Column:
    """Aggregate: the position (struct) of the largest value, the first one among equals."""
    return F.max_by(F.struct(*position), F.struct(value, *[-p for p in position]))


def padded(pixels: DataFrame, keys: list[str], height: int, width: int, border: int) -> DataFrame:
    """Each map extended by ``border`` pixels of its own median."""
    maps = pixels.groupBy(*keys).agg(F.median("v").alias("fill"))
    side = lambda n: F.explode(F.sequence(F.lit(-border), F.lit(n - 1 + border)))
    frame = maps.withColumn("y", side(height)).withColumn("x", side(width))
    frame = frame.where(~(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)))
    return pixels.select(*keys, "y", "x", "v").unionByName(frame.select(*keys, "y", "x", F.col("fill").alias("v")))


def padded_axes(pixels: DataFrame, keys: list[str], height: int, width: int, border: int) -> DataFrame:
    """Each map extended by ``border`` pixels: first every column by its median, then every row of that by its own."""
    rows = pixels.select(*keys, "y", "x", "v")
    for axis, other, size in (("y", "x", height), ("x", "y", width)):
        outside = F.explode(F.array(*[F.lit(i) for i in (*range(-border, 0), *range(size, size + border))]))
        edge = rows.groupBy(*keys, other).agg(F.median("v").alias("v")).withColumn(axis, outside)
        rows = rows.unionByName(edge.select(*keys, "y", "x", "v"))
    return rows


def framed(pixels: DataFrame, keys: list[str], height: int, width: int, value: str, fill: float = 0.0) -> DataFrame:
    """keys, y, x, value on a whole frame; ``fill`` where the map has no pixel."""
    side = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    frame = pixels.select(*keys).distinct().withColumn("y", side(height)).withColumn("x", side(width))
    return frame.join(pixels.select(*keys, "y", "x", value), [*keys, "y", "x"], "left").withColumn(value, F.coalesce(value, F.lit(fill)))


def windowed(pixels: DataFrame, centres: DataFrame, keys: list[str], half: int) -> DataFrame:
    """The pixels at most ``half`` from each key's centre (keys, center_y, center_x), moved so that the window begins at 0."""
    near = pixels.join(centres, keys).where(f"abs(y - center_y) <= {half} and abs(x - center_x) <= {half}")
    return near.withColumns({"y": F.col("y") - F.col("center_y") + half, "x": F.col("x") - F.col("center_x") + half}).select(pixels.columns)


def shifted(pixels: DataFrame, dy: int, dx: int) -> DataFrame:
    return pixels.withColumns({"y": F.col("y") + dy, "x": F.col("x") + dx})
