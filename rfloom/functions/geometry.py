"""Geometry of receptive fields as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from rfloom.functions.arrays import let, rounded, total


def px_to_um(px: Column, size: Column, pixel: Column) -> Column:
    return (px - size / 2) * pixel


def um_to_px(um: Column, size: Column, pixel: Column) -> Column:
    """Truncated to whole pixels; only the half size is rounded (half to even).

    A position less than a millionth of a pixel below a whole one counts as
    whole: it differs from it only by the order in which its mean was summed.
    """
    return rounded(um / pixel + F.bround(size / 2)).cast("int")


def cut_px(cut_um: Column, pixel: Column) -> Column:
    return F.bround(cut_um / pixel).cast("int")


def clamp_centre(centre: Column, half: Column, extent: Column) -> Column:
    return F.least(extent - half, F.greatest(half, centre.cast("int")))


def polar(x: Column, y: Column) -> tuple[Column, Column]:
    """(degrees in [0, 360), distance)."""
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0)), F.hypot(x, y)


def radial_area(radii: Column) -> Column:
    """Polygon area of radii at even angles; null below three."""
    n = F.size(radii)
    turned = F.concat(F.slice(radii, F.lit(2), n - 1), F.slice(radii, F.lit(1), F.lit(1)))
    products = F.zip_with(radii, turned, lambda a, b: a * b)
    return F.when(n >= 3, F.lit(0.5) * F.sin(F.lit(2 * math.pi) / n) * total(products))


def vertices(radii: Column) -> Column:
    """array<struct<x, y>> of radii at even angles."""
    step = F.lit(2 * math.pi) / F.size(radii)
    return F.transform(radii, lambda r, i: F.struct((r * F.cos(i * step)).alias("x"), (r * F.sin(i * step)).alias("y")))


def closed(values: Column) -> Column:
    """The polygon's values with the first repeated at the end."""
    return F.concat(values, F.slice(values, F.lit(1), F.lit(1)))


#: Centred sums of a polygon's points: powers of x and y.
_POWERS = {"suu": (2, 0), "svv": (0, 2), "suv": (1, 1), "suuu": (3, 0), "svvv": (0, 3), "suvv": (1, 2), "svuu": (2, 1)}


def moments(points: Column) -> Column:
    """struct of n, mx, my and the centred sums suu, svv, suv, suuu, svvv, suvv, svuu: the means first, then the sums about them."""
    start = F.struct(*[F.lit(0.0).alias(k) for k in _POWERS])

    def product(u: Column, v: Column, a: int, b: int) -> Column:
        value = F.lit(1.0)
        for factor in [u] * a + [v] * b:
            value = value * factor
        return value

    def centred(c: Column) -> Column:
        def add(s: Column, p: Column) -> Column:
            u, v = p["x"] - c["mx"], p["y"] - c["my"]
            return F.struct(*[(s[k] + product(u, v, a, b)).alias(k) for k, (a, b) in _POWERS.items()])

        return let(lambda t: F.struct(c["n"].alias("n"), c["mx"].alias("mx"), c["my"].alias("my"), *[t["s"][k].alias(k) for k in _POWERS]), s=F.aggregate(c["p"], start, add))

    n = F.nullif(F.size(points), F.lit(0))
    return let(centred, p=points, n=n, mx=total(F.transform(points, lambda p: p["x"])) / n, my=total(F.transform(points, lambda p: p["y"])) / n)


def circle_fit(m: Column) -> Column:
    """struct(xc, yc, radius): algebraic least squares from ``moments``; null for points on a line."""
    det = F.nullif(m["suu"] * m["svv"] - m["suv"] * m["suv"], F.lit(0.0))
    a, b = (m["suuu"] + m["suvv"]) / 2, (m["svvv"] + m["svuu"]) / 2
    uc, vc = (a * m["svv"] - b * m["suv"]) / det, (b * m["suu"] - a * m["suv"]) / det
    return F.struct((uc + m["mx"]).alias("xc"), (vc + m["my"]).alias("yc"), F.sqrt(uc * uc + vc * vc + (m["suu"] + m["svv"]) / m["n"]).alias("radius"))


def tir(points: Column, circle: Column) -> Column:
    """Largest minus smallest distance of the points from the circle's centre."""
    far = let(lambda s: F.transform(s["p"], lambda p: F.hypot(p["x"] - s["c"]["xc"], p["y"] - s["c"]["yc"])), p=points, c=circle)
    return F.array_max(far) - F.array_min(far)


def tilt(m: Column) -> Column:
    """Minor over major axis from the covariance of the points."""
    half, root = (m["suu"] + m["svv"]) / 2, F.sqrt((m["suu"] - m["svv"]) * (m["suu"] - m["svv"]) / 4 + m["suv"] * m["suv"])
    return F.sqrt(F.greatest(half - root, F.lit(0.0)) / F.nullif(half + root, F.lit(0.0)))


def axis_angle(m: Column) -> Column:
    """Angle of the major axis, degrees in [0, 180)."""
    return F.pmod(F.degrees(F.atan2(2 * m["suv"], m["suu"] - m["svv"]) / 2) + 180, F.lit(180.0))
