"""Column functions on arrays: they run inside one row, so they never shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rounded(x: Column, digits: int = 6) -> Column:
    """Half up, with the halves themselves safe from the last bit of a sum (see ``sql_rounded``)."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.500001)) / F.lit(scale)


def sql_rounded(x: str, digits: int = 6) -> str:
    return f"(floor(({x}) * 1e{digits} + 0.500001) / 1e{digits} + 0.0)"


def clean(values: Column) -> Column:
    """The array's finite values."""
    return F.filter(values, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def mean(values: Column) -> Column:
    return total(values) / F.nullif(F.size(values), F.lit(0))


def let(body, **values: Column) -> Column:
    """body(struct of the values), each evaluated once per row; inside a lambda they would be evaluated per element."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), body)[0]


def variance(values: Column, ddof: int = 0) -> Column:
    return let(
        lambda s: F.aggregate(s["a"], F.lit(0.0), lambda t, v: t + (v - s["m"]) * (v - s["m"])) / F.nullif(F.size(s["a"]) - ddof, F.lit(0)),
        a=values, m=mean(values),
    )


def _scaled(values: Column, centre: Column, sigma: Column) -> Column:
    return let(lambda s: F.transform(s["a"], lambda v: (v - s["c"]) / s["d"]), a=values, c=centre, d=sigma)


def zscore(values: Column, ddof: int = 0) -> Column:
    """(v - mean) / sigma; null entries if sigma is 0."""
    return _scaled(values, mean(values), F.nullif(F.sqrt(variance(values, ddof)), F.lit(0.0)))


def tail_zscore(values: Column, trailing: int = 30) -> Column:
    """Mean over all, sigma over the last values; sigma 0 counts as 1."""
    n = F.least(F.lit(trailing), F.size(values))
    sigma = F.coalesce(F.nullif(F.sqrt(variance(F.slice(values, F.size(values) - n + 1, n))), F.lit(0.0)), F.lit(1.0))
    return _scaled(values, mean(values), sigma)


def noise_zscore(values: Column, times: Column) -> Column:
    """Mean and sigma (ddof 1) of the values at positive times, applied to all."""
    after = F.transform(F.filter(F.arrays_zip(times.alias("t"), values.alias("v")), lambda p: p["t"] > 0), lambda p: p["v"].cast("double"))
    return _scaled(F.transform(values, lambda v: v.cast("double")), mean(after), F.nullif(F.sqrt(variance(after, 1)), F.lit(0.0)))


def row_max_normalised(values: Column) -> Column:
    return _scaled(values, F.lit(0.0), F.nullif(F.array_max(F.transform(values, F.abs)), F.lit(0.0)))


def minmax_bytes(values: Column) -> Column:
    """0..255 by the row's range; a constant row gives zeros."""
    grey = lambda s: F.transform(s["a"], lambda v: F.coalesce(F.floor((v - s["low"]) / s["span"] * 255 + 0.5), F.lit(0)).cast("smallint"))
    return let(grey, a=values, low=F.array_min(values), span=F.nullif(F.array_max(values) - F.array_min(values), F.lit(0.0)))


def l2_normalised(values: Column) -> Column:
    return _scaled(values, F.lit(0.0), F.nullif(F.sqrt(F.aggregate(values, F.lit(0.0), lambda s, v: s + v * v)), F.lit(0.0)))


def first_argmax(values: Column) -> Column:
    """0-based position of the first largest value."""
    return F.array_position(values, F.array_max(values)) - 1


def below_to_zero(values: Column, share: float) -> Column:
    """Values normalised by the maximum; those below ``share`` of it become 0."""
    scaled = _scaled(values, F.lit(0.0), F.nullif(F.array_max(values), F.lit(0.0)))
    return F.transform(scaled, lambda v: F.when(v < share, F.lit(0.0)).otherwise(v))


def resampled(x: Column, y: Column, points: Column, outside: float = 0.0) -> Column:
    """Linear interpolation of sorted points at ``points``; ``outside`` beyond the ends."""
    pairs = F.arrays_zip(x.alias("x"), y.alias("y"))
    steps = let(
        lambda s: F.zip_with(s["p"], F.slice(s["p"], F.lit(2), F.greatest(F.size(s["p"]) - 1, F.lit(0))), lambda a, b: F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"))),
        p=pairs,
    )

    def at(s: Column, p: Column) -> Column:
        hit = F.get(F.filter(s["steps"], lambda q: (q["x0"] <= p) & (p <= q["x1"]) & (q["x1"] > q["x0"])), F.lit(0))
        return let(lambda h: F.coalesce(h["h"]["y0"] + (h["h"]["y1"] - h["h"]["y0"]) * (p - h["h"]["x0"]) / (h["h"]["x1"] - h["h"]["x0"]), F.lit(outside)), h=hit)

    return let(lambda s: F.transform(s["points"], lambda p: at(s, p)), steps=steps, points=points)


def grid(start: Column, step: Column, count: int) -> Column:
    """start, start + step, ...: ``count`` points."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: start + i * step)


def time_axis(count: Column, dt: Column, zero: Column) -> Column:
    """(i - zero) * dt for i in 0..count-1."""
    return F.transform(F.sequence(F.lit(0), count - 1), lambda i: (i - zero) * dt)
