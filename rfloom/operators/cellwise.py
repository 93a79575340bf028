"""Whole-image kernels on the tensor rows of a batch: Arrow batches in, Arrow batches out, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from rfloom.operators import kernels


#: Values of images that a kernel gets at a time.
_VALUES = 1 << 22


def _per_image(kernel: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> Callable[[Column], Column]:
    """A pandas UDF applying ``kernel`` to stacks of arrays of the given shape; null where the array is null, ragged or not finite."""
    size = int(np.prod(shape))

    @F.pandas_udf("array<double>")
    def run(images: pd.Series) -> pd.Series:
        found = np.full(len(images), None, object)
        fits = np.nonzero([image is not None and len(image) == size for image in images])[0]
        for start in range(0, len(fits), max(1, _VALUES // size)):
            own = fits[start : start + max(1, _VALUES // size)]
            stack = np.stack([np.asarray(images.iloc[i], float) for i in own])
            good = np.isfinite(stack).all(1)
            if good.any():
                results = kernel(stack[good].reshape(-1, *shape))
                for i, row in zip(own[good], results.reshape(len(results), -1)):
                    found[i] = row
        return pd.Series(found)

    return run


def smoothed(data: Column, shape: tuple[int, ...], sigma: float = 5.0, axes: tuple[int, ...] | None = None) -> Column:
    """Every array smoothed (along some of its axes), with its own median outside."""
    along = tuple(a + 1 for a in (range(len(shape)) if axes is None else axes))
    each = tuple(range(1, len(shape) + 1))
    return _per_image(lambda cubes: kernels.smoothed(cubes, sigma, along, fill=np.median(cubes, axis=each, keepdims=True)), shape)(data)


def smoothed_about(data: Column, shape: tuple[int, ...], sigma: float) -> Column:
    """Smoothed deviations: zero lies outside."""
    along = tuple(range(1, len(shape) + 1))
    return _per_image(lambda images: kernels.smoothed(images, sigma, along, fill=0.0), shape)(data)


def polar(data: Column, shape: tuple[int, int], radii: int, angles: int = 360) -> Column:
    return _per_image(lambda images: kernels.polar_map(images, radii, angles), shape)(data)


def outline_curves(data: Column, shape: tuple[int, int], radii: int, degree_bins: int = 10) -> Column:
    """Centre, surround and in-out curves one after another."""
    return _per_image(lambda images: np.concatenate(kernels.outlines(images, radii, degree_bins), axis=-1), shape)(data)


def decimated(data: Column, shape: tuple[int, ...], factor: int) -> Column:
    return _per_image(lambda images: kernels.fir_decimated(images, factor), shape)(data)


def decimated_both(data: Column, shape: tuple[int, int], factor: int, trim: int) -> Column:
    """Thinned along the first axis, then along the second; ``trim`` thinned pixels are cut off on each side."""

    def both(images: np.ndarray) -> np.ndarray:
        down = np.swapaxes(kernels.fir_decimated(np.swapaxes(images, -1, -2), factor), -1, -2)
        thin = kernels.fir_decimated(down, factor)
        return thin[..., trim : thin.shape[-2] - trim, trim : thin.shape[-1] - trim]

    return _per_image(both, shape)(data)


def band_passed(data: Column, low: float, high: float, rate: Column) -> Column:
    """Zero-phase band-pass of each row's series at its own sampling rate, whatever its length; null where it can't be."""

    @F.pandas_udf("array<double>")
    def run(series: pd.Series, rates: pd.Series) -> pd.Series:
        def one(values: np.ndarray | None, hertz: float) -> list[float] | None:
            if values is None or len(values) < 8 or not np.isfinite(np.asarray(values, float)).all() or not hertz > 0:
                return None
            return kernels.band_passed(np.asarray(values, float), low, high, hertz).tolist()

        return pd.Series([one(v, r) for v, r in zip(series, rates)], dtype=object)

    return run(data, rate)


def envelope(data: Column) -> Column:
    """Magnitude of the analytic signal of each row's series."""

    @F.pandas_udf("array<double>")
    def run(series: pd.Series) -> pd.Series:
        return series.map(lambda v: None if v is None or not len(v) or not np.isfinite(np.asarray(v, float)).all() else np.abs(kernels.analytic(np.asarray(v, float))).tolist())

    return run(data)


def spectrum(data: Column, shape: tuple[int, int]) -> Column:
    """log(1 + magnitude) of the centred 2-D Fourier transform."""
    return _per_image(lambda images: np.log1p(np.abs(np.fft.fftshift(np.fft.fft2(images), axes=(-2, -1)))), shape)(data)


def bridged(data: Column, at: Column | None = None) -> Column:
    """Each row's series with its holes interpolated: over the times ``at``, ends held, or without them around the circle; null without a finite value."""

    def one(values: np.ndarray | None, times: np.ndarray | None = None) -> list[float] | None:
        if values is None or not len(values):
            return None
        y = np.array([np.nan if v is None else v for v in values], float)
        known, around = np.isfinite(y), times is None
        x = np.arange(len(y)) if around else np.array([np.nan if t is None else t for t in times], float)
        if not known.any() or len(x) != len(y) or not np.isfinite(x).all():
            return None
        return np.where(known, y, np.interp(x, x[known], y[known], period=len(y) if around else None)).tolist()

    @F.pandas_udf("array<double>")
    def around(series: pd.Series) -> pd.Series:
        return pd.Series([one(v) for v in series], dtype=object)

    @F.pandas_udf("array<double>")
    def along(series: pd.Series, times: pd.Series) -> pd.Series:
        return pd.Series([one(v, t if t is not None else []) for v, t in zip(series, times)], dtype=object)

    doubles = F.transform(data, lambda v: v.cast("double"))
    return around(doubles) if at is None else along(doubles, at)


def shift_between(left: Column, right: Column) -> Column:
    """struct(dy, dx, score) of the offset at which two maps, arrays of (y, x, v), correlate best."""

    def one(a: list, b: list) -> dict:
        sides = [np.array([(p["y"], p["x"], p["v"]) for p in side], float) for side in (a, b)]
        places, values = [s[:, :2].astype(int) for s in sides], [s[:, 2] for s in sides]
        return kernels.best_offset(*places, *values)

    @F.pandas_udf("struct<dy:int,dx:int,score:double>")
    def run(first: pd.Series, second: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(a, b) for a, b in zip(first, second)], columns=["dy", "dx", "score"])

    return run(left, right)
