import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfloom.functions import arrays as A
from rfloom.functions import geometry as G
from rfloom.operators import kernels as K


def one(spark, column, **arrays):
    row = spark.createDataFrame([tuple(arrays.values())], ", ".join(f"{k} array<double>" for k in arrays))
    return row.select(column.alias("x")).first()["x"]


def ellipse(a, b, turn, n=360):
    t = np.radians(np.arange(n) * 360 / n) - np.radians(turn)
    return (a * b / np.hypot(b * np.cos(t), a * np.sin(t))).tolist()


def test_circle(spark):
    r = [3.0] * 36
    assert one(spark, G.radial_area(F.col("r")), r=r) == pytest.approx(18 * 9 * math.sin(math.radians(10)))
    points = G.vertices(F.col("r"))
    circle = G.circle_fit(G.moments(points))
    got = one(spark, F.struct(circle["xc"], circle["yc"], circle["radius"], G.tir(points, circle), G.tilt(G.moments(points))), r=r)
    assert np.allclose(list(got), [0, 0, 3, 0, 1], atol=1e-9)


def test_shifted_circle_and_ellipse(spark):
    n, dx = 72, 0.5
    t = np.radians(np.arange(n) * 360 / n)
    r = (dx * np.cos(t) + np.sqrt(4 - (dx * np.sin(t)) ** 2)).tolist()
    circle = G.circle_fit(G.moments(G.vertices(F.col("r"))))
    assert np.allclose(list(one(spark, F.struct(circle["xc"], circle["yc"], circle["radius"]), r=r)), [dx, 0, 2], atol=1e-9)
    assert one(spark, G.axis_angle(G.moments(G.vertices(F.col("r")))), r=ellipse(4, 2, 30)) == pytest.approx(30, abs=1e-6)


def test_short_and_degenerate(spark):
    assert one(spark, G.radial_area(F.col("r")), r=[1.0, 2.0]) is None
    assert one(spark, G.circle_fit(G.moments(G.vertices(F.col("r"))))["xc"], r=[0.0, 0.0, 0.0]) is None
    assert one(spark, A.zscore(F.col("r")), r=[2.0, 2.0]) == [None, None]
    assert one(spark, A.minmax_bytes(F.col("r")), r=[2.0, 2.0]) == [0, 0]
    assert one(spark, A.mean(F.col("r")), r=[]) is None


def test_scaling(spark):
    v = np.random.default_rng(1).normal(size=50)
    assert np.allclose(one(spark, A.zscore(F.col("v")), v=v.tolist()), (v - v.mean()) / v.std())
    assert np.allclose(one(spark, A.tail_zscore(F.col("v")), v=v.tolist()), (v - v.mean()) / v[-30:].std())
    t = np.arange(50) - 25.0
    after = v[t > 0]
    assert np.allclose(one(spark, A.noise_zscore(F.col("v"), F.col("t")), v=v.tolist(), t=t.tolist()), (v - after.mean()) / after.std(ddof=1))


def test_resampling(spark):
    x, y, p = [0.0, 1.0, 3.0], [0.0, 10.0, 30.0], [-1.0, 0.0, 0.5, 2.0, 3.0, 4.0]
    assert one(spark, A.resampled(F.col("x"), F.col("y"), F.col("p")), x=x, y=y, p=p) == [0.0, 0.0, 5.0, 20.0, 30.0, 0.0]


def test_smoothing_and_polar():
    cube = np.zeros((60, 9, 9))
    cube[30, 4, 4] = 1.0
    s = K.smoothed(cube, 1.0)
    assert s.sum() == pytest.approx(1.0, abs=1e-3) and np.unravel_index(s.argmax(), s.shape) == (30, 4, 4)
    assert np.allclose(K.smoothed(np.full((5, 4, 3), 7.0)), 7.0)
    y, x = np.mgrid[0:41, 0:41] - 20
    bump = np.exp(-(y**2 + x**2) / 50.0)
    centre, surround, in_out = K.outlines(bump, 20)
    assert np.ptp(centre) < 0.05 and (surround == 0).all() and (np.diff(in_out) <= 1e-9).all()
    assert K.polar_map(np.arange(25.0).reshape(5, 5), 3)[0].tolist() == [12.0, 13.0, 14.0]


def test_filters():
    t = np.arange(1000) / 1000
    mixed = np.sin(2 * np.pi * 20 * t) + np.sin(2 * np.pi * 200 * t)
    assert np.abs(K.band_passed(mixed, 10, 40, 1000) - np.sin(2 * np.pi * 20 * t))[250:-250].max() < 0.02
    assert np.allclose(np.abs(K.analytic(np.cos(2 * np.pi * 8 * t))), 1, atol=1e-6)
    assert np.allclose(K.fir_decimated(np.full((2, 50), 3.0), 5), 3.0) and K.fir_decimated(np.zeros((2, 50)), 5).shape == (2, 10)
