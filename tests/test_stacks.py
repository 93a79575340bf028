import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfloom.operators import contours, graph, kernels, pairs, smoothing, tensors
from rfloom.operators import statistics as S


def images(spark, stack, label=0):
    rows = [(label, t, image.ravel().tolist()) for t, image in enumerate(stack)]
    return spark.createDataFrame(rows, "label int, vec_id int, a array<double>")


def cube_of(rows, shape):
    cube = np.full(shape, np.nan)
    for r in rows:
        cube[r["vec_id"], r["y"], r["x"]] = r["v"]
    return cube


def test_a_stack_spread_over_rows_is_smoothed_like_one_cube(spark):
    cubes = np.random.default_rng(1).normal(size=(2, 12, 4, 5))
    rows = images(spark, cubes[0]).unionByName(images(spark, cubes[1], 1))
    got = smoothing.smoothed_stack(rows, ["label"], "vec_id", "a", (4, 5), 1.0).collect()
    for label in (0, 1):
        assert np.allclose(cube_of([r for r in got if r["label"] == label], (12, 4, 5)), kernels.smoothed(cubes[label], 1.0))
    assert smoothing.smoothed_stack(rows.limit(0), ["label"], "vec_id", "a", (4, 5), 1.0).count() == 0


def test_padding_by_axes_is_that_of_numpy(spark):
    image = np.random.default_rng(2).normal(size=(3, 4))
    pixels = tensors.long_view(images(spark, image[None]), ["label", "vec_id"], "a", 4)
    got = {(r["y"], r["x"]): r["v"] for r in tensors.padded_axes(pixels, ["label", "vec_id"], 3, 4, 2).collect()}
    want = np.pad(image, 2, mode="median")
    assert len(got) == want.size and all(got[y - 2, x - 2] == pytest.approx(want[y, x]) for y in range(7) for x in range(8))


def test_window_frame_and_missing_pixels(spark):
    image = np.arange(20.0).reshape(4, 5)
    pixels = tensors.long_view(images(spark, image[None]), ["label", "vec_id"], "a", 5).select("label", "y", "x", "v")
    centres = spark.createDataFrame([(0, 1, 2)], "label int, center_y int, center_x int")
    got = {(r["y"], r["x"]): r["v"] for r in tensors.windowed(pixels, centres, ["label"], 1).collect()}
    assert got == {(y, x): image[y, x + 1] for y in range(3) for x in range(3)}
    framed = tensors.framed(pixels.where("v > 17"), ["label"], 4, 6, "v")
    assert framed.count() == 24 and framed.agg(F.sum("v")).first()[0] == 37.0


def test_otsu_parts_two_levels_and_a_constant_map(spark):
    rows = [(0, i, v) for i, v in enumerate([1.0] * 10 + [2.0] * 8 + [9.0] * 6)] + [(1, 0, 3.0), (1, 1, 3.0)]
    grey = S.grey_levels(spark.createDataFrame(rows, "label int, i int, v double"), ["label"], "v")
    cuts = {r["label"]: r["cut"] for r in S.otsu_cuts(grey, ["label"], "g").collect()}
    assert cuts == {0: 32, 1: 0}
    assert grey.where("label = 1").agg(F.max("g")).first()[0] == 0


def test_contours_of_one_cell(spark):
    circle = lambda r: [(r * math.cos(t), r * math.sin(t)) for t in np.radians(np.arange(0, 360, 10))]
    rows = [(1, "c", circle(10.0)), (2, "c", circle(13.0)), (3, "d", circle(1.0)), (4, None, circle(1.0)), (5, None, circle(1.0))]
    df = spark.createDataFrame(rows, "id int, cell string, points array<struct<x:double,y:double>>")
    got = contours.distances(df, ["cell"], "id", "points").collect()
    assert [(r["a"], r["b"]) for r in got] == [(1, 2)]
    assert got[0]["hausdorff"] == pytest.approx(3.0) and got[0]["mean_symmetric"] == pytest.approx(3.0)


def test_hausdorff_needs_both_sides(spark):
    rows = [(0, "w", 0, 0), (0, "w", 3, 0), (0, "e", 0, 4), (1, "w", 0, 0)]
    got = pairs.hausdorff(spark.createDataFrame(rows, "label int, side string, x int, y int"), ["label"], "side", "w", "e").collect()
    assert [(r["label"], r["there"], r["back"], r["hausdorff"], r["mean_nearest"]) for r in got] == [(0, 5.0, 4.0, 5.0, 4.25)]


def test_closest_item_with_ties_and_lonely_groups(spark):
    rows = spark.createDataFrame([("g", "a", 1.0), ("g", "b", 2.0), ("g", "c", 0.0), ("h", "a", 1.0)], "grp string, item string, size double")
    got = {r["item"]: (r["closest"], r["distance"]) for r in pairs.argmin_match(rows, ["grp"], "item", lambda a, b: F.abs(a - b), "size").collect()}
    assert got == {"a": ("b", 1.0), "b": ("a", 1.0), "c": ("a", 1.0)}


def test_cosine_distances_of_all_pairs(spark):
    x = np.random.default_rng(3).normal(size=(40, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(99, [0.0] * 5)], "id int, v array<double>")
    got = {(r["a"], r["b"]): r["distance"] for r in pairs.cosine_distances(df, "id", "v", blocks=4).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert len(got) == 41 * 40 // 2 and got[0, 99] is None
    assert all(got[i, j] == pytest.approx(1 - u[i] @ u[j]) for i in range(40) for j in range(i + 1, 40))


def test_best_offset_is_the_largest_sum_of_products():
    rng = np.random.default_rng(4)
    for _ in range(20):
        a_at, b_at = (np.unique(rng.integers(-3, 6, (12, 2)), axis=0) for _ in range(2))
        a, b = rng.integers(-3, 4, len(a_at)).astype(float), rng.integers(-3, 4, len(b_at)).astype(float)
        sums = {}
        for p, v in zip(a_at, a):
            for q, w in zip(b_at, b):
                key = tuple((p - q).tolist())
                sums[key] = sums.get(key, 0.0) + v * w
        top = max(sums.values())
        dy, dx, score = kernels.best_offset(a_at, b_at, a, b)
        assert score == pytest.approx(top, abs=1e-9) and sums[dy, dx] == pytest.approx(top)


def test_robust_z(spark):
    z = {r["i"]: r["z"] for r in S.robust_z(spark.createDataFrame([(i, float(v)) for i, v in enumerate([1, 2, 3, 4, 100])] + [(9, None)], "i int, v double"), "v").collect()}
    assert z[2] == 0.0 and z[4] > 3.5 and 9 not in z
    assert {r["z"] for r in S.robust_z(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v").collect()} == {None}


def test_regions_of_a_map_are_those_of_the_graph(spark):
    mask = np.random.default_rng(6).random((2, 12, 15)) < 0.5
    rows = [(label, int(y * 15 + x), int(y), int(x)) for label in (0, 1) for y, x in zip(*np.nonzero(mask[label]))]
    df = spark.createDataFrame(rows + rows[:3], "label int, i int, y int, x int")
    want = graph.components(df.select("label", F.col("i").alias("node")), graph.pixel_edges(df, ["label"]), ["label"])
    assert {tuple(r) for r in graph.map_components(df, ["label"]).collect()} == {tuple(r) for r in want.select("label", "node", "component").collect()}
    spiral = [(0, i, y, x) for i, (y, x) in enumerate([(0, 0), (0, 1), (0, 2), (1, 2), (2, 2), (2, 1), (2, 0), (3, 0), (4, 0), (4, 2)])]
    got = {r["node"]: r["component"] for r in graph.map_components(spark.createDataFrame(spiral, "label int, i int, y int, x int"), ["label"]).collect()}
    assert got == {i: 0 if i < 9 else 9 for i in range(10)}
