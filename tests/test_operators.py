import numpy as np
import pytest
from pyspark.sql import functions as F

from rfloom.operators import cellwise, graph, pairs, reduction, tensors
from rfloom.plans import rf_queries
from rfloom.operators import statistics as S


def images(spark, stack, label=0):
    rows = [(label, t, image.ravel().tolist()) for t, image in enumerate(stack)]
    return spark.createDataFrame(rows, "label int, vec_id int, embedding array<double>")


def test_one_bright_pixel(spark):
    stack = np.zeros((20, 4, 5))
    stack[:, 2, 3] = np.arange(20)
    pixels = tensors.long_view(images(spark, stack), ["label", "vec_id"], "embedding", 5)
    row = S.rf_quality(pixels, ["label"]).first()
    assert (row["center_x"], row["center_y"], row["quality"]) == (3, 2, None)
    assert reduction.dominant_pixels(images(spark, stack), "label", "embedding", 20).first()["pixel"] == 13


def test_constant_and_ties(spark):
    pixels = tensors.long_view(images(spark, np.ones((3, 2, 2))), ["label", "vec_id"], "embedding", 2)
    row = S.rf_quality(pixels, ["label"]).first()
    assert row["quality"] is None and (row["center_x"], row["center_y"]) == (0, 0)


def test_row_sum_is_the_pairwise_sum(spark):
    stack = np.random.default_rng(0).normal(size=(30, 3, 2))
    pixels = tensors.long_view(images(spark, stack), ["label", "vec_id"], "embedding", 2)
    cov = np.cov(stack.reshape(30, 6).T)
    got = {(r["y"] * 2 + r["x"]): r["total"] for r in S.covariance_row_sum(pixels, ["label"], "vec_id").collect()}
    want = cov.sum(1) - np.diag(cov)
    assert all(got[i] == pytest.approx(want[i]) for i in range(6))


def test_covariances_and_dominant_pixel(spark):
    stack = np.random.default_rng(2).normal(size=(40, 2, 3)) * np.array([1, 1, 1, 1, 5, 1]).reshape(2, 3)
    x = stack.reshape(40, 6)
    cov = np.cov(x.T)
    got = reduction.covariance_edges(images(spark, stack), "label", "embedding", 6, 0.1).collect()
    assert {(r["p"], r["q"]) for r in got} == {(p, q) for p in range(6) for q in range(p + 1, 6) if abs(cov[p, q]) > 0.1}
    assert got and all(r["weight"] == pytest.approx(cov[r["p"], r["q"]]) for r in got)
    leaders = {r["p"]: r["n"] for r in reduction.column_leaders(images(spark, stack), "label", "embedding", 6).collect()}
    want = [int(np.triu(cov, 1)[:, q].argmax()) for q in range(1, 6)]
    assert leaders == {p: want.count(p) for p in set(want)}
    _, _, v = np.linalg.svd(x - x.mean(0))
    assert reduction.dominant_pixels(images(spark, stack), "label", "embedding", 6).first()["pixel"] == int(np.abs(v[0]).argmax())


def test_pca_and_whitening(spark):
    x = np.random.default_rng(4).normal(size=(200, 5)) @ np.diag([5, 3, 2, 1, 0.5])
    df = images(spark, x.reshape(200, 1, 5))
    ratio = [r["ratio"] for r in reduction.explained(df, "label", "embedding", 5, 5).orderBy("component").collect()]
    w = np.linalg.eigvalsh(np.cov(x.T))[::-1]
    assert np.allclose(ratio, w / w.sum())
    scores = np.array([r["scores"] for r in reduction.projected(df, ["vec_id"], "embedding", 5, 3).collect()])
    assert np.allclose(np.cov(scores.T), np.eye(3), atol=1e-8)


def test_two_islands(spark):
    mask = np.zeros((8, 8), bool)
    mask[0, 0:5] = True
    mask[4:7, 6] = True
    cells = spark.createDataFrame([(0, int(y * 8 + x), int(y), int(x)) for y, x in zip(*np.nonzero(mask))], "label int, i int, y int, x int")
    nodes = cells.select("label", F.col("i").alias("node"))
    found = graph.components(nodes, graph.pixel_edges(cells, ["label"]), ["label"])
    assert {r["component"]: r["count"] for r in found.groupBy("component").count().collect()} == {0: 5, 38: 3}
    assert graph.largest_component(found, ["label"]).count() == 5


def test_long_path_and_isolated_nodes(spark):
    nodes = spark.range(60).select(F.lit(0).alias("g"), F.col("id").alias("node"))
    edges = nodes.where("node < 50").select("g", F.col("node").alias("a"), (F.col("node") + 1).alias("b"))
    found = {r["node"]: r["component"] for r in graph.components(nodes, edges, ["g"]).collect()}
    assert all(found[i] == 0 for i in range(51)) and all(found[i] == i for i in range(51, 60))


def test_masks(spark):
    grid = spark.range(80).select((F.col("id") % 10).alias("x"), F.floor(F.col("id") / 10).alias("y"))
    x, y = F.col("x"), F.col("y")
    assert grid.where(tensors.in_square(x, y, (0, 0), (4, 4))).count() == 16
    assert grid.where(tensors.in_square(x, y, (9, 7), (4, 4))).count() == 9  # not shifted: smaller at the far edge
    assert grid.where(tensors.in_square(x, y, (9, 7), (4, 4), (10, 8))).count() == 16
    assert grid.where(tensors.in_circle(x, y, (5, 4), 1)).count() == 5


def test_image_kernels_skip_what_they_cannot_read(spark):
    rows = spark.createDataFrame([(1, [1.0] * 16), (2, None), (3, [1.0] * 3), (4, [float("nan")] * 16)], "i int, a array<double>")
    got = {r["i"]: r["s"] for r in rows.select("i", cellwise.smoothed(F.col("a"), (4, 4), 1.0).alias("s")).collect()}
    assert np.allclose(got[1], 1.0) and got[2] is got[3] is got[4] is None


def test_best_shift_and_neighbours(spark):
    a = spark.createDataFrame([(0, 2, 3, 1.0), (0, 4, 4, 2.0)], "label int, y int, x int, v double")
    got = pairs.best_shift(a, tensors.shifted(a, -1, 2), ["label"]).first()
    assert (got["dy"], got["dx"]) == (1, -2)
    block = spark.createDataFrame([(0, y, x, 1.0) for y in range(3) for x in range(3)] + [(0, 9, 9, 1.0)], "label int, y int, x int, v double")
    assert pairs.drop_singled(block, ["label"], 3 / 8).count() == 9


def test_every_outline_and_trace_gets_rows(spark, tmp_path):
    """Holed, all-zero and all-hole outlines, a holed and an all-hole trace."""
    outs = [(1, "r", "c", 1, [1.0, float("nan"), 1.0, 1.0], [2.0, 2.0, None, 2.0]), (2, "r", "c", 2, [0.0] * 4, None), (3, "r", "c", 3, [None] * 4, [2.0] * 4)]
    kind = "outline_id bigint, recording string, channel string, cell_index int, center array<double>, surround array<double>"
    spark.createDataFrame([(*o, None) for o in outs], kind + ", loaded_at timestamp").write.parquet(f"{tmp_path}/outlines.parquet")
    stimulus = ("image_w", "image_h", "pixel_size", "dt_ms", "post_spike_bins", "total_sta_len", "stimulus_id")
    spark.createDataFrame([("r", "c", *[3.0] * 7)], "recording string, channel string, " + ", ".join(f"{n} double" for n in stimulus)).write.parquet(f"{tmp_path}/channels.parquet")
    traces = [("r", "c", 1, [float(t) for t in range(10)], [0.0, None, *map(float, range(2, 10))]), ("r", "c", 2, [0.0, 1.0], [None, None])]
    spark.createDataFrame(traces, "recording string, channel string, cell_index int, time_ms array<double>, v array<float>").write.parquet(f"{tmp_path}/sta_traces.parquet")
    got = {r["outline_id"]: r for r in rf_queries.QUERIES["rf_stats_all"](spark, str(tmp_path)).collect()}
    assert (got[1]["center_size_mm2"], got[1]["surround_size_mm2"], got[1]["tilt"]) == (1.8e-5, 7.2e-5, 1.0)
    assert (got[2]["center_size_mm2"], got[2]["surround_size_mm2"], got[2]["tilt"]) == (0.0, None, None)
    assert got[3]["center_size_mm2"] is None and got[3]["surround_size_mm2"] == 7.2e-5
    for name in ("radial_area_all", "circle_fit_all", "roundness_all", "tilt_angle_all", "array_extrema_all", "arc_length_all"):
        assert {r["outline_id"] for r in rf_queries.QUERIES[name](spark, str(tmp_path)).collect()} == {1, 2, 3}
    for name in ("zscore_tail_all", "zscore_noise_all", "bandpass", "envelope"):
        rows = rf_queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert sorted((r["cell_index"], r["position"]) for r in rows if r["position"] is not None) == [(1, i) for i in range(10)]
        assert [r["position"] for r in rows if r["cell_index"] == 2] == [None]
