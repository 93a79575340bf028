import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from rfloom.operators.regular_grid import regular_grid
from rfloom.plans.pipeline import Pipeline
from rfloom.sources import cubes, settings
from rfloom.streaming import incremental


def test_pipeline_orders_resumes_and_complains(spark, tmp_path):
    line = Pipeline(spark, f"file://{tmp_path}", {"numbers": spark.range(5)}, {"factor": 3})
    calls = []

    @line.task
    def total(scaled):
        calls.append("total")
        return scaled.agg(F.sum("x").alias("total"))

    @line.task
    def scaled(numbers, factor, shift=1):
        calls.append("scaled")
        return numbers.select((F.col("id") * factor + shift).alias("x"))

    assert line.order() == ["scaled", "total"]
    assert line.run() == ["scaled", "total"] and line.result("total").first()["total"] == 35
    assert line.run() == [] and calls == ["scaled", "total"]
    with pytest.raises(ValueError):
        line.task(scaled)
    with pytest.raises(KeyError):
        line.run(["nothing"])

    @line.task
    def lacking(absent):
        return absent

    with pytest.raises(ValueError):
        line.order(["lacking"])


def test_cubes_are_read_and_broken_files_reported(spark, tmp_path):
    for cell, cube in ((3, np.arange(24.0).reshape(2, 3, 4)), (4, np.zeros((2, 2)))):
        (tmp_path / f"rec/red/cell_{cell}").mkdir(parents=True)
        np.save(tmp_path / f"rec/red/cell_{cell}/kernel.npy", cube)
    (tmp_path / "rec/red/cell_5").mkdir()
    (tmp_path / "rec/red/cell_5/kernel.npy").write_bytes(b"no array")
    got = {r["cell_index"]: r for r in cubes.read_cubes(spark, str(tmp_path)).collect()}
    assert got[3]["shape"] == [2, 3, 4] and got[3]["data"] == list(map(float, range(24))) and got[3]["recording"] == "rec"
    assert got[4]["problem"].startswith("2 dimensions") and got[5]["problem"] and got[5]["data"] is None


def test_labelled_arrays_survive_json(spark):
    rows = spark.createDataFrame([(["x"], {"x": [10.0, 20.0]}, [1.0, 2.0], "a"), (["x"], {"x": [1.0]}, None, "b")], cubes.LABELLED)
    back = rows.select(cubes.from_labelled_json(cubes.to_labelled_json(F.col("dims"), F.col("coords"), F.col("data"), F.col("name"))).alias("r"), "name").collect()
    assert {r["name"]: (r["r"]["data"], r["r"]["coords"]) if r["r"] else None for r in back} == {"a": ([1.0, 2.0], {"x": [10.0, 20.0]}), "b": None}


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {tuple(r) for r in cubes.upsert(spark, old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}


def test_streamed_grid_equals_the_batch(spark, tmp_path):
    schema = "cell int, t double, dt double, v double"
    keys, args = ["cell"], (["cell"], "t", "v", "dt")
    parts = [[(1, 0.0, 10.0, 0.0), (2, 0.0, 10.0, 1.0)], [(1, 40.0, 10.0, 4.0), (1, 40.0, 10.0, 4.0)]]
    folder = {k: str(tmp_path / k) for k in ("in", "store", "grid", "check")}
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder["in"])
        incremental.keep_grid(spark, folder["in"], schema, folder["store"], folder["grid"], folder["check"], keys, "t", "v", "dt", 4).awaitTermination(120)
    got = {tuple(r) for r in spark.read.parquet(folder["grid"]).select("cell", "slot", "value", "status").collect()}
    want = {tuple(r) for r in regular_grid(spark.createDataFrame(sum(parts, []), schema), *args).select("cell", "slot", "value", "status").collect()}
    assert got == want and len(want) == 6


def test_settings_are_json(spark, tmp_path):
    assert json.loads(Pipeline(spark, str(tmp_path), {}, {"b": 1, "a": "x"}).settings_json()) == {"a": "x", "b": 1}


def test_settings_are_saved_replaced_and_read(spark, tmp_path):
    folder = f"{tmp_path}/settings"
    assert settings.load(spark, folder) == {}
    settings.save(spark, folder, {"cut_um": 800.0, "channels": ["560_nm", None]})
    assert settings.put(spark, folder, "cut_um", 400.0) == settings.load(spark, folder) == {"cut_um": 400.0, "channels": ["560_nm", None]}


def test_channels_are_added_or_replaced(spark):
    kind = "recording string, channel string, colour string, stimulus_id int, image_w int"
    channels = spark.createDataFrame([("r", "a", "red", 1, 50), ("r", "b", "blue", 2, 60)], kind)
    added = spark.createDataFrame([("r", "b", "white", 1), ("r", "c", "green", 2), ("r", "d", "grey", 9), ("s", "a", "red", 1)], "recording string, channel string, colour string, stimulus_id int")
    got = sorted(tuple(r) for r in settings.add_channels(channels, added).collect())
    assert got == [("r", "a", "red", 1, 50), ("r", "b", "white", 1, 50), ("r", "c", "green", 2, 60)]
