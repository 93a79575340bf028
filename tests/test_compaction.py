from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from rfloom.operators import compaction as C

T0 = datetime(2024, 1, 1)
SCHEMA = "file_id bigint, w_path string, sta_path string, cell_idx int, first_component int, shape array<int>, weights array<float>, n_bytes bigint, written_at timestamp"
CHANNELS = "recording string, channel string"


def files(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def row(i, path, first=0, shape=(2, 2), weights=(1.0, 2.0, 3.0, 4.0), sta=None, cell=None, at=0, size=100):
    return (i, path, sta, cell, first, list(shape) if shape else None, list(weights) if weights is not None else None, size, T0 + timedelta(hours=at))


def found(df):
    return {tuple(r[k] for k in C.KEY): (r["n_files"], r["file_id"], list(r["weights"])) for r in df.collect()}


def test_spellings_and_versions(spark):
    channels = spark.createDataFrame([("Rec_1_p0", "560_nm"), ("Rec_1_p0", "560_nm")], CHANNELS)
    rows = [
        row(1, "/mnt/x/rec_1_p0/560_NM/cell_000003/reshaped_W.npy", at=0),
        row(2, "D:\\e\\rec_1_p0\\560_nm\\cell_3\\reshaped_W.npy", weights=(9.0, 9.0, 8.0), at=1),  # cut short: component 0 only
        row(2, "D:\\e\\rec_1_p0\\560_nm\\cell_3\\reshaped_W.npy", weights=(9.0, 9.0, 8.0), at=1),  # listed twice
        row(3, " ./rec_1_p0//560_nm/cell_3/reshaped_W.npy ", first=5, shape=(1, 2), weights=(7.0, 7.0), at=2),
        row(4, None, sta="rec_1_p0/560_nm/cell_0/kernel.npy", weights=(1.0, 1.0, 1.0, 1.0)),
    ]
    got = found(C.compact_components(files(spark, rows), channels, 4))
    assert got == {
        ("Rec_1_p0", "560_nm", 3, 0): (2, 2, [9.0, 9.0]),
        ("Rec_1_p0", "560_nm", 3, 1): (1, 1, [3.0, 4.0]),
        ("Rec_1_p0", "560_nm", 3, 5): (1, 3, [7.0, 7.0]),
        ("Rec_1_p0", "560_nm", 0, 0): (1, 4, [1.0, 1.0]),
        ("Rec_1_p0", "560_nm", 0, 1): (1, 4, [1.0, 1.0]),
    }


def test_rows_without_whole_components(spark):
    channels = spark.createDataFrame([], CHANNELS)
    rows = [row(1, None), row(2, "a/b/cell_1/w", weights=None), row(3, "a/b/cell_1/w", weights=()), row(4, "a/b/cell_1/w", shape=None), row(5, "a/b/cell_1/w", shape=(1, 0)), row(6, "nothing")]
    assert found(C.compact_components(files(spark, rows), channels, 4)) == {}
    assert found(C.compact_components(files(spark, []), channels, 4)) == {}


def test_extra_columns_are_ignored(spark):
    channels = spark.createDataFrame([("a", "b")], CHANNELS)
    rows = files(spark, [row(1, "a/b/cell_1/w")]).withColumn("part", F.lit("x")).withColumn("recording", F.lit("other")).withColumn("component", F.lit(9))
    assert set(found(C.compact_components(rows, channels, 4))) == {("a", "b", 1, 0), ("a", "b", 1, 1)}


def store_of(spark, tmp_path, rows, buckets=4):
    store = C.SmallFileStore(spark, f"file://{tmp_path}/store", C.KEY, ["recording", "channel", "cell_idx"], buckets)
    store.append(stored(spark, rows))
    return store


def stored(spark, rows):
    return C.components(files(spark, rows)).withColumn("n_files", F.lit(1).cast("bigint"))


def listed(store):
    return {r["part"]: r["n_files"] for r in store.snapshot().collect()}


def test_only_crowded_partitions_are_rewritten(spark, tmp_path):
    rows = [row(i, f"r/c/cell_{i % 3}/w", at=i) for i in range(30)]
    store = store_of(spark, tmp_path, rows, 64)
    lonely = stored(spark, [row(99, "lonely/c/cell_7/w")])
    store.append(lonely)
    alone = store.read().where("recording = 'lonely'").first()["part"]
    crowded = {r["part"] for r in store.read().where("recording = 'r'").select("part").distinct().collect()}
    assert alone not in crowded
    before = store.live(2)
    report = store.compact(["n_bytes", "weights"], max_small_files=3)
    assert set(report.rewritten) == crowded and not report.conflicts and report.version == 3 == store.version()
    after, counts = store.live(3), listed(store)
    assert all(counts[p] == 1 for p in crowded) and after[alone] == before[alone]
    assert store.read().where("recording = 'r'").count() == 6
    assert sum(r["n_files"] for r in store.read().where("recording = 'r' and component = 0").collect()) == 30
    assert store.read(2).count() == 62  # an earlier version reads as it was
    # a second run finds nothing to do
    assert store.compact(["n_bytes", "weights"], max_small_files=3).rewritten == [] and store.version() == 3


def test_appends_between_reading_and_publishing_stay(spark, tmp_path):
    store = store_of(spark, tmp_path, [row(i, "r/c/cell_1/w", at=i) for i in range(8)])
    other = C.SmallFileStore(spark, store.root, C.KEY, store.bucket_by)
    late = stored(spark, [row(50, "r/c/cell_1/w", at=50)])
    report = store.compact(["n_bytes", "weights"], before_publish=lambda: other.append(late))
    assert report.rewritten and not report.conflicts and store.version() == 3
    assert sorted((r["file_id"], r["n_files"]) for r in store.read().collect()) == [(7, 8), (7, 8), (50, 1), (50, 1)]
    assert store.compact(["n_bytes", "weights"]).rewritten
    assert [(r["file_id"], r["n_files"]) for r in store.read().collect()] == [(50, 9), (50, 9)]


def test_an_append_that_finds_its_version_taken_builds_on_it(spark, tmp_path):
    store = store_of(spark, tmp_path, [row(i, "r/c/cell_1/w", at=i) for i in range(4)])
    other = C.SmallFileStore(spark, store.root, C.KEY, store.bucket_by)
    version = store.append(stored(spark, [row(60, "r/c/cell_1/w", at=60)]), before_publish=lambda: other.compact(["n_bytes", "weights"]))
    assert version == 3
    assert sorted((r["file_id"], r["n_files"]) for r in store.read().collect()) == [(3, 4), (3, 4), (60, 1), (60, 1)]


def test_two_compactions_of_one_partition_conflict(spark, tmp_path):
    store = store_of(spark, tmp_path, [row(i, "r/c/cell_1/w", at=i) for i in range(8)])
    other = C.SmallFileStore(spark, store.root, C.KEY, store.bucket_by)
    report = store.compact(["n_bytes", "weights"], before_publish=lambda: other.compact(["n_bytes", "weights"]))
    assert report.conflicts and not report.rewritten and store.version() == 2
    assert [(r["file_id"], r["n_files"]) for r in store.read().collect()] == [(7, 8), (7, 8)]
    with pytest.raises(C.CompactionConflict):
        store._take(1, {}, "append", store._layout())


def test_a_store_opens_on_its_folder(spark, tmp_path):
    store_of(spark, tmp_path, [row(i, "r/c/cell_1/w", at=i) for i in range(3)])
    again = C.SmallFileStore(spark, f"file://{tmp_path}/store", C.KEY, ["recording", "channel", "cell_idx"], 99)
    assert again.buckets == 4 and again.read().count() == 6
    again.compact(["n_bytes", "weights"])
    assert again.read().count() == 2 and again.read(1).count() == 6
    assert len(again.vacuum(keep_versions=1)) == 1 and again.read().count() == 2


def test_a_repeated_key_is_consolidated_whatever_the_sizes(spark, tmp_path):
    path = "/x/rec_1_p0/560_nm/cell_1/w.npy"
    store = store_of(spark, tmp_path, [row(1, path, size=100 << 20), row(2, path, at=1, size=100 << 20)])
    store.compact(["n_bytes", "weights"], max_small_files=10**6, small_bytes=1)
    assert [(r["component"], r["n_files"]) for r in store.read().orderBy("component").collect()] == [(0, 2), (1, 2)]


def test_large_and_single_files_are_consolidated_too(spark):
    """No partition has two small files here, so none is rewritten."""
    path = lambda cell: f"/x/rec_1_p0/560_nm/cell_{cell}/w.npy"
    rows = [row(1, path(1), size=100 << 20), row(2, path(1), weights=(5.0, 6.0, 7.0, 8.0), at=1, size=200 << 20), row(3, path(2), size=100 << 20), row(3, path(2), size=100 << 20, at=1)]
    got = C.compact_components(files(spark, rows), None, 4).collect()
    assert sorted((r["cell_idx"], r["component"], r["n_files"], r["file_id"]) for r in got) == [(1, 0, 2, 2), (1, 1, 2, 2), (2, 0, 1, 3), (2, 1, 1, 3)]
