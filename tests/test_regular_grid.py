import math
import random

from pyspark.sql import functions as F

from rfloom.operators import regular_grid as R

SCHEMA = "recording string, channel string, cell_index int, time_max double, dt_ms double, sta_single_pixel double"
KEYS = ["recording", "channel", "cell_index"]
ARGS = (KEYS, "time_max", "sta_single_pixel", "dt_ms")


def readings(spark, rows):
    return spark.createDataFrame([("r", "c", *x) if len(x) == 4 else x for x in rows], SCHEMA)


def slots(df):
    return sorted((r["cell_index"] if r["cell_index"] is not None else -1, r["slot"]) for r in df.collect())


def missing(spark, rows, chunk=4096):
    return slots(R.uncovered(R.intervals(readings(spark, rows), *ARGS, chunk=chunk), KEYS))


def test_gaps_and_unusable_readings(spark):
    rows = [(1, 0.0, 10.0, 1.0), (1, 21.0, None, 2.0), (1, 10.0, 10.0, None), (1, 10.0, 10.0, math.nan), (1, None, 10.0, 5.0), (1, 50.0, 10.0, 3.0), (1, 50.0, 10.0, 3.0), (1, 70.0, 10.0, math.inf), (1, math.inf, 10.0, 1.0)]
    assert missing(spark, rows) == [(1, 1), (1, 3), (1, 4)]


def test_no_step_null_keys_and_empty(spark):
    assert missing(spark, [(1, 0.0, None, 1.0), (1, 50.0, None, 1.0), (2, 0.0, -5.0, 1.0), (2, 9.0, 0.0, 1.0)]) == []
    assert missing(spark, [(None, 0.0, 10.0, 1.0), (None, 20.0, None, 1.0)]) == [(-1, 1)]
    assert missing(spark, []) == []
    assert R.regular_grid(readings(spark, []), *ARGS).count() == 0


def test_chunks_agree_with_brute_force(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(3), rng.uniform(-3000, 3000), 10.0, rng.random()) for _ in range(400)]
    want = []
    for cell in range(3):
        own = {math.floor(t / 10 + 0.5) for c, t, _, _ in rows if c == cell}
        want += [(cell, s) for s in range(min(own), max(own)) if s not in own]
    assert missing(spark, rows, chunk=7) == missing(spark, rows) == sorted(want)
    crowded = R.intervals(readings(spark, rows), *ARGS, chunk=100, crowded=30)  # some chunks by windows, some as arrays
    plain = R.intervals(readings(spark, rows), *ARGS)
    assert slots(R.uncovered(crowded, KEYS)) == sorted(want)
    assert sorted(map(tuple, crowded.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_huge_gap_is_expanded_whole(spark):
    assert len(missing(spark, [(1, 0.0, 1.0, 1.0), (1, 20000.0, 1.0, 1.0)])) == 19999


def test_values_and_increments(spark):
    grid = {r["slot"]: r for r in R.regular_grid(readings(spark, [(1, 0.0, 10.0, 0.0), (1, 40.0, 10.0, 8.0), (1, 42.0, 10.0, 9.0)]), *ARGS).collect()}
    assert [grid[s]["status"] for s in range(5)] == ["observed", "filled", "filled", "filled", "observed"]
    assert [grid[s]["value"] for s in range(5)] == [0.0, 2.0, 4.0, 6.0, 8.0]
    assert [grid[s]["increment"] for s in range(5)] == [1.0, 2.0, 2.0, 2.0, 2.0]
    assert sum(r["increment"] for r in grid.values()) == 9.0


def test_counter_resets(spark):
    rows = readings(spark, [(1, 0.0, 10.0, 100.0), (1, 20.0, 10.0, 120.0), (1, 40.0, 10.0, 6.0)])
    grid = {r["slot"]: r for r in R.regular_grid(rows, *ARGS, counter=True).collect()}
    assert abs(sum(r["increment"] for r in grid.values()) - 26.0) < 1e-9
    assert grid[1]["value"] == 110.0 and grid[3]["value"] == 3.0


def rows_of(df):
    return sorted((r["cell_index"], r["slot"], r["grid_time"], round(r["value"], 9), round(r["increment"], 9), r["status"]) for r in df.collect())


def test_chunked_crowded_and_whole_grids_agree(spark):
    rng = random.Random(5)
    rows = readings(spark, [(rng.randrange(2), rng.choice([rng.uniform(-900, 900), rng.uniform(3000, 3100), 40.0]), 10.0, rng.random()) for _ in range(300)])
    for counter in (False, True):
        whole = rows_of(R.regular_grid(rows, *ARGS, counter=counter))
        assert whole == rows_of(R.regular_grid(rows, *ARGS, counter=counter, chunk=7))
        assert whole == rows_of(R.regular_grid(rows, *ARGS, counter=counter, chunk=50, crowded=20))
        assert sum(r[5] == "filled" for r in whole) == R.uncovered(R.intervals(rows, *ARGS), KEYS).count()


def test_single_readings(spark):
    rows = readings(spark, [(1, 0.0, 10.0, 1.0), (2, 30.0, 10.0, 4.0)])
    assert rows_of(R.regular_grid(rows, *ARGS)) == [(1, 0, 0.0, 1.0, 0.0, "observed"), (2, 3, 30.0, 4.0, 0.0, "observed")]


def test_a_broken_clock_is_reported_and_not_expanded(spark):
    rows = readings(spark, [(1, 0.0, 10.0, 1.0), (1, 30.0, 10.0, 4.0), (1, 1e15, 10.0, 5.0), (1, 1e300, 10.0, 5.0), (2, 0.0, 10.0, 1.0), (2, 20.0, 10.0, 1.0)])
    assert [r[:2] for r in rows_of(R.regular_grid(rows, *ARGS))] == [(1, 0), (1, 1), (1, 2), (1, 3), (1, 10**14), (2, 0), (2, 1), (2, 2)]
    found = {(r["cell_index"], r["first_slot"], r["last_slot"], r["steps"]) for r in R.gaps(R.intervals(rows, *ARGS), KEYS).collect()}
    assert found == {(1, 1, 2, 2), (1, 4, 10**14 - 1, 10**14 - 4), (2, 1, 1, 1)}


def test_ties_and_clashing_columns(spark):
    rows = readings(spark, [(1, 0.0, 10.0, 1.0), (1, 0.0, 10.0, 5.0), (1, 30.0, 10.0, 2.0)]).withColumn("slot", F.lit(7)).withColumn("v", F.lit("x")).withColumn("chunk", F.lit(1)).withColumn("prev", F.lit(1))
    grid = {r["slot"]: r["value"] for r in R.regular_grid(rows, *ARGS).collect()}
    assert grid == {0: 5.0, 1: 4.0, 2: 3.0, 3: 2.0}
