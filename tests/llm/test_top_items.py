import math
import random

from pyspark.sql import functions as F

from rfloom.llm.top_items import score_bin, thresholds, top_items

SCHEMA = "g string, item int, score double"


def ranked(spark, rows, n):
    return [tuple(r) for r in top_items(spark.createDataFrame(rows, SCHEMA), ["g"], "item", "score", n).orderBy("g", "rank").collect()]


def brute(rows, n):
    best = {}
    for g, item, score in rows:
        if item is not None and score is not None and math.isfinite(score):
            best[g, item] = max(score, best.get((g, item), -math.inf))
    out = []
    for g in {g for g, _ in best}:
        order = sorted((-s, i) for (h, i), s in best.items() if h == g)
        out += [(g, i, -s, k + 1) for k, (s, i) in enumerate(order[:n])]
    return sorted(out, key=lambda r: (r[0] is not None, r[0], r[3]))


def test_against_brute_force(spark):
    rng = random.Random(1)
    values = [0.0, -0.0, 1e-300, -1e-300, 1e300, -1e300, 5.0, 5.0, math.nan, math.inf, -math.inf, None, -3.5, 2.25]
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([*values, rng.uniform(-10, 10)])) for _ in range(600)]
    for n in (1, 4, 100):
        assert ranked(spark, rows, n) == brute(rows, n)


def test_huge_tie_is_broken_by_item(spark):
    rows = [("a", i, 7.0) for i in range(2000, 0, -1)] + [("a", 1, 7.0)] * 50
    assert [r[1] for r in ranked(spark, rows, 5)] == [1, 2, 3, 4, 5]


def test_empty_none_and_clashing_columns(spark):
    assert ranked(spark, [], 5) == [] and ranked(spark, [("a", 1, 1.0)], 0) == []
    rows = spark.createDataFrame([("a", 1, 1.0)], SCHEMA).withColumn("_bin", F.lit(3)).withColumn("rank", F.lit("x")).withColumn("_least", F.lit(1))
    assert [tuple(r) for r in top_items(rows, ["g"], "item", "score", 2).collect()] == [("a", 1, 1.0, 1)]


def test_bins_are_monotone_and_threshold_is_safe(spark):
    scores = sorted(random.Random(2).uniform(-1, 1) * 10 ** random.Random(k).uniform(-300, 300) for k in range(500))
    bins = [r[0] for r in spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double").orderBy("i").select(score_bin(F.col("s"))).collect()]
    assert bins == sorted(bins)
    items = spark.createDataFrame([("a", i, s) for i, s in enumerate(scores)], "g string, item int, _score double")
    least = thresholds(items, ["g"], 50).first()["_least"]
    assert sum(b >= least for b in bins) >= 50
