import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rfloom.llm import packing as P


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 200), max_size=30))
def test_every_item_is_placed_and_none_overflows(histogram):
    patterns = P.pack_histogram(histogram, 64)
    used = {}
    for count, pattern in patterns:
        assert count > 0 and sum(length * n for length, n in pattern) <= 64
        for length, n in pattern:
            used[length] = used.get(length, 0) + count * n
    assert used == histogram
    assert len(patterns) <= 2 * 64
    intervals = P.rank_intervals(patterns)
    for length, n in histogram.items():
        own = sorted((a, b) for size, a, b, _, _ in intervals if size == length)
        assert own[0][0] == 0 and own[-1][1] == n and all(x[1] == y[0] for x, y in zip(own, own[1:]))


def test_large_counts_are_fast():
    patterns = P.pack_histogram({n: 10**9 + n for n in range(1, 8193)}, 8192)
    assert sum(c * n for c, p in patterns for _, n in p) == sum(10**9 + n for n in range(1, 8193))


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string")


def test_messages_are_whole_and_containers_full(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.choice([0, 5, 20, 63, 64, 100, 200, rng.randrange(64)])) for i in range(500)] + [(900 + i, "é" * 10) for i in range(200)]
    got = P.pack(documents(spark, rows), 64, salts=4).collect()
    tokens = {i: len(t.encode()) + 1 for i, t in rows}
    per_doc, per_container = {}, {}
    for r in got:
        per_doc.setdefault(r["doc_id"], []).append((r["piece"], r["length"]))
        per_container[r["container"]] = per_container.get(r["container"], 0) + r["length"]
    assert {i: sum(n for _, n in p) for i, p in per_doc.items()} == tokens
    assert all(len(p) == -(-tokens[i] // 64) and all(n == 64 for _, n in sorted(p)[:-1]) for i, p in per_doc.items())
    assert max(per_container.values()) <= 64
    assert len(per_container) <= 1.03 * sum(tokens.values()) / 64 + 1


def test_nulls_repeats_empty_and_clashing_columns(spark):
    rows = documents(spark, [(1, None), (1, None), (2, "a" * 100), (2, "a" * 100), (None, "zzz"), (3, "")]).withColumn("length", F.lit(9)).withColumn("salt", F.lit("s")).withColumn("piece", F.lit(0))
    got = sorted((r["doc_id"], r["piece"], r["length"]) for r in P.pack(rows, 64).collect())
    assert got == [(1, 0, 1), (2, 0, 64), (2, 1, 37), (3, 0, 1)]
    assert P.pack(documents(spark, []), 64).count() == 0


def test_very_long_message(spark):
    got = P.pack(documents(spark, [(1, "y" * 1_000_000)])).collect()
    assert len(got) == 123 and sum(r["length"] for r in got) == 1_000_001 and len({r["container"] for r in got}) == 123
