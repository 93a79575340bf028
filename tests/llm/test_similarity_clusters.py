import numpy as np
from pyspark.sql import functions as F

from rfloom.llm import similarity_clusters as S

OUT = "outline_id bigint, recording string, channel string, cell_index int, center array<double>, surround array<double>, in_out array<double>, radius_um array<double>"
TRACE = "recording string, channel string, cell_index int, time_ms array<double>, v array<float>"


def shape(rng):
    a = np.radians(np.arange(36) * 10)
    wave = lambda: sum(rng.normal() * np.cos(k * a + rng.uniform(0, 6)) for k in range(1, 5))
    x = np.linspace(0, 1, 40)
    line = lambda n: sum(rng.normal() * np.sin((k + 1) * 3 * x[:n] + rng.uniform(0, 6)) for k in range(4))
    return [wave(), wave(), line(32), line(40)]


def tables(spark, cells):
    outs, paths = [], []
    for i, (c, s, io, v) in enumerate(cells):
        lists = [None if x is None else [float(y) for y in x] for x in (c, s, io)]
        outs.append((i, "r", "c", i, *lists, [float(x) for x in np.linspace(0, 420, len(io))] if io is not None else None))
        if v is not None:
            paths.append(("r", "c", i, [float(x) for x in np.linspace(-300, 90, len(v))], [float(x) for x in v]))
    return spark.createDataFrame(outs, OUT), spark.createDataFrame(paths, TRACE)


def found(spark, outs, paths, parts=3, **more):
    cells = S.features(outs, paths).repartition(parts)
    return {(r["cluster"], r["outline_id"]) for r in S.clusters(cells, **more).where("cluster <> outline_id").collect()}


def many(rng, groups, size, noise=0.06):
    bases = [shape(rng) for _ in range(groups)]
    cells = [[p + rng.normal(size=len(p)) * noise * p.std() for p in b] for b in bases for _ in range(size)]
    order = rng.permutation(len(cells))
    return [cells[i] for i in order]


def brute(spark, outs, paths):
    rows = S.features(outs, paths).collect()
    ids, m = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    least = np.minimum.reduce([m[:, a:b] @ m[:, a:b].T for a, b in zip(S._PARTS, S._PARTS[1:])])
    return {(int(ids[least[i] >= 0.9].min()), int(ids[i])) for i in range(len(ids)) if (least[i] >= 0.9).sum() > 1 and ids[least[i] >= 0.9].min() != ids[i]}


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(7)
    cells = many(rng, 60, 4) + [shape(rng) for _ in range(60)]
    outs, paths = tables(spark, cells)
    want, got = brute(spark, outs, paths), found(spark, outs, paths, 5, max_pivots=16)
    assert len(want) == 180
    assert got == want


def test_crowded_regions_are_divided(spark):
    rng = np.random.default_rng(8)
    outs, paths = tables(spark, many(rng, 40, 3))
    assert found(spark, outs, paths, max_pivots=4, region_leaves=10) == brute(spark, outs, paths)


def test_odd_cells(spark):
    """Three of four curves alike, missing, constant and holed curves, repeated rows, clashing columns and many copies, side by side."""
    rng = np.random.default_rng(9)
    base, other, copied = shape(rng), shape(rng), shape(rng)
    holed = [x.copy() for x in base]
    for x in holed:
        x[5:7] = np.nan
    cells = [base, [*base[:3], other[3]], [2 * base[0] + 5, *base[1:]], holed, [base[0], None, *base[2:]], [np.zeros(36), *base[1:]], [*base[:3], None], [np.full(36, np.nan), *base[1:]], base, *[copied] * 200]
    outs, paths = tables(spark, cells)
    outs, paths = outs.unionByName(outs).withColumn("vec", F.lit(1)).withColumn("leaf", F.lit("x")), paths.unionByName(paths).withColumn("center", F.lit(0))
    assert found(spark, outs, paths) == {(0, 2), (0, 3), (0, 8)} | {(9, i) for i in range(10, 209)}


def test_empty(spark):
    assert found(spark, *tables(spark, [])) == set()


def test_description(spark):
    rng = np.random.default_rng(12)
    outs, paths = tables(spark, many(rng, 1, 6))
    rows = S.described(S.clusters(S.features(outs, paths))).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3] and {r["size"] for r in rows} == {6}
    assert rows[0]["typicality"] >= rows[1]["typicality"] >= rows[2]["typicality"]


def test_chains_are_split_into_groups_alike_throughout(spark):
    a = np.radians(np.arange(36) * 10)
    turned = lambda d: [np.cos(a + np.radians(d)), np.cos(2 * a), np.linspace(0, 1, 32), np.linspace(1, 0, 40) ** 2]
    got = {}
    outs, paths = tables(spark, [turned(d) for d in range(0, 120, 6)])
    for r in S.clusters(S.features(outs, paths).repartition(2)).collect():
        got.setdefault(r["cluster"], []).append(r["outline_id"])
    assert got and all(6 * (max(m) - min(m)) <= 25.85 for m in got.values())


def test_trees_merge():
    rng = np.random.default_rng(13)
    points = S.unit(rng.normal(size=(300, S.WIDTH)))
    trees = [S.FeatureTree(), S.FeatureTree()]
    for i, p in enumerate(points):
        trees[i % 2].insert(p)
    whole = S.FeatureTree()
    for tree in trees:
        for n, s in zip(*tree.leaves()):
            whole.insert(s, int(n))
    counts, sums = whole.leaves()
    assert counts.sum() == 300 and np.allclose(sums.sum(0), points.sum(0))
    counts, _ = whole.top(40)
    assert counts.sum() == 300 and len(counts) <= 40


def test_groups_merged_by_their_centroids_are_parted(spark):
    """Two groups whose centroids are alike, but no members across; ranked in turn, so that each has an unlike cell above it."""
    a = np.radians(np.arange(36) * 10)
    for size in (2, 4):
        cells = []
        for i in range(2 * size):
            base = np.cos(a) if i % 2 == 0 else 0.97 * np.cos(a) + np.sqrt(1 - 0.97**2) * np.cos(2 * a)
            cells.append([base + np.sqrt(0.088 + 0.002 * i) * np.cos((i + 3) * a), np.cos(2 * a), np.linspace(0, 1, 32), np.linspace(1, 0, 40) ** 2])
        outs, paths = tables(spark, cells)
        want = brute(spark, outs, paths)
        assert len(want) == 2 * size - 2
        assert found(spark, outs, paths, 1) == want


def test_a_cell_gives_way_only_to_cells_that_stay(spark):
    rows = [(7, 3.0, 2, 1), (7, 2.0, 3, 2), (7, 1.0, 4, 3), (7, 1.0, 4, 1), (8, 1.0, 6, 5)]
    got = S._parted(spark.createDataFrame(rows, "cluster bigint, total double, outline_id bigint, above bigint")).collect()
    assert {tuple(r) for r in got} == {(2, 1), (3, 0), (4, 1), (6, 1)}
