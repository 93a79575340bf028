"""Clusters of cells whose four curves all look alike.

Every curve is read on common points (holes bridged, angles periodic), centred
and scaled to length one, so that a correlation is a dot product and four
correlations stand side by side in one vector.

1. Each partition builds a cluster-feature tree: entries (count, linear sum)
   absorb cells that correlate by at least ``tight`` with the entry in each
   curve. The tree is a list of mergeable summaries, not of cells.
2. The upper levels of the trees are reduced, group by group, to at most
   ``max_pivots`` pivots per curve; each leaf entry goes to the two nearest
   pivots of each curve. Regions that get too many leaves are divided by the
   next curve's pivots.
3. In each region the leaves are merged by a cluster-feature tree and then by
   Ward's criterion, as long as the centroids stay alike in all curves. Groups
   from overlapping regions are united by passing on the smallest leaf.
4. One pass assigns every cell to its leaf's cluster and measures it against
   the centroid. Two cells whose angles to it add up to at most the angle of
   ``alike`` are alike for sure. What is left is compared exactly, in blocks of
   about ``_BLOCK`` cells: only blocks of which the widest cells could be
   unlike meet, each pair of blocks is one matrix product in a group of its
   own, and only unlike cells come out. A cell that is unlike one that stays
   leaves, and is clustered again with the single cells, in rounds from table
   to table.

Only pivots (a bounded number) reach the driver. Clusters that lie close about
their centroid, and copies, which one leaf absorbs, cost time in proportion to
their cells; what an exact answer needs of a cluster as wide as ``alike``
permits grows with the square of the cells beyond half that angle.

Defined results: cells with a missing, all-hole or constant curve, or without a
trace, are in no cluster; repeated rows (by outline_id, by trace key) count
once; null keys match no trace; empty tables give no clusters.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rfloom.tables import scratch, written

ANGLES, RADII, TIMES = 36, 32, 40
_PARTS = np.cumsum([0, ANGLES, ANGLES, RADII, TIMES])
WIDTH, CURVES = int(_PARTS[-1]), 4
_STARTS = _PARTS[:-1]
ALIKE = 0.9
#: Cells compared with each other in one task, and classes of their angles to the centroid.
_BLOCK, _CLASSES = 256, 8
#: Leaves that are agglomerated at a time.
_WARD = 1500


def curve(x: np.ndarray, y: np.ndarray, points: np.ndarray, period: float | None = None) -> np.ndarray | None:
    """The curve on ``points``, centred, of length one; None if it has no shape."""
    ok = np.isfinite(y) & np.isfinite(x)
    if ok.sum() < 3:
        return None
    order = np.argsort(x[ok], kind="stable")
    z = np.interp(points, x[ok][order], y[ok][order], period=period)
    z -= z.mean()
    length = np.linalg.norm(z)
    return z / length if length > 1e-9 * max(1.0, np.abs(y[ok]).max()) else None


def _lists(column: pa.Array) -> list[np.ndarray | None]:
    """The rows of a list column as arrays (null entries as NaN); null rows as None."""
    column = pa.concat_arrays([column])
    flat, offsets = column.values.to_numpy(zero_copy_only=False).astype(float), column.offsets.to_numpy()
    return [flat[a:b] if known else None for a, b, known in zip(offsets, offsets[1:], column.is_valid().to_numpy(zero_copy_only=False))]


def curves_of(xs: list, ys: list, points: np.ndarray, period: float | None, weights: dict[tuple, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(curves on ``points``, which rows have one). Rows without holes that share their x are one matrix product; the others are read one by one."""
    out, good = np.zeros((len(ys), len(points)), np.float32), np.zeros(len(ys), bool)
    groups: dict[tuple, list[int]] = {}
    for i, (x, y) in enumerate(zip(xs, ys)):
        if x is None or y is None or len(x) != len(y) or len(y) < 3:
            continue
        if np.isfinite(y).all() and np.isfinite(x).all() and (np.diff(x) > 0).all():
            groups.setdefault((x.tobytes(), period), []).append(i)
        elif (own := curve(x, y, points, period)) is not None:
            out[i], good[i] = own, True
    for key, rows in groups.items():
        if (kind := (key, len(points))) not in weights:
            if len(weights) > 1000:
                weights.clear()
            x = xs[rows[0]]
            weights[kind] = np.stack([np.interp(points, x, unit_row, period=period) for unit_row in np.eye(len(x))])
        y = np.stack([ys[i] for i in rows])
        z = y @ weights[kind]
        z -= z.mean(1, keepdims=True)
        length = np.linalg.norm(z, axis=1)
        proper = length > 1e-9 * np.maximum(1.0, np.abs(y).max(1))
        out[rows] = z / np.where(proper, length, 1.0)[:, None]
        good[rows] = proper
    return out, good


def features(outlines: DataFrame, traces: DataFrame) -> DataFrame:
    """outline_id, vec of every cell with four proper curves."""
    key = ["recording", "channel", "cell_index"]
    cells = outlines.where("outline_id is not null").select("outline_id", *key, "center", "surround", "in_out", "radius_um").dropDuplicates(["outline_id"])
    paths = traces.select(*key, "time_ms", "v").dropDuplicates(key)
    ends = lambda c: F.struct(F.percentile_approx(F.array_min(c), 0.5).alias("low"), F.percentile_approx(F.array_max(c), 0.5).alias("high"))
    radii, times = outlines.agg(ends("radius_um")).first()[0], traces.agg(ends("time_ms")).first()[0]
    angle = np.arange(ANGLES) * 360.0 / ANGLES
    radius = np.linspace(radii["low"] or 0.0, radii["high"] or 1.0, RADII)
    time = np.linspace(times["low"] or 0.0, times["high"] or 1.0, TIMES)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights: dict[tuple, np.ndarray] = {}
        for batch in batches:
            rows, ok = np.zeros((batch.num_rows, WIDTH), np.float32), np.ones(batch.num_rows, bool)
            values = {c: _lists(batch[c]) for c in ("center", "surround", "in_out", "radius_um", "time_ms", "v")}
            turn = [None if y is None else np.arange(len(y)) * 360.0 / max(1, len(y)) for y in values["center"]], [None if y is None else np.arange(len(y)) * 360.0 / max(1, len(y)) for y in values["surround"]]
            for k, (xs, ys, points, period) in enumerate(((turn[0], values["center"], angle, 360.0), (turn[1], values["surround"], angle, 360.0), (values["radius_um"], values["in_out"], radius, None), (values["time_ms"], values["v"], time, None))):
                rows[:, _PARTS[k] : _PARTS[k + 1]], good = curves_of(xs, ys, points, period, weights)
                ok &= good
            yield pa.RecordBatch.from_arrays([batch["outline_id"].filter(pa.array(ok)), pa.ListArray.from_arrays(pa.array(np.arange(ok.sum() + 1) * WIDTH, pa.int32()), pa.array(rows[ok].ravel()))], ["outline_id", "vec"])

    joined = cells.join(paths, key).select("outline_id", "center", "surround", "in_out", "radius_um", "time_ms", "v")
    return joined.mapInArrow(read, "outline_id bigint, vec array<float>")


def unit(sums: np.ndarray) -> np.ndarray:
    """Rows scaled to length one in each curve."""
    lengths = np.sqrt(correlations(sums, sums))
    return sums / np.repeat(np.maximum(lengths, 1e-12), np.diff(_PARTS), axis=1)


def unit_row(total: np.ndarray) -> np.ndarray:
    """The same for one row."""
    return total / np.repeat(np.maximum(np.sqrt(np.add.reduceat(total * total, _STARTS)), 1e-12), np.diff(_PARTS))


def correlations(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The four correlations of rows of length one, row by row."""
    return np.stack([np.einsum("ij,ij->i", rows[:, a:b], to[:, a:b]) for a, b in zip(_PARTS, _PARTS[1:])], axis=1)


def alikeness(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """The smallest of the four correlations, row by row."""
    return correlations(rows, to).min(axis=1)


class _Node:
    __slots__ = ("centres", "children", "counts", "ids", "sums", "used")

    def __init__(self, branch: int, leaf: bool):
        self.sums, self.centres = np.zeros((branch + 1, WIDTH)), np.zeros((branch + 1, WIDTH))
        self.counts, self.ids, self.used = np.zeros(branch + 1, np.int64), np.zeros(branch + 1, np.int64), 0
        self.children: list[_Node] | None = None if leaf else []

    def put(self, total: np.ndarray, count: int, number: int, child: _Node | None = None) -> None:
        i = self.used
        self.sums[i], self.counts[i], self.ids[i], self.used = total, count, number, i + 1
        self.centres[i] = unit_row(total)
        if child is not None:
            self.children.append(child)

    def grow(self, i: int, total: np.ndarray, count: int) -> None:
        """Adds to an entry; the centre of a large one, which a single cell hardly moves, is brought up to date now and then."""
        self.sums[i] += total
        before = int(self.counts[i])
        self.counts[i] += count
        step = before >> 4
        if not step or (before + count) // step != before // step:
            self.centres[i] = unit_row(self.sums[i])


class FeatureTree:
    """A cluster-feature tree: summaries (count, linear sum) that can be inserted into another tree."""

    def __init__(self, tight: float = 0.95, branch: int = 24):
        self.tight, self.branch, self.entries, self.root = tight, branch, 0, _Node(branch, True)

    def insert(self, total: np.ndarray, count: int = 1) -> int:
        """Adds a summary; returns the number of the leaf entry that took it."""
        point, node, path = unit_row(total), self.root, []
        while True:
            i = int(np.argmax(node.centres[: node.used] @ point)) if node.used else -1
            if node.children is None:
                break
            node.grow(i, total, count)
            path.append((node, i))
            node = node.children[i]
        if i >= 0 and np.add.reduceat(node.centres[i] * point, _STARTS).min() >= self.tight:
            node.grow(i, total, count)
            return int(node.ids[i])
        number = self.entries
        self.entries += 1
        node.put(total, count, number)
        while node.used > self.branch:
            halves = self._split(node)
            if not path:
                self.root = _Node(self.branch, False)
                for half in halves:
                    self.root.put(half.sums[: half.used].sum(0), int(half.counts.sum()), -1, half)
                break
            node, i = path.pop()
            for at, half in zip((i, node.used), halves):
                if at == node.used:
                    node.put(half.sums[: half.used].sum(0), int(half.counts.sum()), -1, half)
                else:
                    node.children[at] = half
                    node.sums[at], node.counts[at] = half.sums[: half.used].sum(0), half.counts.sum()
                    node.centres[at] = unit(node.sums[at : at + 1])[0]
        return number

    def _split(self, node: _Node) -> tuple[_Node, _Node]:
        near = node.centres[: node.used] @ node.centres[: node.used].T
        a, b = divmod(int(np.argmin(near)), node.used)
        first = near[a] >= near[b]
        if first.all() or not first.any():
            first = np.arange(node.used) < node.used // 2
        halves = _Node(self.branch, node.children is None), _Node(self.branch, node.children is None)
        for i in range(node.used):
            half = halves[0 if first[i] else 1]
            half.put(node.sums[i], int(node.counts[i]), int(node.ids[i]), node.children[i] if node.children is not None else None)
        return halves

    def leaves(self) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) in the order of the entries' numbers."""
        counts, sums = np.zeros(self.entries, np.int64), np.zeros((self.entries, WIDTH))
        waiting = [self.root]
        while waiting:
            node = waiting.pop()
            if node.children is not None:
                waiting += node.children
            else:
                counts[node.ids[: node.used]], sums[node.ids[: node.used]] = node.counts[: node.used], node.sums[: node.used]
        return counts, sums

    def order(self) -> np.ndarray:
        """The entries' numbers from one end of the tree to the other: neighbours are alike."""
        found, waiting = [], [self.root]
        while waiting:
            node = waiting.pop()
            if node.children is not None:
                waiting += node.children
            else:
                found.append(node.ids[: node.used])
        return np.concatenate(found)

    def top(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(counts, sums) of the lowest level with at most ``most`` entries."""
        level = [self.root]
        while level[0].children is not None:
            below = [child for node in level for child in node.children]
            if sum(n.used for n in below) > most:
                break
            level = below
        return np.concatenate([n.counts[: n.used] for n in level]), np.concatenate([n.sums[: n.used] for n in level])


_CF = "kind string, leaf bigint, outline_id bigint, n bigint, vec array<float>"


def _cf_batch(kind: str, leaf: np.ndarray, ids: np.ndarray, counts: np.ndarray, vectors: np.ndarray) -> pa.RecordBatch:
    flat = pa.array(vectors.astype(np.float32).ravel())
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaf) + 1) * WIDTH, pa.int32()), flat)
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(leaf), pa.string()), pa.array(leaf, pa.int64()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64()), lists], ["kind", "leaf", "outline_id", "n", "vec"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), WIDTH).astype(float)


def feature_trees(cells: DataFrame, tight: float = 0.95, roots: int = 128) -> DataFrame:
    """Members, leaf entries and upper entries of one cluster-feature tree per partition."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, base = FeatureTree(tight), TaskContext.get().partitionId() << 32
        for batch in batches:
            if batch.num_rows:
                vectors = _matrix(batch["vec"])
                leaf = np.array([tree.insert(v) for v in vectors], np.int64) + base
                yield _cf_batch("member", leaf, batch["outline_id"].to_numpy(), np.ones(len(leaf), np.int64), vectors)
        if tree.entries:
            counts, sums = tree.leaves()
            numbers = np.arange(len(counts))
            yield _cf_batch("leaf", numbers + base, numbers, counts, sums)
            counts, sums = tree.top(roots)
            yield _cf_batch("root", np.arange(len(counts)) + base, np.arange(len(counts)), counts, sums)

    return cells.mapInArrow(build, _CF)


def pivots(roots: DataFrame, max_pivots: int) -> np.ndarray:
    """At most ``max_pivots`` unit vectors: upper tree entries, reduced group by group until few enough."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = FeatureTree(tight=0.98, branch=max(2, min(24, max_pivots)))
        for batch in batches:
            for v, n in zip(_matrix(batch["vec"]), batch["n"].to_pylist()):
                tree.insert(v, n)
        if tree.entries:
            counts, sums = tree.top(max_pivots)
            yield _cf_batch("root", np.arange(len(counts)), np.arange(len(counts)), counts, sums)

    rows = roots
    while (count := rows.count()) > max_pivots:
        rows = written(rows.repartition(max(1, count // (4 * max_pivots))).mapInArrow(reduce, _CF), "roots")
        if count <= 4 * max_pivots:
            break
    found = rows.select("vec").limit(4 * max_pivots).toArrow()["vec"].combine_chunks()
    return unit(_matrix(found))


def _near_pairs(centres: np.ndarray, alike: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs i < j with alike centres, by blocks of rows."""
    for start in range(0, len(centres), 512):
        block = centres[start : start + 512]
        near = np.minimum.reduce([block[:, a:b] @ centres[:, a:b].T for a, b in zip(_PARTS, _PARTS[1:])])
        i, j = np.nonzero(near >= alike)
        later = j > i + start
        yield i[later] + start, j[later]


def _ward(counts: np.ndarray, sums: np.ndarray, alike: float) -> np.ndarray:
    """Group of each entry by Ward's criterion, as long as the centroids stay alike."""
    n, total = list(counts), list(sums)
    alive, parent = [True] * len(n), list(range(len(n)))

    def cost(i: int, j: int) -> float:
        return n[i] * n[j] / (n[i] + n[j]) * float(((total[i] / n[i] - total[j] / n[j]) ** 2).sum())

    heap = [(cost(i, j), i, j) for rows, columns in _near_pairs(unit(sums), alike) for i, j in zip(rows.tolist(), columns.tolist())]
    heapify(heap)
    while heap:
        _, i, j = heappop(heap)
        if not (alive[i] and alive[j]):
            continue
        k = len(n)
        n.append(n[i] + n[j])
        total.append(total[i] + total[j])
        alive[i] = alive[j] = False
        alive.append(True)
        parent.append(k)
        parent[i] = parent[j] = k
        others = np.array([o for o in range(k) if alive[o]], np.int64)
        if len(others):
            new = unit(total[k][None])
            fits = alikeness(unit(np.array([total[o] for o in others])), new) >= alike
            for o in others[fits]:
                heappush(heap, (cost(int(o), k), int(o), k))
    roots = []
    for i in range(len(counts)):
        while parent[i] != i:
            i = parent[i]
        roots.append(i)
    return np.unique(np.array(roots, np.int64), return_inverse=True)[1]


def ward_groups(counts: np.ndarray, sums: np.ndarray, alike: float = ALIKE, tight: float = 0.95, most: int = _WARD) -> np.ndarray:
    """Group number of each leaf: a merged tree first, then Ward's criterion while centroids stay alike.

    More than ``most`` entries are merged by parts of that size, in the order
    of the tree, and their groups, which are summaries again, until no part
    merges any more; only then all that are left are compared.
    """
    tree = FeatureTree(tight)
    group = np.array([tree.insert(s, int(n)) for s, n in zip(sums, counts)])
    n, total = tree.leaves()
    number = np.arange(len(n))
    order = tree.order()
    while len(n) > most:
        parts = np.empty(len(n), np.int64)
        done = 0
        for start in range(0, len(order), most):
            own = order[start : start + most]
            found = _ward(n[own], total[own], alike)
            parts[own] = found + done
            done += int(found.max()) + 1
        if done == len(n):
            break
        order = parts[order][np.sort(np.unique(parts[order], return_index=True)[1])]
        number = parts[number]
        n, total = np.bincount(parts, weights=n).astype(np.int64), np.stack([np.bincount(parts, weights=column, minlength=done) for column in total.T], axis=1)
    return _ward(n, total, alike)[number][group]


def _route(leaves: DataFrame, points: np.ndarray) -> DataFrame:
    """leaf, n, vec, regions: for each curve the two nearest pivots."""
    shared = leaves.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                rows, to = unit(_matrix(batch["vec"])), shared.value
                two = [np.argsort(-(rows[:, a:b] @ to[:, a:b].T), axis=1)[:, :2] for a, b in zip(_PARTS, _PARTS[1:])]
                near = np.stack([np.repeat(t, 2, axis=1)[:, :2] if t.shape[1] < 2 else t for t in two], axis=1)
                yield pa.RecordBatch.from_arrays([batch["leaf"], batch["n"], batch["vec"], pa.array(near.tolist(), pa.list_(pa.list_(pa.int32())))], ["leaf", "n", "vec", "near"])

    return leaves.mapInArrow(run, "leaf bigint, n bigint, vec array<float>, near array<array<int>>")


def _regions(routed: DataFrame, most: int) -> DataFrame:
    """leaf, n, vec, region: crowded regions are divided by the pivots of the next curves."""
    rows = routed.select("leaf", "n", "vec", "near", F.posexplode("near").alias("curve", "two")).select("leaf", "n", "vec", "near", "curve", F.explode(F.array_distinct("two")).alias("pivot"))
    rows = rows.withColumn("region", F.concat_ws(".", "curve", "pivot"))
    done = None
    for depth in range(1, CURVES):
        crowded = rows.groupBy("region").count().where(F.col("count") > most).select("region", F.lit(True).alias("crowded"))
        if not crowded.take(1):
            break
        marked = written(rows.join(crowded, "region", "left"), "regions")
        calm = marked.where("crowded is null").drop("crowded")
        done = calm if done is None else done.unionByName(calm)
        deeper = F.array_distinct(F.get("near", F.pmod(F.col("curve") + depth, F.lit(CURVES))))
        rows = marked.where("crowded").drop("crowded").withColumn("next", F.explode(deeper)).withColumn("region", F.concat_ws(".", "region", "next")).drop("next")
    rows = rows if done is None else done.unionByName(rows)
    return rows.select("leaf", "n", "vec", "region")


def _agglomerate(rows: DataFrame) -> DataFrame:
    """leaf, part: leaves of one region that belong together share the part (only parts of two or more)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[object, list] = (None, [])

        def finish() -> pa.RecordBatch:
            leaf, n, vec = (np.concatenate([p[i] for p in held[1]]) for i in range(3))
            group = ward_groups(n, vec)
            _, inverse, size = np.unique(group, return_inverse=True, return_counts=True)
            least = np.full(len(size), np.iinfo(np.int64).max)
            np.minimum.at(least, inverse, leaf)
            keep = size[inverse] > 1
            return pa.RecordBatch.from_arrays([pa.array(leaf[keep]), pa.array([f"{held[0]}:{x}" for x in least[inverse][keep]], pa.string())], ["leaf", "part"])

        for batch in batches:
            regions = np.array(batch["region"].to_pylist(), object)
            cuts = [0, *(np.nonzero(regions[1:] != regions[:-1])[0] + 1).tolist(), len(regions)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if regions[a] != held[0]:
                    if held[1]:
                        yield finish()
                    held = (regions[a], [])
                part = batch.slice(a, b - a)
                held[1].append((part["leaf"].to_numpy(), part["n"].to_numpy(), _matrix(part["vec"])))
        if held[1]:
            yield finish()

    sorted_rows = rows.repartition("region").sortWithinPartitions("region", "leaf")
    return sorted_rows.mapInArrow(run, "leaf bigint, part string")


def _united(parts: DataFrame) -> DataFrame:
    """leaf, cluster (its smallest leaf) of leaves linked through common parts."""
    links = written(parts, "parts")
    labels = links.groupBy("leaf").agg(F.min("leaf").alias("cluster"))
    total = None
    while True:
        named = links.join(labels, "leaf")
        by_part = named.groupBy("part").agg(F.min("cluster").alias("cluster"))
        labels = written(links.join(by_part, "part").groupBy("leaf").agg(F.min("cluster").alias("cluster")), "labels")
        now = labels.agg(F.sum(F.col("cluster").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels
        total = now


def _centroids(leaves: DataFrame) -> DataFrame:
    """cluster, members, vec (sum of its leaves)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        batch_of = lambda c, n, v: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()), pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(np.arange(len(c) + 1) * WIDTH, pa.int32()), pa.array(v.astype(np.float32).ravel()))], ["cluster", "members", "vec"])
        for batch in batches:
            if not batch.num_rows:
                continue
            cluster, n, vec = batch["cluster"].to_numpy(), batch["n"].to_numpy(), _matrix(batch["vec"])
            if held is not None:
                cluster, n, vec = np.append(held[0], cluster), np.append(held[1], n), np.vstack([held[2], vec])
            start = np.nonzero(np.diff(cluster, prepend=cluster[0] - 1))[0]
            cluster, n, vec = cluster[start], np.add.reduceat(n, start), np.add.reduceat(vec, start, axis=0)
            held = cluster[-1:], n[-1:], vec[-1:]
            yield batch_of(cluster[:-1], n[:-1], vec[:-1])
        if held is not None:
            yield batch_of(*held)

    return leaves.repartition("cluster").sortWithinPartitions("cluster").mapInArrow(run, "cluster bigint, members bigint, vec array<float>")


def _measured(assigned: DataFrame) -> DataFrame:
    """cluster, outline_id, total (sum of the correlations with the centroid ``other``), angle (the widest of the four)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                each = correlations(unit(_matrix(batch["vec"])), unit(_matrix(batch["other"])))
                # a little wider than computed: what is alike for sure must be so in spite of rounding
                angle = np.arccos(np.clip(each.min(1), -1.0, 1.0)) + 1e-5
                yield pa.RecordBatch.from_arrays([batch["cluster"], batch["outline_id"], pa.array(each.sum(1)), pa.array(angle)], ["cluster", "outline_id", "total", "angle"])

    return assigned.mapInArrow(run, "cluster bigint, outline_id bigint, total double, angle double")


def _unlike(pair: pa.Table, alike: float) -> pa.Table:
    """cluster, outline_id, with_id of the unlike cells of two blocks (side 0 and 1; or of one, side 0)."""
    side, ids = pair["side"].to_numpy(), pair["outline_id"].to_numpy()
    rows = unit(_matrix(pair["vec"].combine_chunks()))
    left = np.nonzero(side == 0)[0]
    right = np.nonzero(side == 1)[0] if (side == 1).any() else left
    near = np.minimum.reduce([rows[left, a:b] @ rows[right, a:b].T for a, b in zip(_PARTS, _PARTS[1:])])
    i, j = np.nonzero(near < alike)
    one, other = ids[left[i]], ids[right[j]]
    if right is left:
        one, other = one[i < j], other[i < j]
    return pa.table({"cluster": pa.array(np.full(len(one), pair["cluster"][0].as_py()), pa.int64()), "outline_id": pa.array(one), "with_id": pa.array(other)})


def compared(assigned: DataFrame, measured: DataFrame, alike: float) -> DataFrame:
    """cluster, outline_id, with_id of all pairs of unlike cells in a cluster, each once."""
    limit = float(np.arccos(alike))
    step = limit / _CLASSES
    widest = measured.groupBy("cluster").agg(F.max("angle").alias("widest"))
    asked = measured.join(widest, "cluster").where(F.col("angle") + F.col("widest") > limit).withColumn("class", F.floor(F.col("angle") / step).cast("int"))
    sizes = asked.groupBy("cluster", "class").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / _BLOCK))
    blocks = sizes.select("cluster", "class", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part"))
    one, other = (blocks.select("cluster", F.struct("class", "part").alias(name)) for name in ("one", "other"))
    # upper ends of the classes: two blocks below the limit together hold no unlike cells
    pairs = one.join(other, "cluster").where((F.col("one") >= F.col("other")) & ((F.col("one.class") + F.col("other.class") + 2) * step > limit))
    ends = F.when(F.col("one") == F.col("other"), F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("block")))).otherwise(F.array(F.struct(F.lit(0).alias("side"), F.col("one").alias("block")), F.struct(F.lit(1).alias("side"), F.col("other").alias("block"))))
    needed = pairs.select("cluster", "one", "other", F.inline(ends))
    own = asked.join(sizes.select("cluster", "class", "parts"), ["cluster", "class"]).select("cluster", "outline_id", F.struct("class", F.pmod(F.xxhash64("outline_id"), F.col("parts")).alias("part")).alias("block"))
    cells = own.join(assigned.select("outline_id", "vec"), "outline_id").join(needed, ["cluster", "block"])
    return cells.groupBy("cluster", "one", "other").applyInArrow(lambda pair: _unlike(pair, alike), "cluster bigint, outline_id bigint, with_id bigint")


def _parted(unlike: DataFrame) -> DataFrame:
    """outline_id, part of every cell with an unlike cell above it: the first part without such a cell.

    ``unlike``: cluster, total, outline_id, above (the higher-ranked cell); cells
    that have none above are in part 0. In rank order, so a cell gives way only
    to cells that stay in that part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cluster, parts = None, {}
        cell, taken = None, set()

        def settled() -> None:
            if cell is not None:
                parts[cell] = next(p for p in range(len(taken) + 1) if p not in taken)

        def settled_batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(parts), pa.int64()), pa.array(list(parts.values()), pa.int32())], ["outline_id", "part"])

        for batch in batches:
            for c, i, above in zip(*(batch[name].to_pylist() for name in ("cluster", "outline_id", "above"))):
                if c != cluster or i != cell:
                    settled()
                    if c != cluster and parts:
                        yield settled_batch()
                    cluster, parts = c, parts if c == cluster else {}
                    cell, taken = i, set()
                taken.add(parts.get(above, 0))
        settled()
        if parts:
            yield settled_batch()

    rows = unlike.repartition("cluster").sortWithinPartitions("cluster", F.desc("total"), "outline_id")
    return rows.mapInArrow(run, "outline_id bigint, part int")


_FOUND = "cluster bigint, outline_id bigint, typicality double"


def _round(cells: DataFrame, alike: float, max_pivots: int | None, region_leaves: int) -> tuple[DataFrame | None, bool]:
    """(cluster, outline_id, typicality of what was found, whether the rest has to be clustered again); None where there is nothing."""
    trees = written(feature_trees(cells), "trees")
    roots = trees.where("kind = 'root'")
    leaves = trees.where("kind = 'leaf'").select("leaf", "n", "vec")
    count = leaves.count()
    if not count:
        return None, False
    if max_pivots is None:
        max_pivots = max(1024, min(16_384, count // 100))
    labels = _united(_agglomerate(_regions(_route(leaves, pivots(roots, max_pivots)), region_leaves)))
    named = leaves.join(labels, "leaf", "left").withColumn("cluster", F.coalesce("cluster", "leaf"))
    sums = written(_centroids(named.select("cluster", "n", "vec")).where("members > 1"), "centroids")
    members = trees.where("kind = 'member'").select("leaf", "outline_id", "vec").join(labels, "leaf", "left").withColumn("cluster", F.coalesce("cluster", "leaf"))
    assigned = written(members.join(sums.select("cluster", F.col("vec").alias("other")), "cluster").select("cluster", "outline_id", "vec", "other"), "assigned")
    measured = written(_measured(assigned), "measured")
    unlike = written(compared(assigned, measured, alike), "unlike")
    if not unlike.take(1):
        fitting = measured.withColumn("part", F.lit(0))
    else:
        rank = measured.select("outline_id", "total")
        judged = unlike.join(rank, "outline_id").join(rank.select(F.col("outline_id").alias("with_id"), F.col("total").alias("with_total")), "with_id")
        ends = [F.struct(F.col("total"), (-F.col("outline_id")).alias("by"), F.col("outline_id").alias("id")), F.struct(F.col("with_total").alias("total"), (-F.col("with_id")).alias("by"), F.col("with_id").alias("id"))]
        ranked = judged.select("cluster", F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))
        parts = _parted(ranked.select("cluster", F.col("low.total").alias("total"), F.col("low.id").alias("outline_id"), F.col("high.id").alias("above")).distinct())
        fitting = written(measured.join(parts, "outline_id", "left").select("cluster", "outline_id", "total", F.coalesce("part", F.lit(0)).alias("part")), "fitting")
    sizes = fitting.groupBy("cluster", "part").agg(F.min("outline_id").alias("smallest"), F.count("*").alias("size"))
    # the first part of two or more stays (if any two cells of the cluster are alike, there is one)
    ids = sizes.where("size > 1").groupBy("cluster").agg(F.min_by(F.struct("part", "smallest"), "part").alias("kept")).select("cluster", "kept.*")
    found = fitting.join(ids, ["cluster", "part"]).select(F.col("smallest").alias("cluster"), "outline_id", (F.col("total") / CURVES).alias("typicality"))
    return found, bool(fitting.where("part > 0").take(1))


def clusters(cells: DataFrame, alike: float = ALIKE, max_pivots: int | None = None, region_leaves: int = 1500) -> DataFrame:
    """cluster, outline_id, typicality of every cell in a cluster of two or more (cluster: its smallest outline_id).

    Where cells of a cluster are unlike, it is parted by rank (``_parted``); one
    part of two or more stays, and all cells without a cluster are clustered again,
    until all fit or none is found. Each round is written and keeps at least two
    cells, so it ends. Pivots (at most ``max_pivots``) grow with the leaves, from
    1,024 up to 16,384.
    """
    spark = cells.sparkSession
    root, number = scratch(spark, "clusters"), 0
    while True:
        found, again = _round(cells, alike, max_pivots, region_leaves)
        if found is None:
            break
        found.write.parquet(f"{root}/round={number}")
        here = spark.read.schema(_FOUND).parquet(f"{root}/round={number}")
        if not again or not here.take(1):
            break
        # whoever is in no cluster, single cells too, is compared again
        cells, number = written(cells.join(here.select("outline_id"), "outline_id", "left_anti"), "again"), number + 1
    if found is None and not number:
        return spark.createDataFrame([], _FOUND)
    return spark.read.schema(_FOUND).parquet(*[f"{root}/round={i}" for i in range(number + (found is not None))])


def described(found: DataFrame, typical: int = 3) -> DataFrame:
    """cluster, size, rank, outline_id, typicality of each cluster's most typical cells."""
    sizes = found.groupBy("cluster").agg(F.count("*").alias("size"))
    order = Window.partitionBy("cluster").orderBy(F.desc("typicality"), "outline_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= typical).join(sizes, "cluster").select("cluster", "size", "rank", "outline_id", "typicality")
