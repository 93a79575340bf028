"""Semi-NMF X = W H (H >= 0, W free) of any number of rows, its runs from several starts, multi-view and complex principal components.

All of a factorisation that concerns the rows is W = X B with a small matrix B,
so coordinate updates of W's columns and H's rows need the Gram matrix X'X
only. It is summed where the rows lie; W is one product per row at the end.
Runs from several starts are Spark tasks on that one matrix.

Defined results: rows that are null, of another size or not finite take no
part; without rows H is zero and there are no losses.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfloom.operators import kernels


@dataclass(frozen=True)
class Settings:
    rank: int
    rounds: int = 200
    tol: float = 1e-4  # of the loss, looked at after more than ten rounds
    l1: float = 0.0  # pulls H's entries to zero
    topk: int | None = None  # only the largest entries of a column of H stay
    sharpen: float | None = None  # H to this power
    decorrelate: float = 0.0  # pushes H's rows apart
    scale: str | None = None  # rows of H to length one: 'l2' or 'l1'
    seed: int = 0
    noise: float = 0.0  # random share in the start, for several runs


@dataclass
class Factors:
    h: np.ndarray
    b: np.ndarray  # W = X B
    losses: list[float]


def _start(gram: np.ndarray, how: Settings) -> np.ndarray:
    values, vectors = np.linalg.eigh(gram)
    axes = vectors[:, ::-1][:, : how.rank].T
    axes = axes * np.where(np.abs(axes.min(1)) > axes.max(1), -1.0, 1.0)[:, None]
    h = np.maximum(0, np.sqrt(np.maximum(values[::-1][: how.rank], 0))[:, None] * axes)
    if how.noise:
        h = h + how.noise * h.max(initial=0.0) * np.random.default_rng(how.seed).random(h.shape)
    missing = how.rank - len(h)
    return np.vstack([h, np.zeros((missing, gram.shape[0]))]) if missing > 0 else h


def _apart(h: np.ndarray, how: Settings) -> np.ndarray:
    """H after what keeps its rows from overlapping."""
    if how.topk and how.topk < len(h):
        kept = np.argsort(-h, axis=0, kind="stable")[: how.topk]
        only = np.zeros_like(h)
        np.put_along_axis(only, kept, np.take_along_axis(h, kept, 0), 0)
        h = only
    if how.sharpen and how.sharpen > 1:
        h = h**how.sharpen
    if how.decorrelate:
        overlap = h @ h.T
        np.fill_diagonal(overlap, 0.0)
        h = np.maximum(0, h - 2 * how.decorrelate * overlap @ h)
    return h


def factorised(gram: np.ndarray, how: Settings) -> Factors:
    """Coordinate updates of W's columns and H's rows in turn, on X'X alone."""
    h, tiny = _start(gram, how), 1e-12
    inner = h @ h.T
    b = np.linalg.solve(inner + (1e-6 * np.trace(inner) / how.rank + tiny) * np.eye(how.rank), h).T
    identity, losses = np.eye(len(gram)), []
    for done in range(1, how.rounds + 1):
        for k in range(how.rank):
            others = np.arange(how.rank) != k
            length = float(h[k] @ h[k])
            b[:, k] = (h[k] - b[:, others] @ (h[others] @ h[k])) / (length + tiny)
            pull = gram @ b[:, k]
            weight = float(b[:, k] @ pull)
            h[k] = np.maximum(0, (pull - (b[:, others].T @ pull) @ h[others] - how.l1) / (weight + tiny))
        h = _apart(h, how)
        if how.scale:
            size = (np.linalg.norm(h, axis=1) if how.scale == "l2" else h.sum(1)) + tiny
            h, b = h / size[:, None], b * size
        rest = identity - b @ h
        losses.append(float(np.einsum("ij,ik,kj->", rest, gram, rest, optimize=True)))
        if done > 10 and losses[-2] - losses[-1] < how.tol * (losses[-2] + tiny):
            break
    return Factors(h, b, losses)


def usable(rows: DataFrame, data: str, width: int) -> DataFrame:
    """Rows with ``width`` finite values."""
    return rows.where(F.col(data).isNotNull() & (F.size(data) == width) & ~F.exists(data, lambda v: v.isNull() | ~(F.abs(v.cast("double")) < float("inf"))))


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(float)


def gram_of(rows: DataFrame, data: str, width: int, prepare=None) -> np.ndarray | None:
    """X'X of all usable rows (``prepare`` maps a matrix of rows to real rows first); one matrix per task is added up by Spark, entry by entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = _stacked(batch[data], width)
                x = prepare(x) if prepare else x
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "v"])

    sums = usable(rows, data, width).select(data).mapInArrow(run, "at bigint, v double").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    if not sums.num_rows:
        return None
    flat = np.zeros(sums.num_rows)
    flat[sums["at"].to_numpy()] = sums["v"].to_numpy()
    side = int(round(np.sqrt(len(flat))))
    return flat.reshape(side, side)


def weights_of(rows: DataFrame, keep: list[str], data: str, width: int, b: np.ndarray) -> DataFrame:
    """keep, weights: W's row of every usable row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            w = _stacked(batch[data], width) @ b if batch.num_rows else np.empty((0, b.shape[1]))
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(list(w), pa.list_(pa.float64()))], [*keep, "weights"])

    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return usable(rows, data, width).select(*keep, data).mapInArrow(run, f"{kinds}, weights array<double>")


def runs(rows: DataFrame, data: str, width: int, how: Settings, seeds: int) -> DataFrame:
    """run, rounds, loss, h (array of arrays) of factorisations from ``seeds`` different starts, one task each."""
    spark = rows.sparkSession
    schema = "run bigint, rounds int, loss double, h array<array<double>>"
    gram = gram_of(rows, data, width)
    if gram is None:
        return spark.createDataFrame([], schema)
    shared = spark.sparkContext.broadcast(gram)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch["id"].to_pylist():
                found = factorised(shared.value, replace(how, seed=number))
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(found.losses)], pa.int32()), pa.array([found.losses[-1]]), pa.array([found.h.tolist()], pa.list_(pa.list_(pa.float64())))], ["run", "rounds", "loss", "h"])

    return spark.range(0, seeds, 1, seeds).mapInArrow(run, schema)


def consensus(found: DataFrame) -> DataFrame:
    """p, q, share: in how many of the runs two features (p < q) belong to the same component, the one in which each is largest. As large as H's features squared, which the Gram matrix is too."""
    owner = F.transform("h", lambda row: row)
    features = F.sequence(F.lit(0), F.size(F.get("h", F.lit(0))) - 1)
    best = F.transform(features, lambda i: F.array_position(F.transform(owner, lambda row: F.get(row, i)), F.array_max(F.transform(owner, lambda row: F.get(row, i)))))
    long = found.select("run", F.posexplode(best).alias("feature", "component"))
    one, other = long.select("run", "component", F.col("feature").alias("p")), long.select("run", "component", F.col("feature").alias("q"))
    total = found.count()
    return one.join(other, ["run", "component"]).where("p < q").groupBy("p", "q").agg((F.count("*") / F.lit(max(total, 1))).alias("share"))


def principal(rows: DataFrame, keep: list[str], data: str, width: int, most: int, centred: bool = True, unit: bool = False) -> DataFrame:
    """keep, scores on the leading axes of all rows: centred (principal components) or not (truncated SVD); ``unit``: scaled to length one, zeros stay."""
    gram = gram_of(rows, data, width, lambda x: np.hstack([np.ones((len(x), 1)), x]))
    if gram is None:
        return rows.select(*keep, F.array().cast("array<double>").alias("scores")).limit(0)
    n, mean = gram[0, 0], gram[0, 1:] / gram[0, 0] if centred else np.zeros(width)
    _, axes = kernels.principal_axes(gram[1:, 1:] - n * np.outer(mean, mean), most)
    moved = weights_of(rows.withColumn(data, F.transform(data, lambda v: v.cast("double"))), keep, data, width, axes.T)
    shift = F.array(*[F.lit(float(v)) for v in mean @ axes.T])
    scores = moved.select(*keep, F.zip_with("weights", shift, lambda w, s: w - s).alias("scores"))
    if not unit:
        return scores
    length = F.sqrt(F.aggregate("scores", F.lit(0.0), lambda s, v: s + v * v))
    return scores.withColumn("_l", length).select(*keep, F.transform("scores", lambda v: F.when(F.col("_l") > 0, v / F.col("_l")).otherwise(v)).alias("scores"))


def group_principal(rows: DataFrame, keep: list[str], views: dict[str, int], most: int) -> DataFrame:
    """keep, scores: principal components of each view (column -> width), side by side, and of these again."""
    side = rows
    for number, (view, width) in enumerate(views.items()):
        own = principal(rows, keep, view, width, most).withColumnRenamed("scores", f"view_{number}")
        side = own if number == 0 else side.join(own, keep)
    stacked = side.select(*keep, F.concat(*[F.col(f"view_{i}") for i in range(len(views))]).alias("stacked"))
    return principal(stacked, keep, "stacked", sum(min(most, w) for w in views.values()), most)


def complex_variances(rows: DataFrame, data: str, width: int, most: int) -> DataFrame:
    """component, share: variance of the complex components of all rows' analytic signals, each centred, as shares of the ones kept."""

    def analytic(x: np.ndarray) -> np.ndarray:
        a = kernels.analytic(x.T).T
        a = a - a.mean(1, keepdims=True)
        return np.hstack([a.real, a.imag])

    spark = rows.sparkSession
    gram = gram_of(rows, data, width, analytic)
    if gram is None:
        return spark.createDataFrame([], "component int, share double")
    real = gram[:width, :width] + gram[width:, width:]
    imaginary = gram[:width, width:] - gram[width:, :width]
    values = np.maximum(np.linalg.eigvalsh(real + 1j * imaginary)[::-1][:most], 0)
    return spark.createDataFrame([(k, float(v / max(values.sum(), 1e-300))) for k, v in enumerate(values)], "component int, share double")
