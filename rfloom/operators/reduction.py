"""Linear algebra over many rows: what is summed is a bounded matrix per group, never the rows themselves."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfloom.operators import kernels
from rfloom.operators.factorisation import usable


def _stacked(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width).astype(float)


def grams(rows: DataFrame, key: str, data: str, width: int) -> DataFrame:
    """key, n, sums array, gram array (width^2): partial sums per batch, combined map-side by position."""
    kept = usable(rows, data, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[object, np.ndarray] = {}
        for batch in batches:
            x, names = _stacked(batch[data], width), np.array(batch[key].to_pylist(), object)
            x = np.hstack([np.ones((len(x), 1)), x])
            for name in set(names.tolist()):
                own = x[np.array([n == name for n in names], bool)]
                parts[name] = parts.get(name, 0) + own.T @ own
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(list(parts), batch[key].type), pa.array([m.ravel().tolist() for m in parts.values()], pa.list_(pa.float64()))], [key, "m"])

    kind = rows.schema[key].dataType.simpleString()
    partial = kept.select(key, data).mapInArrow(run, f"{key} {kind}, m array<double>")
    summed = partial.select(key, F.posexplode("m").alias("at", "v")).groupBy(key, "at").agg(F.sum("v").alias("v"))
    return summed.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda p: p["v"]).alias("m"))


def _covariance(m: np.ndarray, width: int) -> tuple[float, np.ndarray, np.ndarray]:
    m = m.reshape(width + 1, width + 1)
    n, mean = m[0, 0], m[0, 1:] / m[0, 0]
    return n, mean, (m[1:, 1:] - n * np.outer(mean, mean)) / max(n - 1, 1)


def dominant_pixels(rows: DataFrame, key: str, data: str, width: int) -> DataFrame:
    """key, pixel: where the leading right singular vector of the centred rows is largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [kernels.dominant_pixel(_covariance(np.array(m), width)[2]) for m in batch["m"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch[key], pa.array(found, pa.int32())], [key, "pixel"])

    return grams(rows, key, data, width).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, pixel int")


def covariance_edges(rows: DataFrame, key: str, data: str, width: int, threshold: float) -> DataFrame:
    """key, p, q, weight: pixel pairs p < q of a cell whose covariance is larger than the threshold. The matrix stays in the task; only its large entries come out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, m in enumerate(batch["m"].to_pylist()):
                p, q, weight = kernels.covariance_edges(_covariance(np.array(m), width)[2], threshold)
                yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(np.full(len(p), i))), pa.array(p, pa.int32()), pa.array(q, pa.int32()), pa.array(weight)], [key, "p", "q", "weight"])

    return grams(rows, key, data, width).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, p int, q int, weight double")


def column_leaders(rows: DataFrame, key: str, data: str, width: int) -> DataFrame:
    """key, p, n: how often each pixel leads a column of the cell's covariance matrix above the diagonal."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, m in enumerate(batch["m"].to_pylist()):
                p, n = kernels.column_leaders(_covariance(np.array(m), width)[2])
                yield pa.RecordBatch.from_arrays([batch[key].take(pa.array(np.full(len(p), i))), pa.array(p, pa.int32()), pa.array(n, pa.int64())], [key, "p", "n"])

    return grams(rows, key, data, width).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, p int, n bigint")


def explained(rows: DataFrame, key: str, data: str, width: int, most: int) -> DataFrame:
    """key, component, variance, ratio of the principal components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, numbers, variances, ratios = [], [], [], []
            for name, m in zip(batch[key].to_pylist(), batch["m"].to_pylist()):
                cov = _covariance(np.array(m), width)[2]
                values, _ = kernels.principal_axes(cov, most)
                names += [name] * len(values)
                numbers += range(len(values))
                variances += values.tolist()
                ratios += (values / max(np.trace(cov), 1e-300)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(names, batch[key].type), pa.array(numbers, pa.int32()), pa.array(variances), pa.array(ratios)], [key, "component", "variance", "ratio"])

    return grams(rows, key, data, width).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, component int, variance double, ratio double")


def projected(rows: DataFrame, keep: list[str], data: str, width: int, most: int, whiten: bool = True) -> DataFrame:
    """keep, scores: every row on the principal axes of all rows (one bounded matrix reaches the driver)."""
    gram = grams(rows.withColumn("_all", F.lit(0)), "_all", data, width).first()
    if gram is None:
        return rows.select(*keep, F.array().cast("array<double>").alias("scores"))
    _, mean, cov = _covariance(np.array(gram["m"]), width)
    values, axes = kernels.principal_axes(cov, most)
    axes = axes / np.sqrt(np.maximum(values, 1e-300))[:, None] if whiten else axes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = (_stacked(batch[data], width) - mean) @ axes.T
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in keep], pa.array(scores.tolist(), pa.list_(pa.float64()))], [*keep, "scores"])

    kept = usable(rows, data, width).select(*keep, data)
    kinds = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return kept.mapInArrow(run, f"{kinds}, scores array<double>")
