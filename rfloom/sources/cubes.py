"""Image stacks stored as .npy files, read where they lie; null or broken files are reported, not fatal."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, recording string, channel string, cell_index int, shape array<int>, data array<float>, problem string"


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(batch.num_rows):
            row = batch.slice(start, 1)
            shape, data, problem = None, None, None
            try:
                cube = np.load(io.BytesIO(row["content"][0].as_py()), allow_pickle=False)
                if cube.ndim == 3:
                    shape, data = list(cube.shape), cube.astype(np.float32).ravel()
                else:
                    problem = f"{cube.ndim} dimensions instead of 3"
            except (ValueError, EOFError, OSError, TypeError) as error:
                problem = str(error)[:200]
            yield pa.RecordBatch.from_arrays(
                [row["path"], row["recording"], row["channel"], row["cell_index"], pa.array([shape], pa.list_(pa.int32())), pa.array([data], pa.list_(pa.float32())), pa.array([problem], pa.string())],
                [c.split()[0] for c in _SCHEMA.split(", ")],
            )


def read_cubes(spark: SparkSession, root: str, name: str = "kernel.npy") -> DataFrame:
    """One tensor row per ``<recording>/<channel>/cell_<i>/<name>`` below ``root``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(root)
    part = lambda i: F.regexp_extract("path", r"([^/]+)/([^/]+)/cell_([0-9]+)/[^/]+$", i)
    named = files.select("path", "content", part(1).alias("recording"), part(2).alias("channel"), F.nullif(part(3), F.lit("")).cast("int").alias("cell_index"))
    return named.mapInArrow(_decode, _SCHEMA)


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None, bytes_per_row: int = 1024, file_bytes: int = 128 << 20) -> None:
    """Parquet with zstd; files of about ``file_bytes``, partitions written by dynamic overwrite."""
    writer = df.write.mode("overwrite").option("compression", "zstd").option("maxRecordsPerFile", max(1, file_bytes // bytes_per_row))
    if partition_by:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def upsert(spark: SparkSession, old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with its rows replaced by those of ``new`` with the same keys, and the others added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def to_labelled_json(dims: Column, coords: Column, data: Column, name: Column) -> Column:
    """A labelled array as JSON text; null data stay null."""
    return F.when(data.isNotNull(), F.to_json(F.struct(dims.alias("dims"), coords.alias("coords"), data.alias("data"), name.alias("name"))))


LABELLED = "dims array<string>, coords map<string,array<double>>, data array<double>, name string"


def from_labelled_json(text: Column) -> Column:
    return F.from_json(text, LABELLED)
