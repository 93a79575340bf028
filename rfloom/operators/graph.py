"""Graphs of pixels: edges between neighbours and connected components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rfloom.operators import kernels
from rfloom.tables import written


def pixel_edges(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """4-neighbour edges (keys, a, b) between pixels (keys, i, y, x), each once."""
    right = pixels.select(*keys, F.col("y").alias("y"), (F.col("x") - 1).alias("x"), F.col("i").alias("b"))
    below = pixels.select(*keys, (F.col("y") - 1).alias("y"), F.col("x").alias("x"), F.col("i").alias("b"))
    return pixels.select(*keys, "y", "x", F.col("i").alias("a")).join(right.unionByName(below), [*keys, "y", "x"]).select(*keys, "a", "b")


def components(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, component (its smallest node). Nodes (keys, node) without edges are components of their own.

    The smallest label spreads along edges; a label's own label is followed in
    the same round, so rounds grow with the logarithm of a component's width.
    Each round is a written table, safe against lost executors.
    """
    both = written(edges.select(*keys, "a", "b").unionByName(edges.select(*keys, F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, before = written(nodes.select(*keys, "node", F.col("node").alias("component")).distinct(), "labels"), None
    while True:
        seen = both.join(labels.select(*keys, F.col("node").alias("b"), "component"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("node")).agg(F.min("component").alias("near"))
        stepped = labels.join(seen, [*keys, "node"], "left").select(*keys, "node", F.least("component", F.coalesce("near", "component")).alias("component"))
        jumped = stepped.join(stepped.select(*keys, F.col("node").alias("component"), F.col("component").alias("further")), [*keys, "component"])
        labels = written(jumped.select(*keys, "node", F.least("component", "further").alias("component")), "labels")
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now


def map_components(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, node, component of the pixels (keys, i, y, x) of each map: a map stands in one row and is labelled there. For graphs wider than a row see ``components``."""

    @F.pandas_udf("array<struct<node:bigint,component:bigint>>")
    def label(maps: pd.Series) -> pd.Series:
        def one(pixels: list) -> list[dict[str, int]]:
            nodes, y, x = (np.array([p[c] for p in pixels], np.int64) for c in ("i", "y", "x"))
            return [{"node": int(n), "component": int(c)} for n, c in zip(nodes, kernels.pixel_components(nodes, y, x))]

        return pd.Series([one(m) for m in maps], dtype=object)

    gathered = pixels.groupBy(*keys).agg(F.collect_set(F.struct("i", "y", "x")).alias("pixels"))
    return gathered.select(*keys, F.inline(label("pixels")))


def largest_component(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of each graph's largest component (the smaller label among equals)."""
    sizes = labelled.groupBy(*keys, "component").agg(F.count("*").alias("size"))
    best = sizes.groupBy(*keys).agg(F.max(F.struct("size", (-F.col("component")).alias("c"))).alias("top")).select(*keys, (-F.col("top.c")).alias("component"))
    return labelled.join(best, [*keys, "component"])
