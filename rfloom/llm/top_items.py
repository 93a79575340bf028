"""The N best items of every group, exactly, with a fixed tie rule.

A histogram of the scores per group (bins are a monotone function of the score,
so no range needs to be known) gives each group a bin from which upwards at
least N distinct items lie. Rows below it are dropped before anything is
sorted; the survivors are ranked by score, then by the tie key.

Repeated rows are combined map-side first, so the counts are counts of items.
The thresholds are joined, not assumed small: Spark broadcasts them only below
its size limit and else splits skewed groups. Even if all items of a huge
group tie, each task passes on N rows at most (the rank limit works map-side).

Defined results: rows with a null item or a null, NaN or infinite score don't
count; of a repeated item the best score counts; null groups are groups;
-0.0 equals 0.0; n < 1 or an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rfloom.tables import finite, join_same

#: Bins per doubling of the score; with the widest double exponent the index stays below _TOP.
_STEPS, _TOP = 8, 10_000


def score_bin(score: Column) -> Column:
    """Monotone bin of a finite double: logarithmic on both sides of zero."""
    size = (F.floor(F.log2(F.abs(score)) * _STEPS) + _TOP).cast("int")
    return F.when(score > 0, size).when(score < 0, -size).otherwise(0)


def distinct_items(rows: DataFrame, groups: list[str], item: str, score: str) -> DataFrame:
    value = F.col(score).cast("double") + F.lit(0.0)
    usable = rows.where(finite(F.col(score)) & F.col(item).isNotNull())
    return usable.groupBy(*groups, item).agg(F.max(value).alias("_score"))


def thresholds(items: DataFrame, groups: list[str], n: int) -> DataFrame:
    """The highest bin of each group from which upwards it has at least n items (the lowest bin if it has fewer)."""
    histogram = items.groupBy(*groups, score_bin(F.col("_score")).alias("_bin")).agg(F.count("*").alias("_count"))
    above = F.sum("_count").over(Window.partitionBy(*groups).orderBy(F.desc("_bin")))
    reached = histogram.withColumn("_above", above)
    enough = F.max(F.when(F.col("_above") >= n, F.col("_bin")))
    return reached.groupBy(*groups).agg(F.coalesce(enough, F.min("_bin")).alias("_least"))


def top_items(rows: DataFrame, groups: list[str], item: str, score: str, n: int) -> DataFrame:
    """groups, item, score, rank (1..n) of the n best items of each group."""
    items = distinct_items(rows, groups, item, score)
    least = thresholds(items, groups, n)
    reaching = join_same(items, least, groups).where(score_bin(F.col("_score")) >= F.col("_least"))
    survivors = reaching.select(*groups, item, F.col("_score").alias(score))
    rank = F.row_number().over(Window.partitionBy(*groups).orderBy(F.desc(score), F.asc(item)))
    return survivors.withColumn("rank", rank).where(F.col("rank") <= n)
