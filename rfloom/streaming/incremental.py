"""New files of readings as they arrive: the regular grid of the sources they touch is brought up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from rfloom.operators.regular_grid import regular_grid


def keep_grid(spark: SparkSession, incoming: str, schema: str, store: str, grid: str, checkpoint: str, keys: list[str], time: str, value: str, step: str, buckets: int = 16) -> StreamingQuery:
    """Writes each batch to its own folder of ``store`` (by bucket of the source) and rewrites the grid's touched buckets only.

    A batch that is delivered again after a failure replaces its folder, so it
    is never stored twice; buckets are replaced as a whole.
    """

    def apply(batch: DataFrame, number: int) -> None:
        bucketed = batch.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist()
        touched = [r[0] for r in bucketed.select("bucket").distinct().collect()]
        if touched:
            bucketed.write.mode("overwrite").partitionBy("bucket").parquet(f"{store}/batch={number}")
            rows = batch.sparkSession.read.schema(StructType([*bucketed.schema, StructField("batch", LongType())])).parquet(store).where(F.col("bucket").isin(touched))
            fresh = regular_grid(rows, keys, time, value, step).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))
            fresh.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(grid)
        bucketed.unpersist()

    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(spark: SparkSession, incoming: str, schema: str, time: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Streaming count per kind and window; readings later than ``late`` are left out by the watermark."""
    stream = spark.readStream.schema(schema).parquet(incoming)
    return stream.withWatermark(time, late).groupBy(F.window(time, width), kind).agg(F.count("*").alias("n"))
