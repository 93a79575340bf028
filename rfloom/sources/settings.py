"""Settings of recordings and pipelines as JSON tables, and the channels a recording gets."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, folder: str) -> dict[str, object]:
    """Settings by name; a folder without settings has none."""
    try:
        rows = spark.read.schema("name string, value string").json(folder).collect()
    except AnalysisException:
        return {}
    return {r["name"]: json.loads(r["value"]) for r in rows}


def save(spark: SparkSession, folder: str, settings: dict[str, object]) -> None:
    """Replaces all settings of a folder."""
    rows = [(name, json.dumps(value, sort_keys=True)) for name, value in sorted(settings.items())]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(folder)


def put(spark: SparkSession, folder: str, name: str, value: object) -> dict[str, object]:
    """Adds one setting or replaces it; returns all."""
    settings = {**load(spark, folder), name: value}
    save(spark, folder, settings)
    return settings


def add_channels(channels: DataFrame, added: DataFrame) -> DataFrame:
    """``channels`` with the channels of ``added`` (recording, channel, colour, stimulus_id): what they don't say is taken from the recording's stimulus of that number.

    A channel that is there already is replaced; one without such a stimulus is left out.
    """
    inherited = [c for c in channels.columns if c not in ("recording", "channel", "colour", "stimulus_id")]
    stimuli = channels.groupBy("recording", "stimulus_id").agg(*[F.max(c).alias(c) for c in inherited])
    new = added.join(stimuli, ["recording", "stimulus_id"]).select(channels.columns)
    return channels.join(new.select("recording", "channel"), ["recording", "channel"], "left_anti").unionByName(new)
