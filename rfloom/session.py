"""Session defaults for local work; a cluster's own session is used as it is."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

#: The folder that holds the package: Python workers find it there wherever the driver was started.
_ROOT = str(Path(__file__).resolve().parents[1])


def local_session(cores: str = "8", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("rfloom")
        .config("spark.sql.shuffle.partitions", shuffle_partitions)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.executorEnv.PYTHONPATH", os.pathsep.join(filter(None, (_ROOT, os.environ.get("PYTHONPATH")))))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
