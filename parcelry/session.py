"""The Spark session with the settings that the engine's queries expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "parcelry", cpus: int | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """A session on local[cpus] unless a master is configured already; UTC, adaptive execution, ANSI mode."""
    builder = SparkSession.builder.appName(app)
    if not os.environ.get("SPARK_MASTER"):
        cpus = cpus or os.cpu_count() or 4
        builder = builder.master(f"local[{cpus}]").config("spark.driver.memory", "8g")
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions or cpus)).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
    spark = builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
