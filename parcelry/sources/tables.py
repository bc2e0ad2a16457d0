"""Parquet tables of a folder, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """t.orders is the scan of orders.parquet: nothing is read before a query asks for columns."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
