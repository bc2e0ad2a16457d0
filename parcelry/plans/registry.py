"""Plans by name, with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelry.sources.tables import Tables

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def plan(sql: str | None = None):
    """Registers a function of Tables under its name."""

    def keep(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        name = f.__name__.removesuffix("_")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__ = name
        PLANS[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return keep
