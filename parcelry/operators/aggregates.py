"""Dashboard and village aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int | None = None) -> Column:
    """part of whole in percent; 0 if whole is 0 or null."""
    p = F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))
    return p if digits is None else F.round(p, digits)


def zero_filled(counts: DataFrame, dimension: DataFrame, key: str, count: str) -> DataFrame:
    """Every key of the dimension, with 0 where nothing was counted."""
    return dimension.join(counts, key, "left").select(key, F.coalesce(count, F.lit(0)).cast("long").alias(count))


def histogram(df: DataFrame, key: str, missing: str, name: str = "n") -> DataFrame:
    """Rows by value; null and empty text share a label."""
    value = F.coalesce(F.nullif(F.col(key), F.lit("")), F.lit(missing))
    return df.groupBy(value.alias(key)).agg(F.count("*").alias(name))


def mean_nonzero(c: Column) -> Column:
    """The mean without zeros and nulls."""
    return F.avg(F.nullif(c, F.lit(0.0)))


def progress(df: DataFrame, place: str, verified: Column, pending: Column, failed: Column) -> DataFrame:
    """Per place: total, verified, pending and failed rows, and the verified share in percent."""
    name = F.coalesce(F.col(place), F.lit("Unknown"))
    per = df.groupBy(name.alias(place)).agg(F.count("*").alias("total"), F.count_if(verified).alias("verified"), F.count_if(pending).alias("pending"), F.count_if(failed).alias("failed"))
    return per.withColumn("progress_pct", percent(F.col("verified"), F.col("total"), 1))


def reliability(readings: DataFrame, corrections: DataFrame, field: str, least: int = 5) -> DataFrame:
    """Per field with enough readings (field, source) that aren't a human's: factor between 0.7 and 1 by the share of corrections (field)."""
    n = readings.filter(F.coalesce(F.col("source") != "human", F.lit(False))).groupBy(field).agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    fixed = corrections.groupBy(field).agg(F.count("*").alias("corrections"))
    per = n.join(fixed, field, "left").withColumn("corrections", F.coalesce("corrections", F.lit(0)))
    factor = F.greatest(F.lit(0.7), F.least(F.lit(1.0), 0.7 + 0.3 * (1 - F.col("corrections") / F.col("n"))))
    return per.withColumn("factor", F.round(factor, 4))


def recent_values(df: DataFrame, columns: list[str], when: str, limit: int) -> DataFrame:
    """Per column, its values by last use, the latest first, at most limit each: one pass over the table for all columns."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in columns])).alias("v"), when)
    per = rows.select("v.field", "v.value", when).filter("value is not null and value <> ''").groupBy("field", "value").agg(F.max(when).alias("last_used"))
    w = W.partitionBy("field").orderBy(F.desc("last_used"), "value")
    return per.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= limit)


def pivoted(df: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """One row per key and one column per listed name (the smallest value of each)."""
    return df.groupBy(key).pivot(name, names).agg(F.min(value))
