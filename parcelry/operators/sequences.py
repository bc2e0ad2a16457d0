"""Order-dependent logic as windows: argmax, latest-wins, gaps and islands, running sums."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelry.operators.relational import first_per_key


def argmax_per_key(df: DataFrame, keys: list[str], score: str, order: list[str]) -> DataFrame:
    """The row with the highest score of each key; ties keep the earlier in order."""
    return first_per_key(df, keys, [F.col(score).desc_nulls_last(), *map(F.col, order)])


def latest_wins(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """The value of each key's last row."""
    return df.groupBy(key).agg(F.max_by(value, order).alias(value))


def islands(df: DataFrame, keys: list[str], order: list[str], at: Column, gap: Column) -> DataFrame:
    """df with island: 0, 1, ... per key; a new one begins where at exceeds the one before by more than gap."""
    w = W.partitionBy(*keys).orderBy(*order)
    new = F.when(at - F.lag(at).over(w) > gap, 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(w).cast("long")).drop("_new")


def running_offset(df: DataFrame, keys: list[str], order: list[str], length: Column) -> DataFrame:
    """Where each item begins if all are joined by one space."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn("start_at", F.coalesce(F.sum(length + 1).over(w), F.lit(0)).cast("long"))


def first_occurrences(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Each value once per key, where it came first, numbered in that order from 0."""
    per = df.groupBy(*keys, value).agg(F.min(order).alias("first_at"))
    return per.withColumn("place", (F.row_number().over(W.partitionBy(*keys).orderBy("first_at", value)) - 1).cast("long"))


def _collapsed(gap: int, keys: int):
    """Streams over rows sorted by key and value: a value closer than gap to the last one of its key is averaged with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = None, None
        for b in batches:
            names, out, at = b.schema.names, [], []
            columns = [c.to_pylist() for c in b.columns]
            for i, (*this, v) in enumerate(zip(*columns, strict=True)):
                if this != key or v - last >= gap:
                    if key is not None:
                        out.append(last)
                        at.append(key)
                    key, last = this, v
                else:
                    last = (last + v) // 2
            if out:
                yield pa.RecordBatch.from_arrays([*[pa.array([k[i] for k in at], b.schema.types[i]) for i in range(keys)], pa.array(out, pa.int64())], [*names[:keys], names[-1]])
            schema = b.schema
        if key is not None:
            yield pa.RecordBatch.from_arrays([*[pa.array([key[i]], schema.types[i]) for i in range(keys)], pa.array([last], pa.int64())], [*schema.names[:keys], schema.names[-1]])

    return run


def collapse_close(df: DataFrame, keys: list[str], value: str, gap: int) -> DataFrame:
    """Whole numbers of each key in order, where one that is closer than gap to the last result is averaged with it (rounded down): keys, value.

    Averages never exceed what they came from, so no result spans an empty cell of gap numbers. Numbers are cut there: only the distinct cells of a key meet in a window,
    and each stretch without an empty cell is folded by itself, in a stream over sorted rows. Nulls are left out.
    """
    rows = df.select(*keys, F.col(value).cast("long").alias(value)).filter(F.col(value).isNotNull()).withColumn("_cell", F.floor(F.col(value) / gap))
    w = W.partitionBy(*keys).orderBy("_cell")
    cells = rows.select(*keys, "_cell").distinct()
    after = F.when(F.col("_cell") - F.lag("_cell").over(w) > 1, F.col("_cell"))
    cells = cells.withColumn("_from", F.coalesce(F.last(after, ignorenulls=True).over(w), F.lit(-(1 << 62))))
    names = [F.col(f"c.{k}") for k in keys]
    on = F.col("r._cell") == F.col("c._cell")
    for k in keys:
        on &= F.col(f"r.{k}").eqNullSafe(F.col(f"c.{k}"))
    met = rows.alias("r").join(cells.alias("c"), on).select(*names, "_from", f"r.{value}")
    dealt = met.repartition(*keys, "_from").sortWithinPartitions(*keys, "_from", value)
    return dealt.mapInArrow(_collapsed(gap, len(keys)), ", ".join(f"`{k}` {dict(df.dtypes)[k]}" for k in keys) + f", `{value}` long")


def midpoints(df: DataFrame, keys: list[str], at: str) -> DataFrame:
    """The middles between neighbours."""
    w = W.partitionBy(*keys).orderBy(at)
    return df.withColumn("middle", (F.col(at) + F.lead(at).over(w)) / 2).filter("middle is not null")
