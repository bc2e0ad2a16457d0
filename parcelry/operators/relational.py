"""Filters, joins, set operations, ordering and paging."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def optional_filters(df: DataFrame, **values: str | None) -> DataFrame:
    """Equality on each column whose value isn't empty."""
    for name, value in values.items():
        if value:
            df = df.filter(F.col(name) == value)
    return df


def scoped(df: DataFrame, role: str, state: str | None = None, district: str | None = None, state_col: str = "state", district_col: str = "district") -> DataFrame:
    """Row-level security: operators and verifiers see their own state and district; other roles see all."""
    if role in ("operator", "verifier"):
        return optional_filters(df, **{state_col: state, district_col: district})
    return df


def same_text(c: Column, value: str) -> Column:
    """Equal but for case; % and _ in value act as wildcards."""
    return F.ilike(c, F.lit(value))


def any_contains(cols: list[Column], query: str) -> Column:
    """Whether any column, as text, contains the query, ignoring case."""
    return reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(c.cast("string")), F.lit(query.lower())), F.lit(False)) for c in cols])


def outside_band(mid: Column, top: Column, bottom: Column) -> Column:
    return ~mid.between(top, bottom)


def page(df: DataFrame, order: list[Column], number: int, size: int) -> DataFrame:
    """One page, with the count of all rows as total; a page has 1 to 200 rows. order must end with a unique key."""
    size = max(1, min(size, 200))
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(*order).offset((max(1, number) - 1) * size).limit(size).join(F.broadcast(total))  # total: one row


def cursor(rows: DataFrame, order: list[tuple[str, bool]]) -> tuple | None:
    """The sort key of a page's last row, for page_after; null of an empty page. A page fits in the driver."""
    keys = [tuple(r) for r in rows.select(*[c for c, _ in order]).collect()]
    return keys[-1] if keys else None


def page_after(df: DataFrame, order: list[tuple[str, bool]], size: int, after: tuple | None = None) -> DataFrame:
    """The first rows (1 to 200) behind a sort key, or from the beginning; order has columns and whether they ascend, and ends with a unique key.

    What lies before is left out by a filter that the scan takes, instead of being counted off, so late pages cost no more than early ones and rows that come or go
    meanwhile shift none. Columns of the order hold no nulls.
    """
    if after is not None:
        beyond = lambda c, up, v: F.col(c) > F.lit(v) if up else F.col(c) < F.lit(v)
        behind = F.lit(False)
        for (c, up), v in reversed(list(zip(order, after, strict=True))):
            behind = beyond(c, up, v) | ((F.col(c) == F.lit(v)) & behind)
        first, up = order[0]
        df = df.filter((F.col(first) >= F.lit(after[0])) if up else (F.col(first) <= F.lit(after[0]))).filter(behind)
    return df.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order]).limit(max(1, min(size, 200)))


def first_per_key(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key; Spark keeps one row per key and task before it shuffles."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def tasks_for(*tables: DataFrame, most: int = 500_000) -> int:
    """So many tasks that each gets about `most` rows of the tables (those of Parquet are counted by their footers), and no core is idle."""
    return max(tables[0].sparkSession.sparkContext.defaultParallelism, sum(t.count() for t in tables) // most + 1)


def fan_out(parents: DataFrame, children: DataFrame, on: Column, child_key: Column) -> DataFrame:
    """Every parent with its children, or once alone; row_kind is 'parcel' or 'record'."""
    return parents.join(children, on, "left").withColumn("row_kind", F.when(child_key.isNull(), "record").otherwise("parcel"))


def duplicates_of(df: DataFrame, key: Column, id_col: str) -> DataFrame:
    """Rows whose key occurs more than once, with how many there are and the smallest id."""
    keyed = df.select(F.col(id_col), key.alias("key"))
    per = keyed.groupBy("key").agg(F.count("*").alias("copies"), F.min(id_col).alias("lowest"))
    return keyed.join(per.filter("copies > 1"), "key").select(id_col, "copies", "lowest")


def changes(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, change (insert, delete, update or same) and the new values: a full join by key, null-safe by column."""
    a = before.select(key, *[F.col(c).alias(f"old_{c}") for c in columns], F.lit(True).alias("was"))
    b = after.select(key, *columns, F.lit(True).alias("is_"))
    differs = reduce(lambda x, y: x | y, [~F.col(f"old_{c}").eqNullSafe(F.col(c)) for c in columns])
    kind = F.when(F.col("was").isNull(), "insert").when(F.col("is_").isNull(), "delete").when(differs, "update").otherwise("same")
    return a.join(b, key, "full").withColumn("change", kind).select(key, "change", *[F.coalesce(c, f"old_{c}").alias(c) for c in columns])


def replace_children(all_rows: DataFrame, new_rows: DataFrame, key: str) -> DataFrame:
    """all_rows with the rows of new_rows' keys replaced by new_rows."""
    return all_rows.join(new_rows.select(key).distinct(), key, "left_anti").unionByName(new_rows)
