"""Tables that are written back: rows dealt to partitions by the hash of their key, so an edit rewrites only the partitions that it touches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """A folder that the driver and all executors share: the one in spark.checkpoint.dir; a temporary one only where that is unset and the master is local."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="parcelry-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder of any store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


@dataclass
class Stored:
    """A table in a folder, in `parts` partitions by key (null keys have one, too)."""

    spark: SparkSession
    path: str
    key: str
    parts: int = 64

    @property
    def part(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.parts)).cast("int")

    def write(self, rows: DataFrame) -> Stored:
        """Writes a table anew."""
        rows.withColumn("part", self.part).repartition("part").write.mode("overwrite").partitionBy("part").parquet(self.path)
        return self

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).drop("part")

    def touched(self, keys: DataFrame) -> list[int]:
        """The partitions of some keys: at most as many numbers as there are partitions."""
        return sorted(r.part for r in keys.select(self.part.alias("part")).distinct().collect())

    def replace(self, keys: DataFrame, rows: DataFrame | None = None) -> list[int]:
        """Rows of the keys give way to the given ones (none: they are deleted); returns the partitions that were rewritten.

        What the partitions will hold is written aside first, so nothing is read from where it is written, and is then put in their place partition by partition. A
        run that ends half-way is completed by running it again: each partition either is as before or as after, and replacing again changes nothing. rows must have keys
        out of keys.
        """
        hit = self.touched(keys)
        if not hit:
            return hit
        old = self.spark.read.parquet(self.path).filter(F.col("part").isin(hit))  # only these partitions are read
        kept = old.join(keys.select(F.col(self.key).alias("_key")).distinct(), F.col(self.key).eqNullSafe(F.col("_key")), "left_anti")
        after = kept if rows is None else kept.unionByName(rows.select(*[F.col(c).cast(kind).alias(c) for c, kind in old.dtypes if c != "part"]).withColumn("part", self.part))
        aside = new_path(self.spark, "aside")
        after.repartition("part").write.partitionBy("part").parquet(aside)
        self._put(hit, aside, old)
        remove(self.spark, aside)
        return hit

    def _put(self, hit: Iterable[int], aside: str, old: DataFrame) -> None:
        new = self.spark.read.schema(old.schema).parquet(aside)
        new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.path)
        for part in set(hit) - {r.part for r in new.select("part").distinct().collect()}:  # what has no rows left isn't overwritten
            remove(self.spark, f"{self.path}/part={part}")


def delete_with_children(keys: DataFrame, parent: Stored, children: list[Stored]) -> dict[str, list[int]]:
    """Deletes keys from the children first and from the parent last, so that a run that ends half-way can find them again; the partitions rewritten by path.

    keys has the parent's key column; children have their own name for it.
    """
    done = {}
    for table in (*children, parent):
        done[table.path] = table.replace(keys.select(F.col(parent.key).alias(table.key)))
    return done
