"""What the operators of this subpackage have in common: words, saved tables, row keys."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a longest run of characters other than space, tab, line feed, vertical tab, form feed, carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Arrow batches of at most so many rows, as whole texts make up a row; a number that the session was given itself stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(name) == "10000":
        spark.conf.set(name, str(rows))


def large_rows(spark: SparkSession, limit: int = 32 << 20) -> None:
    """Arrow batches end after so many bytes, for rows that hold whole blocks; a smaller limit of the session's stays."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(re.sub(r"\D", "", spark.conf.get(name))) > limit:
        spark.conf.set(name, str(limit))


def give_back() -> None:
    """Returns to the system what this Python worker has freed: workers outlive their tasks, and their heaps would stay at the highest mark."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    The cluster names it in spark.checkpoint.dir. Only where that is unset and everything runs on this machine (tests) a temporary
    folder takes its place; on a cluster without such a folder this raises, as executors could not read each other's files.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="parcelry-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: cuts the lineage, survives lost executors.

    Later joins see a plain scan with a known size, so Spark broadcasts it only below its size
    threshold and otherwise shuffles both sides, where adaptive execution can split hot keys.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.saved_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Removes saved tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def words(text: Column) -> Column:
    """The words of a text, unchanged; null gives none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of doc_id as text, modulo parts (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def renewed(name: str, old: Column, text: Column) -> Column:
    """A column of documents after its text has changed: text is replaced, n_chars counted anew, all else stays."""
    if name == "text":
        return text.alias(name)
    return (F.length(text).cast("long") if name == "n_chars" else old).alias(name)
