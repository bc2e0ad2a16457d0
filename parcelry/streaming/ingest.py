"""Streams over folders of Parquet files: events by day, new documents by content."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from parcelry.operators.relational import first_per_key
from parcelry.sources.files import append
from parcelry.sources.stored import exists


def daily_counts(spark: SparkSession, folder: str, schema: str, delay: str = "1 day") -> DataFrame:
    """Events per UTC day from a growing folder; late rows count until the watermark has passed their day."""
    events = spark.readStream.schema(schema).parquet(folder)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "n")


def append_stream(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Appends a stream of entries (audit, corrections, snapshots) batch by batch; a batch that is replayed replaces itself. Ends when all present rows are read."""
    return stream.writeStream.foreachBatch(lambda batch, i: append(batch, target, i)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_documents(target: str) -> Callable[[DataFrame, int], None]:
    """A sink for batches of documents (text, ...): appends those whose text neither an earlier batch nor the batch itself has already.

    Of equal texts in a batch the first by all columns stays. Only what other batches have written counts as known, so a batch that is replayed, or was written
    half-way, gives the same rows again and replaces itself.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        hashed = batch.withColumn("sha256", F.sha2("text", 256))
        new = first_per_key(hashed, ["sha256"], [F.to_json(F.struct(*batch.columns))])
        if exists(spark, target):
            schema = "sha256 string, batch long"
            known = spark.read.schema(schema).parquet(target).filter(F.col("batch") != batch_id).select("sha256")
            new = new.join(known, "sha256", "left_anti")
        append(new, target, batch_id)

    return sink


def ingest_documents(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Appends documents whose text the target doesn't have yet; ends when all present files are read."""
    stream = spark.readStream.schema(schema).parquet(folder)
    return stream.writeStream.foreachBatch(new_documents(target)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
