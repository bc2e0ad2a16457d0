"""Document files in, exports out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelry.functions.constants import MAX_BYTES, MAX_FILES, RECORD_COLUMNS
from parcelry.functions.text import safe_extension, safe_filename


def empty_files(spark: SparkSession, folder: str) -> list[str]:
    """Paths of a folder's files without a byte, from the store's listing: Spark's file sources leave them out."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    listed, found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True), []
    while listed.hasNext():
        one = listed.next()
        if one.getLen() == 0 and one.getPath().getName()[0] not in "._":
            found.append(one.getPath().toString())
    return found


def uploads(spark: SparkSession, folder: str, most: int | None = MAX_FILES) -> DataFrame:
    """Files of a folder as rows: name, extension, size, sha256, and why one is refused (null if it isn't).

    Files beside each other are one upload; one of more than `most` files is refused as a whole (None: there is no such limit).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", "content")
    empty = spark.createDataFrame([(p,) for p in empty_files(spark, folder)], "path string")
    files = files.union(empty.select("path", F.lit(0).cast("long"), F.lit("").cast("binary")))
    refused = F.when(F.col("length") == 0, "empty").when(F.col("length") > MAX_BYTES, "too large").when(safe_extension(F.col("path")) == ".bin", "type")
    found = files.select("path", safe_filename(F.col("path")).alias("name"), safe_extension(F.col("path")).alias("extension"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), refused.alias("refused"))
    if most is None:
        return found
    together = F.regexp_extract("path", r"^(.*)/", 1)
    crowded = files.groupBy(together.alias("_upload")).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    return found.withColumn("_upload", together).join(crowded, "_upload", "left").withColumn("refused", F.when(F.col("_n").isNotNull(), "too many files").otherwise(F.col("refused"))).drop("_upload", "_n")


def new_files(found: DataFrame, catalog: DataFrame, allow_duplicate: bool = False) -> DataFrame:
    """Accepted files whose content the catalog doesn't have; of equal files the one with the first path. With allow_duplicate all accepted files."""
    accepted = found.filter("refused is null")
    if allow_duplicate:
        return accepted.select("sha256", "path", "name", "extension", "bytes")
    per = accepted.groupBy("sha256").agg(F.min_by(F.struct("path", "name", "extension", "bytes"), "path").alias("f"))
    return per.join(catalog.select("sha256"), "sha256", "left_anti").select("sha256", "f.*")


def duplicates_in(found: DataFrame, catalog: DataFrame) -> DataFrame:
    """Accepted files that the catalog (sha256, document_id) has already: path, sha256 and the smallest such document."""
    first = catalog.groupBy("sha256").agg(F.min("document_id").alias("document_id"))
    return found.filter("refused is null").join(first, "sha256").select("path", "sha256", "document_id")


def export_rows(records: DataFrame, state: str | None = None, district: str | None = None) -> DataFrame:
    """Verified records in the fixed columns and order of the export, all as text; what a table lacks is empty."""
    from parcelry.operators.relational import optional_filters

    some = optional_filters(records.filter("is_verified"), state=state, district=district)
    return some.select(*[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in records.columns else F.lit("")).alias(c) for c in RECORD_COLUMNS])


def write_csv(records: DataFrame, path: str, state: str | None = None, district: str | None = None) -> None:
    """The export with a header, as CSV; null is empty."""
    export_rows(records, state, district).write.option("header", True).option("emptyValue", "").csv(path)


def feature(geometry: Column, properties: list[str]) -> Column:
    """A GeoJSON feature as text; a null geometry and null properties stay in it."""
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), F.struct(*properties).alias("properties")), {"ignoreNullFields": "false"})


def json_page(items: DataFrame, number: int, size: int, total: int) -> DataFrame:
    """{items, total, page, size} as one row of text; items are one page, so they fit in a row."""
    got = items.agg(F.collect_list(F.struct(*items.columns)).alias("items"))
    return got.select(F.to_json(F.struct("items", F.lit(total).alias("total"), F.lit(number).alias("page"), F.lit(size).alias("size"))).alias("page"))


def paged(df: DataFrame, order: list[tuple[str, bool]], number: int, size: int) -> DataFrame:
    """A page of df as {items, total, page, size}, one row of text; total counts all rows, also where the page lies behind the last one.

    order has columns and whether they ascend, and ends with a unique key; a page has 1 to 200 rows.
    """
    number, size = max(1, number), max(1, min(size, 200))
    rows = df.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order]).offset((number - 1) * size).limit(size)
    place = F.row_number().over(W.orderBy(*[F.asc(c) if up else F.desc(c) for c, up in order]))  # of one page
    items = rows.select(F.struct(place.alias("at"), F.struct(*df.columns).alias("item")).alias("x")).agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["item"]).alias("items"))
    total = df.agg(F.count("*").alias("total"))
    both = items.join(F.broadcast(total))  # one row each
    return both.select(F.to_json(F.struct("items", "total", F.lit(number).alias("page"), F.lit(size).alias("size")), {"ignoreNullFields": "false"}).alias("page"))


def sync_external(rows: DataFrame, path: str, push: str | int | None = None) -> None:
    """Appends a pushed snapshot as it comes, without merging; an empty push is refused. A push with a name replaces itself when it is sent again."""
    if rows.isEmpty():
        raise ValueError("nothing to append: the snapshot has no rows")
    append(rows, path, push)


def append(rows: DataFrame, path: str, batch: str | int | None = None) -> None:
    """Append-only state: audit entries, corrections, external snapshots (no upsert).

    With a batch id the rows go to a folder of that id alone, and writing them again replaces it; so a batch that was written half-way, or twice, counts once.
    """
    if batch is None:
        rows.write.mode("append").parquet(f"{path}/batch=-")
    else:
        rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def appended(spark: SparkSession, path: str) -> DataFrame:
    """All that was appended to a path."""
    return spark.read.parquet(path).drop("batch")
