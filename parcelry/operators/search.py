"""Search for a piece of text over many columns, by a table of trigrams that is written once.

A text that contains a query contains all its trigrams. The posting table has one row per trigram and text, in partitions by trigram and sorted by it, so a query reads
the few row groups of its own trigrams, counts how many each text has, and looks into those texts alone that have all. Queries with fewer than three
letters between wildcards scan.

Texts that many rows share (names, kinds, places) are indexed once each, by their hash; rows meet the texts found by the hashes of their columns.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.text import blank_to_null, once
from parcelry.operators.relational import first_per_key

LEAST = 2
#: Partitions of a posting table, and parts that the ids of each are dealt to.
CELLS, DEALT = 64, 8
#: Up to so many texts found go to all executors as hashes; more meet the rows in a shuffle.
FEW = 100_000
#: The columns that each branch looks into.
RECORD_TEXTS = ("owner_name", "father_or_husband_name", "village", "district", "tehsil", "state", "khasra_number", "khata_number", "survey_number")
PARCEL_TEXTS = ("owner_name", "parcel_number", "crop", "land_classification")


def trigrams_of(query: str) -> list[str]:
    """The trigrams that a text must have; % and _ stand for anything."""
    return sorted({part[i : i + 3] for part in re.split("[%_]", query.lower()) for i in range(len(part) - 2)})


def postings(rows: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """trigram, id: once per text and trigram of any of its columns."""
    letters = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    grams = lambda cs: F.filter(F.transform(cs, lambda ch, i: F.concat(ch, F.get(cs, i + 1), F.get(cs, i + 2))), lambda g: g.isNotNull())
    every = F.array_distinct(F.flatten(F.array(*[once(letters(F.coalesce(F.lower(F.col(c).cast("string")), F.lit(""))), grams) for c in columns])))
    return rows.select(F.col(id_col).alias("id"), F.explode(every).alias("trigram")).select("trigram", "id")


def cell_of(trigram: Column) -> Column:
    return F.pmod(F.xxhash64(trigram), F.lit(CELLS)).cast("int")


def write_postings(rows: DataFrame, id_col: str, columns: list[str], path: str) -> DataFrame:
    """The posting table in a folder, in cells of trigrams, sorted by trigram; the ids of a cell are dealt to several files, as some trigrams are in most texts."""
    p = postings(rows, id_col, columns).withColumn("cell", cell_of(F.col("trigram")))
    p.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(DEALT))).sortWithinPartitions("cell", "trigram").write.partitionBy("cell").parquet(path)
    return rows.sparkSession.read.schema(p.schema).parquet(path)


def text_key(c: Column) -> Column:
    """What a shared text is known by: texts of equal hash are told apart when rows are looked into."""
    return F.xxhash64(F.lower(c.cast("string")))


def write_text_postings(texts: list[DataFrame], path: str) -> DataFrame:
    """The posting table of shared texts, given as tables of one column each: once per trigram and different text. It may hold texts that no row has."""
    each = reduce(DataFrame.union, [t.toDF("text").select(F.lower(F.col("text").cast("string")).alias("text")) for t in texts])
    return write_postings(each.filter("text is not null").distinct().select("text", text_key(F.col("text")).alias("text_key")), "text_key", ["text"], path).withColumnRenamed("id", "text_key")


def like(c: Column, query: str) -> Column:
    """Whether a text contains the query, ignoring case; % and _ act as wildcards."""
    return F.coalesce(F.ilike(c.cast("string"), F.lit("%" + query.replace("\\", "\\\\") + "%")), F.lit(False))


def holds(c: Column, query: str) -> Column:
    """Whether a text contains the query as it is, ignoring case."""
    return F.coalesce(F.contains(F.lower(c), F.lit(query.lower())), F.lit(False))


def with_texts(rows: DataFrame, id_col: str, columns: list[str], found: DataFrame) -> DataFrame:
    """The rows one of whose columns has a text that was found (text_key)."""
    if found.count() > FEW:
        keys = rows.select(id_col, F.explode(F.array_distinct(F.array(*[text_key(F.col(c)) for c in columns]))).alias("text_key"))
        return rows.join(keys.join(found, "text_key", "left_semi").select(id_col), id_col, "left_semi")
    for i, c in enumerate(columns):
        rows = rows.join(F.broadcast(found.select(F.col("text_key").alias(f"_{i}"))), text_key(F.col(c)) == F.col(f"_{i}"), "left")
    at = [f"_{i}" for i in range(len(columns))]
    return rows.filter(F.coalesce(*at).isNotNull()).drop(*at)


def candidates(rows: DataFrame, id_col: str, index: DataFrame | None, query: str, columns: list[str] | None = None) -> DataFrame:
    """The rows that can contain the query: by their trigrams, or by those of the texts in their columns, where there is an index and the query has any; else all."""
    grams = trigrams_of(query)
    if index is None or not grams:
        return rows
    cells = sorted({r.c for r in index.sparkSession.createDataFrame([(g,) for g in grams], "g string").select(cell_of(F.col("g")).alias("c")).collect()})  # of the query alone
    some = index.filter(F.col("cell").isin(cells) & F.col("trigram").isin(grams))
    if "text_key" in index.columns:
        return with_texts(rows, id_col, columns, some.groupBy("text_key").agg(F.count_distinct("trigram").alias("n")).filter(F.col("n") == len(grams)).select("text_key"))
    found = some.groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(grams))
    return rows.join(found.select(F.col("id").alias(id_col)), id_col, "left_semi")


def matching(rows: DataFrame, id_col: str, columns: list[str], index: DataFrame | None, query: str) -> DataFrame:
    """The rows one of whose columns contains the query."""
    some = candidates(rows, id_col, index, query, columns)
    return some.filter(reduce(lambda a, b: a | b, [like(F.col(c), query) for c in columns]))


def hits(documents: DataFrame, records: DataFrame, parcels: DataFrame, fields: DataFrame, query: str, indexes: dict[str, DataFrame] | None = None) -> DataFrame:
    """document_id, kind, snippet, parcel_row of everything that contains the query, in four branches joined to their documents.

    documents (document_id, ocr_text), records (document_id and the columns of RECORD_TEXTS), parcels (parcel_id, document_id, row_index and those of PARCEL_TEXTS), fields (field_id, document_id,
    field_name, value). A document has one hit of record, parcel or field, the first in this order, and another of its text. A parcel whose
    land class alone contains the query finds no document. indexes are posting tables by branch, of rows or of texts: records, parcels, fields, documents.
    """
    q = query.strip()
    if len(q) < LEAST:
        raise ValueError(f"a query has at least {LEAST} characters")
    indexes = indexes or {}
    here = documents.select("document_id")
    shown = lambda c: F.coalesce(blank_to_null(F.col(c)), F.lit("—"))
    none = F.lit(None).cast("int")

    r = matching(records, "document_id", list(RECORD_TEXTS), indexes.get("records"), q).join(here, "document_id")
    by_record = r.select("document_id", F.lit(1).alias("branch"), F.lit("record").alias("kind"), F.concat(shown("village"), F.lit(" · "), shown("owner_name"), F.lit(" · khasra "), shown("khasra_number")).alias("snippet"), none.alias("parcel_row"))
    p = matching(parcels, "parcel_id", list(PARCEL_TEXTS), indexes.get("parcels"), q).join(here, "document_id")
    p = first_per_key(p.filter(holds(F.col("owner_name"), q) | holds(F.col("parcel_number"), q) | holds(F.col("crop"), q)), ["document_id"], [F.col("row_index"), F.col("parcel_id"), F.col("parcel_number")])
    by_parcel = p.select("document_id", F.lit(2).alias("branch"), F.lit("parcel").alias("kind"), F.trim(F.concat(F.lit("parcel "), shown("parcel_number"), F.lit(" · owner "), shown("owner_name"), F.lit(" · "), F.coalesce("crop", F.lit("")))).alias("snippet"), F.col("row_index").cast("int").alias("parcel_row"))
    f = matching(fields, "field_id", ["value"], indexes.get("fields"), q).join(here, "document_id")
    f = first_per_key(f.filter(holds(F.col("value"), q)), ["document_id"], [F.col("field_id")])
    by_field = f.select("document_id", F.lit(3).alias("branch"), F.lit("field").alias("kind"), F.concat("field_name", F.lit(" = "), "value").alias("snippet"), none.alias("parcel_row"))
    d = matching(documents, "document_id", ["ocr_text"], indexes.get("documents"), q).filter(holds(F.col("ocr_text"), q))
    at = F.locate(q.lower(), F.lower("ocr_text"))
    start = F.greatest(at - 60, F.lit(1))
    window = F.btrim(F.substring("ocr_text", start, at + len(q) + 60 - start), F.lit(" \n\t\r"))
    by_text = d.select("document_id", F.lit(4).alias("branch"), F.lit("ocr").alias("kind"), F.concat(F.lit("…"), window, F.lit("…")).alias("snippet"), none.alias("parcel_row"))
    named = first_per_key(by_record.unionByName(by_parcel).unionByName(by_field), ["document_id"], [F.col("branch"), F.col("snippet")])
    return named.unionByName(by_text).withColumn("snippet", F.left("snippet", F.lit(180)))


def first_hits(found: DataFrame, limit: int = 30) -> DataFrame:
    """The first hits by branch and document, and how many there are in all (total)."""
    limit = max(1, min(limit, 200))
    total = found.agg(F.count("*").alias("total"))
    return found.orderBy("branch", "document_id").limit(limit).join(F.broadcast(total)).drop("branch")  # total: one row
