"""The verifier's work: corrected fields, edited parcels, the log of both, and the decision on a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from parcelry.functions.area import parse_area
from parcelry.functions.constants import STATUSES
from parcelry.functions.text import blank_to_null, normalize_field, once, python_float
from parcelry.operators.extraction import auto_accepted

# The cells of a parcel that a verifier may edit (beside its area), and the states a decision may start from.
EDITABLE = ("parcel_number", "land_classification", "crop", "owner_name", "possessor_name", "father_name", "share", "remarks")
DECIDABLE = ("pending_review", "auto_verified", "extracted", "verified")

#: Which states may follow which: processing starts from any, a decision from the decidable ones.
TRANSITIONS = (
    *((s, "processing") for s in STATUSES), ("processing", "extracted"), ("processing", "failed"), ("extracted", "auto_verified"), ("extracted", "pending_review"),
    ("extracted", "failed"), *((s, d) for s in DECIDABLE for d in ("verified", "rejected")),
)


def verified_fields(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """fields (document_id, field_name, value, normalized_value, confidence, source) after corrections (document_id, field_name, place, corrected_value).

    Of a field's corrections the last by place stays. A corrected field keeps what was read (value), takes the normalised
    correction, full confidence and source human; one that wasn't read before is added with a null value.
    """
    last = corrections.groupBy("document_id", "field_name").agg(F.max_by("corrected_value", "place").alias("corrected_value"), F.lit(True).alias("_fixed"))
    both, fixed = fields.join(last, ["document_id", "field_name"], "full"), F.col("_fixed").isNotNull()
    return both.select(
        "document_id", "field_name", "value", "corrected_value",
        F.when(fixed, normalize_field(F.col("field_name"), F.col("corrected_value"))).otherwise(F.col("normalized_value")).alias("normalized_value"),
        F.when(fixed, 100.0).otherwise(F.col("confidence")).alias("confidence"),
        F.when(fixed, "human").otherwise(F.col("source")).alias("source"),
    )


def correction_log(fields: DataFrame, corrections: DataFrame) -> DataFrame:
    """What verified_fields changes: document_id, field_name, place, ocr_value, old (normalised before), corrected_value.

    A correction counts if it differs from the normalised value that stands before it, null and '' being the same; of several
    to one field each is compared with the one before.
    """
    w = W.partitionBy("document_id", "field_name").orderBy("place")
    standing = normalize_field(F.col("field_name"), F.col("corrected_value"))
    j = corrections.join(fields, ["document_id", "field_name"], "left").withColumn("_nth", F.row_number().over(w))
    j = j.withColumn("old", F.when(F.col("_nth") == 1, F.col("normalized_value")).otherwise(F.lag(standing).over(w)))
    changed = F.coalesce("old", F.lit("")) != F.coalesce("corrected_value", F.lit(""))
    return j.filter(changed).select("document_id", "field_name", "place", F.col("value").alias("ocr_value"), "old", "corrected_value")


def _differs(cell: str) -> Column:
    return ~blank_to_null(F.col(f"old_{cell}")).eqNullSafe(blank_to_null(F.col(cell)))


def _edited(parcels: DataFrame, edits: DataFrame) -> tuple[DataFrame, list[str]]:
    """Parcels of edited documents beside their edits; rows of either side may be alone."""
    cells = [c for c in (*EDITABLE, "area_text") if c in edits.columns]
    old = parcels.select("document_id", "parcel_id", F.lit(True).alias("_was"), "row_index", "source", "area_unit", *[F.col(c).alias(f"old_{c}") for c in cells])
    old = old.join(edits.select("document_id").distinct(), "document_id", "left_semi")
    return old.join(edits.withColumn("_is", F.lit(True)), ["document_id", "parcel_id"], "full"), cells


def edited_parcels(parcels: DataFrame, edits: DataFrame) -> DataFrame:
    """parcels (document_id, parcel_id, row_index, source, area_unit, area_text, cells) after edits (document_id, parcel_id, place, area_text, cells).

    An edit whose id is null or unknown adds a row; a row without an edit goes, if its document has any edit. A figure without a
    unit takes the most frequent unit of the document's rows. A row is the human's once it, or one edited before it, has changed.
    There is at most one edit per parcel. Documents without edits stay as they are.
    """
    both, cells = _edited(parcels, edits)
    unit = parcels.groupBy("document_id").agg(F.mode(blank_to_null(F.col("area_unit")), True).alias("_unit"))
    changed = F.col("_was").isNull() | F.exists(F.array(*map(_differs, cells)), lambda x: x)
    w = W.partitionBy("document_id").orderBy("place").rowsBetween(W.unboundedPreceding, 0)
    rows = both.filter("_is").withColumn("_human", F.max(changed.cast("int")).over(w) == 1).join(unit, "document_id", "left")
    inherited = lambda own: F.when(own["value"].isNotNull() & own["sqm"].isNull() & F.col("_unit").isNotNull(), parse_area(F.concat_ws(" ", python_float(own["value"]), F.col("_unit")))).otherwise(own)
    area = once(parse_area(F.col("area_text")), inherited)
    rows = rows.withColumn("_area", area)
    done = rows.select("document_id", "parcel_id", F.col("place").alias("row_index"), F.when(F.col("_human"), "human").otherwise(F.col("source")).alias("source"), F.col("_area.unit").alias("area_unit"), *cells, F.col("_area.value").alias("area_value"), F.col("_area.sqm").alias("area_sqm"))
    kept = parse_area(F.col("area_text"))
    rest = parcels.join(edits.select("document_id").distinct(), "document_id", "left_anti")
    rest = rest.select("document_id", "parcel_id", "row_index", "source", "area_unit", *cells, kept["value"].alias("area_value"), kept["sqm"].alias("area_sqm"))
    return done.unionByName(rest)


def parcel_log(parcels: DataFrame, edits: DataFrame) -> DataFrame:
    """What edited_parcels changes: document_id, parcel_row (from 1), field, old, new; a removed row is field 'row' with its number."""
    both, cells = _edited(parcels, edits)
    shown = {"area_text": "area"}
    per_cell = [F.when(_differs(c), F.struct((F.col("place") + 1).alias("parcel_row"), F.lit(shown.get(c, c)).alias("field"), F.col(f"old_{c}").alias("old"), F.col(c).alias("new"))) for c in cells]
    gone = F.struct((F.col("row_index") + 1).alias("parcel_row"), F.lit("row").alias("field"), F.col("old_parcel_number").alias("old"), F.lit(None).cast("string").alias("new"))
    found = F.when(F.col("_is").isNull(), F.array(gone)).otherwise(F.array_compact(F.array(*per_cell)))
    return both.select("document_id", F.explode(found).alias("c")).select("document_id", "c.*")


def decided(status: Column, decision: Column) -> Column:
    """The status after a verifier's decision: verified by approve, rejected by anything else; null where the status allows none."""
    return F.when(status.isin(*DECIDABLE), F.when(decision == "approve", "verified").otherwise("rejected"))


def moved(status: Column, wanted: Column) -> Column:
    """The wanted status where it may follow the present one, else null."""
    pair = F.concat_ws(">", status, wanted)
    return F.when(status.isNotNull() & wanted.isNotNull() & pair.isin(*(f"{a}>{b}" for a, b in TRANSITIONS)), wanted)


def reprocessed(documents: DataFrame, reruns: DataFrame) -> DataFrame:
    """documents (document_id, status, is_verified) after some of them were processed again.

    reruns (document_id, crashed, failed_errors, disagreements, confidence) has one row per document; a null confidence means that nothing
    was read. Verification is set by automatic acceptance and otherwise stays as it was, also where the document goes back to review: it
    remains in exports until a verifier rejects it.
    """
    r = reruns.select("document_id", F.lit(True).alias("again"), "crashed", "failed_errors", "disagreements", "confidence")
    after = F.when(F.coalesce("crashed", F.lit(False)), "failed").otherwise(auto_accepted(F.col("failed_errors"), F.col("disagreements"), F.col("confidence")))
    j = documents.join(r, "document_id", "left").withColumn("status", F.when(F.col("again"), after).otherwise(F.col("status")))
    verified = F.col("is_verified") | (F.coalesce("again", F.lit(False)) & (F.col("status") == "auto_verified"))
    return j.withColumn("is_verified", verified).drop("again", "crashed", "failed_errors", "disagreements", "confidence")
