"""Edits, replacement, states and bulk ingest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.functions.constants import STATUSES
from parcelry.operators.extraction import auto_accepted, corrected
from parcelry.operators.records import built_parcels, records_of
from parcelry.operators.relational import changes, replace_children
from parcelry.operators.verify import correction_log, decided, edited_parcels, moved, parcel_log, reprocessed, verified_fields
from parcelry.plans.registry import plan
from parcelry.sources.files import appended, sync_external
from parcelry.sources.stored import Stored, delete_with_children, new_path
from parcelry.sources.tables import Tables


@plan("""
WITH e AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'EDITED' ELSE o_orderpriority END AS o_orderpriority FROM orders WHERE o_orderkey % 13 <> 0 UNION ALL SELECT -o_orderkey, 'NEW' FROM orders WHERE o_orderkey % 50 = 1)
SELECT coalesce(a.o_orderkey, e.o_orderkey) AS o_orderkey, CASE WHEN a.o_orderkey IS NULL THEN 'insert' WHEN e.o_orderkey IS NULL THEN 'delete' WHEN a.o_orderpriority IS DISTINCT FROM e.o_orderpriority THEN 'update' ELSE 'same' END AS change, coalesce(e.o_orderpriority, a.o_orderpriority) AS o_orderpriority
FROM orders a FULL JOIN e ON a.o_orderkey = e.o_orderkey""")
def verify_merge(t: Tables) -> DataFrame:
    o = t.orders.select("o_orderkey", "o_orderpriority")
    edited = o.filter("o_orderkey % 13 <> 0").withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 10 == 0, "EDITED").otherwise(F.col("o_orderpriority")))
    new = o.filter("o_orderkey % 50 = 1").select((-F.col("o_orderkey")).alias("o_orderkey"), F.lit("NEW").alias("o_orderpriority"))
    return changes(o, edited.unionByName(new), "o_orderkey", ["o_orderpriority"])


_FIELDS = """WITH f AS (SELECT o_orderkey AS document_id, 'remarks' AS field_name, o_orderpriority AS value FROM orders UNION ALL SELECT o_orderkey, 'record_year', CAST(year(o_orderdate) AS VARCHAR) FROM orders),
c AS (SELECT o_orderkey AS document_id, 'remarks' AS field_name, 1 AS place, ' EDITED ' AS v FROM orders WHERE o_orderkey % 10 = 0 UNION ALL SELECT o_orderkey, 'remarks', 2, 'EDITED twice' FROM orders WHERE o_orderkey % 20 = 0
  UNION ALL SELECT o_orderkey, 'record_year', 1, CAST(year(o_orderdate) AS VARCHAR) FROM orders WHERE o_orderkey % 10 = 1 UNION ALL SELECT o_orderkey, 'crop', 1, 'wheat' FROM orders WHERE o_orderkey % 50 = 3)"""


def _fields(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Two fields of each order as readings; corrections of some, twice of a few, and of fields not read."""
    o, year = t.orders, F.year("o_orderdate").cast("string")
    kinds = F.inline(F.array(F.struct(F.lit("remarks").alias("field_name"), F.col("o_orderpriority").alias("value")), F.struct(F.lit("record_year").alias("field_name"), year.alias("value"))))
    fields = o.select(F.col("o_orderkey").alias("document_id"), kinds).withColumn("normalized_value", F.col("value")).withColumn("confidence", F.lit(70.0)).withColumn("source", F.lit("rule"))

    def made(when: str, name: str, place: int, value) -> DataFrame:
        return o.filter(when).select(F.col("o_orderkey").alias("document_id"), F.lit(name).alias("field_name"), F.lit(place).alias("place"), value.alias("corrected_value"))

    fixes = made("o_orderkey % 10 = 0", "remarks", 1, F.lit(" EDITED ")).unionByName(made("o_orderkey % 20 = 0", "remarks", 2, F.lit("EDITED twice")))
    return fields, fixes.unionByName(made("o_orderkey % 10 = 1", "record_year", 1, year)).unionByName(made("o_orderkey % 50 = 3", "crop", 1, F.lit("wheat")))


@plan(f"""{_FIELDS}, l AS (SELECT document_id, field_name, arg_max(v, place) AS v FROM c GROUP BY 1, 2)
SELECT document_id, field_name, f.value, l.v AS corrected_value, CASE WHEN l.v IS NULL THEN f.value ELSE trim(l.v) END AS normalized_value, CASE WHEN l.v IS NULL THEN 70.0 ELSE 100.0 END::DOUBLE AS confidence, CASE WHEN l.v IS NULL THEN 'rule' ELSE 'human' END AS source
FROM f FULL JOIN l USING (document_id, field_name)""")
def verify_fields(t: Tables) -> DataFrame:
    return verified_fields(*_fields(t))


@plan(f"""{_FIELDS}, s AS (SELECT document_id, field_name, place, f.value AS ocr_value, CASE WHEN row_number() OVER w = 1 THEN f.value ELSE lag(trim(v)) OVER w END AS old, v AS corrected_value
  FROM c LEFT JOIN f USING (document_id, field_name) WINDOW w AS (PARTITION BY document_id, field_name ORDER BY place))
SELECT * FROM s WHERE coalesce(old, '') <> corrected_value""")
def verify_log(t: Tables) -> DataFrame:
    return correction_log(*_fields(t))


@plan("SELECT o_orderkey, CASE WHEN o_orderkey % 6 IN (1, 2, 3, 4) THEN CASE WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'rejected' END END AS status FROM orders")
def verify_decision(t: Tables) -> DataFrame:
    states = F.array(*map(F.lit, ("uploaded", "extracted", "pending_review", "auto_verified", "verified", "failed")))
    before = F.get(states, (F.col("o_orderkey") % 6).cast("int"))
    return t.orders.select("o_orderkey", decided(before, F.when(F.col("o_orderstatus") == "F", "approve").otherwise("reject")).alias("status"))


_PARCELS = """WITH p AS (SELECT o_custkey AS document_id, o_orderkey AS parcel_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS row_index, o_orderpriority AS parcel_number, o_orderstatus AS owner_name,
  CASE o_orderkey % 3 WHEN 0 THEN o_orderkey % 7 || ' ha' WHEN 1 THEN o_orderkey % 7 || ' acre' END AS area_text, CASE o_orderkey % 3 WHEN 0 THEN 'ha' WHEN 1 THEN 'acre' END AS area_unit FROM orders),
e AS (SELECT document_id, parcel_id, row_index AS place, CASE WHEN parcel_id % 4 = 1 THEN 'EDITED' ELSE parcel_number END AS parcel_number, owner_name, CASE WHEN parcel_id % 6 = 0 THEN CAST(parcel_id % 9 AS VARCHAR) ELSE area_text END AS area_text FROM p WHERE document_id % 5 = 0 AND parcel_id % 7 <> 3
  UNION ALL SELECT DISTINCT document_id, NULL, 1000000, 'NEW', NULL, '3' FROM p WHERE document_id % 5 = 0)"""


def _parcels(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders as the parcels of their customers; every fifth customer's are edited: cells, bare areas, a row more, rows less."""
    from pyspark.sql import Window as W

    k, unit = F.col("o_orderkey"), F.when(F.col("o_orderkey") % 3 == 0, "ha").when(F.col("o_orderkey") % 3 == 1, "acre")
    place = F.row_number().over(W.partitionBy("o_custkey").orderBy("o_orderkey")) - 1
    p = t.orders.select(F.col("o_custkey").alias("document_id"), k.alias("parcel_id"), place.alias("row_index"), F.lit("table").alias("source"), unit.alias("area_unit"), F.concat((k % 7).cast("string"), F.lit(" "), unit).alias("area_text"), F.col("o_orderpriority").alias("parcel_number"), F.col("o_orderstatus").alias("owner_name"))
    some, i = p.filter("document_id % 5 = 0"), F.col("parcel_id")
    e = some.filter("parcel_id % 7 <> 3").select("document_id", "parcel_id", F.col("row_index").alias("place"), F.when(i % 4 == 1, "EDITED").otherwise(F.col("parcel_number")).alias("parcel_number"), "owner_name", F.when(i % 6 == 0, (i % 9).cast("string")).otherwise(F.col("area_text")).alias("area_text"))
    more = some.select("document_id").distinct().select("document_id", F.lit(None).cast("long").alias("parcel_id"), F.lit(1000000).alias("place"), F.lit("NEW").alias("parcel_number"), F.lit(None).cast("string").alias("owner_name"), F.lit("3").alias("area_text"))
    return p, e.unionByName(more)


@plan(f"""{_PARCELS}, u AS (SELECT document_id, area_unit AS unit FROM p WHERE area_unit IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, area_unit) = 1),
a AS (SELECT e.document_id, e.parcel_id, place AS row_index, e.parcel_number, e.area_text,
  CASE WHEN max(CASE WHEN p.parcel_id IS NULL OR e.parcel_number IS DISTINCT FROM p.parcel_number OR e.area_text IS DISTINCT FROM p.area_text THEN 1 ELSE 0 END) OVER (PARTITION BY e.document_id ORDER BY place) = 1 THEN 'human' ELSE 'table' END AS source
  FROM e LEFT JOIN p ON e.document_id = p.document_id AND e.parcel_id = p.parcel_id UNION ALL SELECT document_id, parcel_id, row_index, parcel_number, area_text, 'table' FROM p WHERE document_id % 5 <> 0),
n AS (SELECT a.*, CAST(split_part(area_text, ' ', 1) AS DOUBLE) AS area_value, CASE WHEN area_text IS NOT NULL THEN coalesce(nullif(split_part(area_text, ' ', 2), ''), unit) END AS area_unit FROM a LEFT JOIN u USING (document_id))
SELECT document_id, parcel_id, row_index, parcel_number, area_text, source, area_value, area_unit, round(area_value * CASE area_unit WHEN 'ha' THEN 10000 WHEN 'acre' THEN 4046.86 END, 2)::DOUBLE AS area_sqm FROM n""")
def parcel_edit_merge(t: Tables) -> DataFrame:
    return edited_parcels(*_parcels(t)).select("document_id", "parcel_id", "row_index", "parcel_number", "area_text", "source", "area_value", "area_unit", "area_sqm")


@plan(f"""{_PARCELS}, j AS (SELECT e.document_id, place + 1 AS parcel_row, p.parcel_number AS n0, e.parcel_number AS n1, p.area_text AS a0, e.area_text AS a1 FROM e LEFT JOIN p ON e.document_id = p.document_id AND e.parcel_id = p.parcel_id)
SELECT document_id, parcel_row, 'parcel_number' AS field, n0 AS old, n1 AS new FROM j WHERE n0 IS DISTINCT FROM n1 UNION ALL SELECT document_id, parcel_row, 'area', a0, a1 FROM j WHERE a0 IS DISTINCT FROM a1
UNION ALL SELECT document_id, row_index + 1, 'row', parcel_number, NULL FROM p WHERE document_id % 5 = 0 AND parcel_id % 7 = 3""")
def parcel_edit_log(t: Tables) -> DataFrame:
    return parcel_log(*_parcels(t))


@plan("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey % 20 <> 3 UNION ALL SELECT DISTINCT l_orderkey, 99, 'Z' FROM lineitem WHERE l_orderkey % 20 = 3")
def replace_children_(t: Tables) -> DataFrame:
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_returnflag")
    new = rows.filter("l_orderkey % 20 = 3").select("l_orderkey").distinct().select("l_orderkey", F.lit(99).alias("l_linenumber"), F.lit("Z").alias("l_returnflag"))
    return replace_children(rows, new, "l_orderkey")


_KEYED = (("documents", "orders", "o_orderkey"), ("fields", "events", "event_id"), ("parcels", "lineitem", "l_orderkey"), ("results", "customer", "c_custkey"), ("records", "part", "p_partkey"))


@plan(" UNION ALL ".join(f"SELECT '{name}' AS name, {key} AS document_id, count(*) AS n FROM {table} WHERE {key} NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') GROUP BY {key}" for name, table, key in _KEYED))
def cascade_delete(t: Tables) -> DataFrame:
    """Documents and four tables of what belongs to them, stored, less those of one status: how many rows are left of each."""
    parent, *children = [Stored(t.spark, new_path(t.spark, name), key, 16).write(getattr(t, table).select(key)) for name, table, key in _KEYED]
    delete_with_children(t.orders.filter("o_orderstatus = 'P'").select("o_orderkey"), parent, children)
    left = [x.read().groupBy(F.col(x.key).alias("document_id")).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "document_id", "n") for x, (name, *_) in zip((parent, *children), _KEYED, strict=True)]
    return reduce(DataFrame.unionAll, left)


@plan(f"""{_PARCELS}, u AS (SELECT document_id, area_unit AS unit FROM p WHERE area_unit IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY count(*) DESC, area_unit) = 1),
a AS (SELECT document_id, parcel_id, place AS row_index, parcel_number, owner_name, area_text FROM e UNION ALL SELECT document_id, parcel_id, row_index, parcel_number, owner_name, area_text FROM p WHERE document_id % 5 <> 0)
SELECT a.*, CASE WHEN area_text IS NOT NULL THEN coalesce(nullif(split_part(area_text, ' ', 2), ''), unit) END AS area_unit FROM a LEFT JOIN u USING (document_id)""")
def stored_edit(t: Tables) -> DataFrame:
    """Parcels in a stored table after their edits were written back: only the partitions of edited documents are read and rewritten."""
    parcels, edits = _parcels(t)
    table = Stored(t.spark, new_path(t.spark, "parcels"), "document_id", 16).write(parcels)
    keys = edits.select("document_id").distinct()
    old = table.read().join(keys, "document_id", "left_semi")
    table.replace(keys, edited_parcels(old, edits))
    return table.read().select("document_id", "parcel_id", "row_index", "parcel_number", "owner_name", "area_text", "area_unit")


@plan("""
WITH s AS (SELECT o_orderkey, ['uploaded', 'processing', 'extracted', 'auto_verified', 'pending_review', 'verified', 'rejected', 'failed'][o_orderkey % 8 + 1] AS before, ['uploaded', 'processing', 'extracted', 'auto_verified', 'pending_review', 'verified', 'rejected', 'failed'][o_custkey % 8 + 1] AS wanted FROM orders)
SELECT *, CASE WHEN wanted = 'processing' OR (before = 'processing' AND wanted IN ('extracted', 'failed')) OR (before = 'extracted' AND wanted IN ('auto_verified', 'pending_review', 'failed'))
  OR (before IN ('pending_review', 'auto_verified', 'extracted', 'verified') AND wanted IN ('verified', 'rejected')) THEN wanted END AS after FROM s""")
def state_machine(t: Tables) -> DataFrame:
    """Status changes that are allowed, and null for those that aren't."""
    states = F.array(*map(F.lit, STATUSES))
    s = t.orders.select("o_orderkey", F.get(states, (F.col("o_orderkey") % 8).cast("int")).alias("before"), F.get(states, (F.col("o_custkey") % 8).cast("int")).alias("wanted"))
    return s.withColumn("after", moved(F.col("before"), F.col("wanted")))


@plan("""
WITH n AS (SELECT l_orderkey AS k, count(*) FILTER (l_returnflag = 'R') AS e, count(*) FILTER (l_tax > 0.07) AS d, CASE WHEN max(l_quantity) > 5 THEN max(l_quantity) * 2 END AS c, bool_or(l_linenumber = 7) AS x FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY 1),
j AS (SELECT o_orderkey AS document_id, k, CASE WHEN k IS NULL THEN CASE WHEN o_orderstatus = 'F' THEN 'verified' ELSE 'pending_review' END WHEN x THEN 'failed' WHEN e = 0 AND d = 0 AND c >= 85 THEN 'auto_verified' ELSE 'pending_review' END AS status, o_orderstatus = 'F' AS v FROM orders LEFT JOIN n ON k = o_orderkey)
SELECT document_id, status, v OR (k IS NOT NULL AND status = 'auto_verified') AS is_verified FROM j""")
def reprocess(t: Tables) -> DataFrame:
    """Orders as documents; those with lines, but for every third, are processed again."""
    most = F.max("l_quantity").cast("double")
    reruns = t.lineitem.filter("l_orderkey % 3 <> 0").groupBy(F.col("l_orderkey").alias("document_id")).agg(
        F.bool_or(F.col("l_linenumber") == 7).alias("crashed"), F.count_if(F.col("l_returnflag") == "R").alias("failed_errors"),
        F.count_if(F.col("l_tax") > 0.07).alias("disagreements"), F.when(most > 5, most * 2).alias("confidence"),
    )
    done = F.col("o_orderstatus") == "F"
    return reprocessed(t.orders.select(F.col("o_orderkey").alias("document_id"), F.when(done, "verified").otherwise("pending_review").alias("status"), done.alias("is_verified")), reruns)


@plan("""
SELECT event_type AS before, lead_type AS after, count(*) AS n FROM (SELECT event_type, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS lead_type FROM events) WHERE lead_type IS NOT NULL GROUP BY 1, 2""")
def state_transitions(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    after = F.lead("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return t.events.select(F.col("event_type").alias("before"), after.alias("after")).filter("after is not null").groupBy("before", "after").agg(F.count("*").alias("n"))


@plan("""
SELECT doc_id, CASE WHEN coalesce(toxic, 0) = 0 AND coalesce(quality, 0) = 1 AND 50 + doc_id % 50 >= 85 THEN 'auto_verified' ELSE 'pending_review' END AS status FROM documents LEFT JOIN labels USING (doc_id)""")
def auto_accept(t: Tables) -> DataFrame:
    j = t.documents.select("doc_id").join(t.labels, "doc_id", "left")
    return j.select("doc_id", auto_accepted(F.coalesce("toxic", F.lit(0)), 1 - F.coalesce("quality", F.lit(0)), 50 + F.col("doc_id") % 50).alias("status"))


@plan("SELECT doc_id, 'district' AS field_name, source AS value, 100.0::DOUBLE AS confidence FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def metadata_injection(t: Tables) -> DataFrame:
    """What was given at upload counts, with full confidence, only where nothing was extracted."""
    return t.documents.join(t.labels, "doc_id", "left_anti").select("doc_id", F.lit("district").alias("field_name"), F.col("source").alias("value"), F.lit(100.0).alias("confidence"))


_RECORD = """
WITH f AS (SELECT o_orderkey AS document_id, ['owner_name', 'village', 'khasra_number', 'plot_area', 'total_area', 'pargana', 'state', 'record_year'][i] AS field_name,
  [CASE WHEN o_orderkey % 3 = 0 THEN 'Owner ' || o_custkey END, o_orderpriority, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey AS VARCHAR) ELSE '' END, CASE WHEN o_orderkey % 5 < 2 THEN o_custkey || ' ha' WHEN o_orderkey % 5 = 2 THEN 'unread' END,
   CASE WHEN o_orderkey % 2 = 0 THEN o_custkey || ' acre' END, CASE WHEN o_orderkey % 7 = 0 THEN 'P' || o_custkey ELSE '' END, 'read', CAST(year(o_orderdate) AS VARCHAR)][i] AS v,
  CASE WHEN o_orderkey % 11 = 0 AND i IN (1, 8) THEN 'fixed' WHEN o_orderkey % 13 = 0 AND i = 5 THEN '7 acre' END AS c FROM orders, range(1, 9) t(i)),
w AS (SELECT document_id, max(CASE WHEN field_name = 'owner_name' THEN coalesce(c, v) END) AS owner, max(CASE WHEN field_name = 'village' THEN v END) AS village, max(CASE WHEN field_name = 'khasra_number' THEN v END) AS khasra, max(CASE WHEN field_name = 'plot_area' THEN v END) AS plot,
  max(CASE WHEN field_name = 'total_area' THEN coalesce(c, v) END) AS total, max(CASE WHEN field_name = 'pargana' THEN v END) AS pargana, max(CASE WHEN field_name = 'state' THEN v END) AS state, max(CASE WHEN field_name = 'record_year' THEN coalesce(c, v) END) AS record_year FROM f GROUP BY 1),
p AS (SELECT l_orderkey AS document_id, count(*) AS n, CAST(arg_min(l_partkey, (l_linenumber, CAST(l_partkey AS VARCHAR))) AS VARCHAR) AS first, CAST(arg_max(l_partkey, (l_linenumber, CAST(l_partkey AS VARCHAR))) AS VARCHAR) AS last, count(DISTINCT l_suppkey) AS o, CAST(min(l_suppkey) AS VARCHAR) AS one, round(sum(l_quantity), 2) AS area FROM lineitem GROUP BY 1),
a AS (SELECT document_id, CASE WHEN plot LIKE '% ha' THEN plot WHEN total <> '' THEN total END AS t FROM w)
SELECT o_orderkey AS document_id, CASE WHEN o_orderstatus = 'F' THEN 'given' ELSE state END AS state, village, CASE WHEN khasra <> '' THEN khasra WHEN n = 1 THEN first ELSE first || '-' || last END AS khasra_number,
  CASE WHEN owner IS NOT NULL THEN owner WHEN o = 1 THEN one ELSE o || ' owners' END AS owner_name, record_year, CAST(split_part(t, ' ', 1) AS DOUBLE) AS plot_area_value, split_part(t, ' ', 2) AS plot_area_unit,
  coalesce(nullif(round(CAST(split_part(t, ' ', 1) AS DOUBLE) * CASE WHEN t LIKE '% ha' THEN 10000 ELSE 4046.86 END, 2), 0), area)::DOUBLE AS plot_area_sqm,
  CASE WHEN pargana <> '' OR total <> '' THEN '{' || concat_ws(',', '"pargana":"' || nullif(pargana, '') || '"', '"total_area":"' || nullif(total, '') || '"') || '}' END AS extra
FROM orders JOIN w ON document_id = o_orderkey LEFT JOIN a USING (document_id) LEFT JOIN p USING (document_id)"""


def _readings(t: Tables) -> DataFrame:
    """Eight fields of each order, some unread, some blank, some corrected, each also in a less confident reading."""
    k, c, no = F.col("o_orderkey"), F.col("o_custkey").cast("string"), F.lit(None).cast("string")
    kinds = (
        ("owner_name", F.when(k % 3 == 0, F.concat(F.lit("Owner "), c)), F.when(k % 11 == 0, "fixed")), ("village", F.col("o_orderpriority"), no), ("khasra_number", F.when(k % 4 == 0, c).otherwise(""), no),
        ("plot_area", F.when(k % 5 < 2, F.concat(c, F.lit(" ha"))).when(k % 5 == 2, "unread"), no), ("total_area", F.when(k % 2 == 0, F.concat(c, F.lit(" acre"))), F.when(k % 13 == 0, "7 acre")),
        ("pargana", F.when(k % 7 == 0, F.concat(F.lit("P"), c)).otherwise(""), no), ("state", F.lit("read"), no), ("record_year", F.year("o_orderdate").cast("string"), F.when(k % 11 == 0, "fixed")),
    )
    best = [F.struct(F.lit(n).alias("field_name"), v.alias("normalized_value"), x.alias("corrected_value"), F.lit(90.0).alias("confidence")) for n, v, x in kinds]
    worse = [F.struct(F.lit(n).alias("field_name"), F.when(v.isNotNull(), "worse").alias("normalized_value"), no.alias("corrected_value"), F.lit(20.0).alias("confidence")) for n, v, _ in kinds]
    return t.orders.select(k.alias("document_id"), F.explode(F.array(*best, *worse)).alias("f")).select("document_id", "f.*")


@plan(_RECORD)
def record_upsert(t: Tables) -> DataFrame:
    """Records from readings and parcels: corrections first, area and names from parcels where no field has them, the rest in extra."""
    documents = t.orders.select(F.col("o_orderkey").alias("document_id"), F.when(F.col("o_orderstatus") == "F", "given").otherwise("").alias("state"), F.lit(None).cast("string").alias("district"))
    parcels = t.lineitem.select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("row_index"), F.col("l_partkey").cast("string").alias("parcel_number"), F.col("l_suppkey").cast("string").alias("owner_name"), F.col("l_quantity").alias("area_sqm"))
    r = records_of(documents, _readings(t), parcels)
    return r.select("document_id", "state", "village", "khasra_number", "owner_name", "record_year", "plot_area_value", "plot_area_unit", "plot_area_sqm", F.to_json("extra").alias("extra"))


@plan("""
WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_partkey % 3 WHEN 0 THEN l_quantity::INT || ' acre' WHEN 1 THEN CAST(l_quantity::INT AS VARCHAR) END AS area_text, CASE WHEN l_suppkey % 2 = 0 THEN 'ha' END AS hint,
  CASE WHEN l_suppkey % 5 = 0 THEN 'Wheat' WHEN l_suppkey % 5 = 1 THEN 'rice' ELSE 'grm ' END AS crop, [x for x in [l_quantity * 2, l_suppkey % 4 * 25, 0] if x > 0] AS sure FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, area_text, CASE WHEN area_text LIKE '% acre' THEN 'acre' WHEN area_text IS NOT NULL THEN hint END AS unit,
  round(CAST(split_part(area_text, ' ', 1) AS DOUBLE) * CASE WHEN area_text LIKE '% acre' THEN 4046.86 WHEN hint = 'ha' THEN 10000 END, 2)::DOUBLE AS area_sqm, CASE crop WHEN 'grm ' THEN 'gram' WHEN 'Wheat' THEN 'gehun' ELSE crop END AS crop,
  round(list_sum(sure) / len(sure), 1) AS confidence, round(list_sum(sure) / len(sure), 1) < 85 AS needs_review FROM r""")
def parcel_builder(t: Tables) -> DataFrame:
    """Parcels from table rows: bare figures take their heading's unit, crops are corrected by what reviewers did, cells' confidences are averaged."""
    q, s = F.col("l_quantity").cast("int").cast("string"), F.col("l_suppkey")
    rows = t.lineitem.select(
        F.col("l_orderkey").alias("document_id"), F.struct("l_linenumber", "l_partkey", s.alias("s")).alias("row_index"), F.col("l_partkey").cast("string").alias("parcel_number"), F.when(F.col("l_partkey") % 3 == 0, F.concat(q, F.lit(" acre"))).when(F.col("l_partkey") % 3 == 1, q).alias("area"),
        F.lit(None).cast("string").alias("area_unit"), F.when(s % 2 == 0, "ha").alias("unit_hint"), F.when(s % 5 == 0, "Wheat").when(s % 5 == 1, "rice").otherwise("grm ").alias("crop"),
        F.create_map(F.lit("area"), F.col("l_quantity") * 2.0, F.lit("crop"), (s % 4 * 25).cast("double"), F.lit("share"), F.lit(0.0)).alias("confidences"),
    )
    lexicon = t.spark.createDataFrame([("crop", "grm", "gram", 1), ("crop", "wheat", "old", 2), ("crop", " WHEAT", "gehun", 3)], "field_name string, ocr_value string, corrected_value string, id int")
    p = built_parcels(rows, lexicon)
    return p.select(F.col("document_id").alias("l_orderkey"), "row_index.l_linenumber", "row_index.l_partkey", "area_text", F.col("area_unit").alias("unit"), "area_sqm", "crop", "confidence", "needs_review")


@plan("SELECT o_orderkey AS document, j AS parcel, 100 + 7 * o_orderkey + 3 * j AS khasra, 2 + j % 4 AS bigha, 5 + (3 * j) % 15 AS biswa, round((2 + j % 4) * 2529.28 + (5 + (3 * j) % 15) * 126.46, 1)::DOUBLE AS sqm FROM orders, range(6) b(j) WHERE j < 5 + o_orderkey % 2")
def bulk_generate(t: Tables) -> DataFrame:
    """Demo parcels of all orders by formula: five or six per document, by parity."""
    r = t.orders.select(F.col("o_orderkey").alias("document"), F.explode(F.sequence(F.lit(0).cast("long"), 4 + F.col("o_orderkey") % 2)).alias("parcel"))
    bigha, biswa = 2 + F.col("parcel") % 4, 5 + (3 * F.col("parcel")) % 15
    return r.select("document", "parcel", (100 + 7 * F.col("document") + 3 * F.col("parcel")).alias("khasra"), bigha.alias("bigha"), biswa.alias("biswa"), F.round(bigha * 2529.28 + biswa * 126.46, 1).alias("sqm"))


@plan("SELECT doc_id, sha256(text) AS sha FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) AND doc_id % 2 = 1")
def ingest_anti(t: Tables) -> DataFrame:
    """Uploads whose content the catalog doesn't have yet."""
    d = t.documents.select("doc_id", F.sha2("text", 256).alias("sha"))
    return d.filter("doc_id % 2 = 1").join(d.filter("doc_id % 2 = 0").select("sha"), "sha", "left_anti").select("doc_id", "sha")


@plan("SELECT source, count(*) AS n, round(sum(balance), 2) AS balance FROM (SELECT 'A' AS source, s_acctbal AS balance FROM supplier UNION ALL SELECT 'B', s_acctbal FROM supplier UNION ALL SELECT 'A', c_acctbal FROM customer) GROUP BY source")
def append_external(t: Tables) -> DataFrame:
    """Snapshots are appended as they come, without merging; one that is pushed twice counts once."""
    path = new_path(t.spark, "external")
    a, b, c = t.supplier.select(F.lit("A").alias("source"), F.col("s_acctbal").alias("balance")), t.supplier.select(F.lit("B").alias("source"), F.col("s_acctbal").alias("balance")), t.customer.select(F.lit("A").alias("source"), F.col("c_acctbal").alias("balance"))
    for push, rows in ((1, a), (2, b), (3, c), (2, b)):
        sync_external(rows, path, push)
    return appended(t.spark, path).groupBy("source").agg(F.count("*").alias("n"), F.round(F.sum("balance"), 2).alias("balance"))


@plan()
def learned_corrections(t: Tables) -> DataFrame:
    """Reviewers' corrections applied to later readings, equal ones first, then similar ones."""
    seen, k = F.md5(F.col("c_custkey").cast("string").cast("binary")), F.col("c_custkey")
    c = t.customer.select(F.lit("owner_name").alias("field_name"), seen.alias("ocr_value"), F.concat(F.lit("Corrected "), k.cast("string")).alias("corrected_value"), k.alias("id"))
    v = t.customer.select(F.lit("owner_name").alias("field_name"), F.when(k % 2 == 0, F.upper(seen)).otherwise(F.concat(F.substring(seen, 2, 40), F.lit("x"))).alias("value"))
    return corrected(v, c)
