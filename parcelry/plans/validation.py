"""Validation rules over orders (records) and line items (parcels)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.operators import rules
from parcelry.plans.registry import plan
from parcelry.sources.stored import new_path
from parcelry.sources.tables import Tables


def _records(t: Tables) -> DataFrame:
    k = F.col("o_orderkey")
    return t.orders.select(
        k.alias("document_id"), F.when(k % 7 != 0, F.concat(F.lit("Owner#"), F.col("o_custkey").cast("string"))).alias("owner_name"), F.when(k % 11 != 0, F.concat(F.lit("V"), (k % 20).cast("string"))).alias("village"),
        F.when(k % 3 == 0, (k % 50).cast("string")).alias("khasra_number"), F.when(k % 5 == 0, F.concat((k % 40).cast("string"), F.lit("/A"))).alias("survey_number"), F.lit("").alias("khata_number"),
        (F.col("o_totalprice") * 20).alias("plot_area_sqm"), F.when(k % 4 != 0, F.col("o_totalprice")).alias("stated_sqm"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("mutation_date"), F.when(k % 2 == 0, F.date_format("o_orderdate", "d/M/yyyy")).otherwise(F.lit("1995-01-01")).alias("registration_date"),
        F.when(k % 3 == 0, F.col("o_totalprice") * 0.6).alias("irrigated_sqm"), F.when(k % 6 == 0, F.col("o_totalprice") * 0.4).alias("unirrigated_sqm"),
    )


def _parcels(t: Tables) -> DataFrame:
    owner = F.when(F.col("l_linenumber") != 5, F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))
    number = F.when(F.col("l_partkey") % 97 != 0, F.concat((F.col("l_partkey") % 10).cast("string"), F.when(F.col("l_partkey") % 89 == 0, "x").otherwise("")))
    return t.lineitem.select(F.col("l_orderkey").alias("document_id"), owner.alias("owner_name"), number.alias("parcel_number"), F.col("l_extendedprice").alias("area_sqm"))


_R = """WITH r AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 7 <> 0 THEN 'Owner#' || o_custkey END AS owner_name, CASE WHEN o_orderkey % 11 <> 0 THEN 'V' || o_orderkey % 20 END AS village,
  CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey % 50 AS VARCHAR) END AS khasra_number, CASE WHEN o_orderkey % 5 = 0 THEN (o_orderkey % 40) || '/A' END AS survey_number, o_totalprice * 20 AS plot_area_sqm,
  CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END AS stated_sqm, strftime(o_orderdate, '%Y-%m-%d') AS mutation_date, o_orderkey % 2 = 0 AS odd_date, o_totalprice AS price FROM orders),
p AS (SELECT l_orderkey AS document_id, CASE WHEN l_linenumber <> 5 THEN 'S' || l_suppkey END AS owner_name, CASE WHEN l_partkey % 97 <> 0 THEN (l_partkey % 10) || CASE WHEN l_partkey % 89 = 0 THEN 'x' ELSE '' END END AS parcel_number, l_extendedprice AS area_sqm FROM lineitem)
"""


@plan(_R + """, n AS (SELECT document_id, count(*) AS n, count(owner_name) AS named FROM p GROUP BY 1), j AS (SELECT r.*, n, named FROM r LEFT JOIN n USING (document_id))
SELECT document_id, 'owner_name' AS field_name, CASE WHEN n > 0 THEN n = named ELSE owner_name IS NOT NULL END AS passed FROM j
UNION ALL SELECT document_id, 'village', village IS NOT NULL FROM j UNION ALL SELECT document_id, NULL, khasra_number IS NOT NULL OR survey_number IS NOT NULL FROM j""")
def rule_mandatory(t: Tables) -> DataFrame:
    return rules.mandatory_fields(_records(t), _parcels(t)).select("document_id", "field_name", "passed")


@plan(_R + "SELECT document_id, plot_area_sqm BETWEEN 1 AND 5000000 AS passed, CASE WHEN plot_area_sqm BETWEEN 1 AND 5000000 THEN 'info' ELSE 'error' END AS severity FROM r")
def rule_area_range(t: Tables) -> DataFrame:
    return rules.area_range(_records(t), _parcels(t)).select("document_id", "passed", "severity")


@plan(_R + "SELECT document_id, 'khasra_number' AS field_name, true AS passed FROM r WHERE khasra_number IS NOT NULL UNION ALL SELECT document_id, 'survey_number', true FROM r WHERE survey_number IS NOT NULL UNION ALL SELECT document_id, 'khata_number', false FROM r")
def rule_identifier(t: Tables) -> DataFrame:
    return rules.identifier_format(_records(t), _parcels(t)).select("document_id", "field_name", "passed")


@plan(_R + """SELECT document_id, 'mutation_date' AS field_name, true AS passed FROM r UNION ALL SELECT document_id, 'registration_date', NOT odd_date OR false FROM r WHERE NOT odd_date
UNION ALL SELECT document_id, 'registration_date', length(strftime(o_orderdate, '%-d/%-m/%Y')) = 10 AND left(strftime(o_orderdate, '%-d/%-m/%Y'), 2) IN ('18', '19', '20') FROM orders, r WHERE o_orderkey = document_id AND odd_date
UNION ALL SELECT document_id, 'mutation_date', mutation_date >= CASE WHEN odd_date THEN strftime(o_orderdate, '%-d/%-m/%Y') ELSE '1995-01-01' END FROM orders, r WHERE o_orderkey = document_id AND (NOT odd_date OR length(strftime(o_orderdate, '%-d/%-m/%Y')) = 10)""")
def rule_dates(t: Tables) -> DataFrame:
    return rules.date_consistency(_records(t), _parcels(t)).select("document_id", "field_name", "passed")


@plan(_R + """, s AS (SELECT document_id, round(sum(area_sqm), 2) AS total FROM p GROUP BY 1) SELECT document_id, CASE WHEN stated_sqm IS NULL THEN true ELSE abs(total - stated_sqm) <= greatest(0.02 * stated_sqm, 50) END AS passed,
  CASE WHEN stated_sqm IS NULL THEN 'info' ELSE 'warning' END AS severity FROM r JOIN s USING (document_id)""")
def rule_area_total(t: Tables) -> DataFrame:
    return rules.parcel_area_total(_records(t), _parcels(t)).select("document_id", "passed", "severity")


@plan(_R + """, c AS (SELECT document_id, parcel_number AS k, count(*) AS c FROM p GROUP BY 1, 2)
SELECT document_id, 'parcel_number' AS field_name, 'error' AS severity, NOT bool_or(k IS NULL) AS passed, CASE WHEN bool_or(k IS NULL) THEN 'Parcel rows without a number: ' || sum(c) FILTER (k IS NULL) ELSE 'Every parcel row has a number' END AS message FROM c GROUP BY 1
UNION ALL SELECT document_id, 'parcel_number', 'error', NOT coalesce(bool_or(k IS NOT NULL AND c > 1), false), coalesce('Duplicate parcel numbers on this sheet: ' || string_agg(k, ', ' ORDER BY k) FILTER (k IS NOT NULL AND c > 1), 'Parcel numbers are unique') FROM c GROUP BY 1
UNION ALL SELECT document_id, 'parcel_number', 'warning', NOT coalesce(bool_or(k LIKE '%x'), false), coalesce('Parcel numbers with unexpected characters: ' || string_agg(k, ', ' ORDER BY k) FILTER (k LIKE '%x'), 'Parcel numbers are well formed') FROM c GROUP BY 1""")
def rule_duplicates(t: Tables) -> DataFrame:
    return rules.parcel_identifiers(_records(t), _parcels(t)).drop("rule_id")


@plan("""
SELECT user_id, bool_and(value >= 60) AS passed, coalesce('Low-confidence fields require review: ' || string_agg(event_type, ', ' ORDER BY event_type) FILTER (value < 60), 'No field below review threshold') AS message FROM events GROUP BY user_id""")
def rule_low_confidence(t: Tables) -> DataFrame:
    fields = t.events.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("field_name"), F.col("value").alias("confidence"))
    return rules.low_confidence(fields).select(F.col("document_id").alias("user_id"), "passed", "message")


@plan("""
SELECT o_orderkey AS document_id, abs(o_totalprice * CASE WHEN o_orderkey % 6 = 0 THEN 1.0 ELSE 0.6 END - o_totalprice) <= greatest(0.02 * o_totalprice, 50) AS passed FROM orders WHERE o_orderkey % 4 <> 0 AND o_orderkey % 3 = 0""")
def irrigation_split(t: Tables) -> DataFrame:
    return rules.irrigation_split(_records(t), _parcels(t)).select("document_id", "passed")


@plan("""SELECT o_orderkey AS document_id, o_orderkey % 5 <> 1 AND year(o_orderdate) BETWEEN 1850 AND 1996 AS passed FROM orders WHERE o_orderkey % 5 <> 0""")
def rule_plausible_dates(t: Tables) -> DataFrame:
    """Every fifth order has no date, and another fifth one without a year: the former have no outcome, the latter fail."""
    k = F.col("o_orderkey")
    value = F.when(k % 5 == 0, F.when(k % 2 == 0, "")).when(k % 5 == 1, F.date_format("o_orderdate", "dd.MM.yy")).otherwise(F.date_format("o_orderdate", "dd.MM.yyyy"))
    fields = t.orders.select(k.alias("document_id"), F.lit("record_date").alias("field_name"), value.alias("value"))
    return rules.plausible_dates(fields, 1996).select("document_id", "passed")


def _hashes(t: Tables) -> DataFrame:
    """Orders of one customer and price band as byte-identical documents."""
    return t.orders.select(F.col("o_orderkey").alias("document_id"), F.sha2(F.concat_ws("-", "o_custkey", F.floor(F.col("o_totalprice") / 30000)), 256).alias("sha256"))


@plan("""
WITH d AS (SELECT o_orderkey AS id, o_custkey AS c, floor(o_totalprice / 30000) AS b FROM orders)
SELECT id AS document_id, o IS NULL AS passed, CASE WHEN o IS NULL THEN 'info' ELSE 'error' END AS severity, coalesce('Exact duplicate of document ' || o, 'No byte-identical duplicate') AS message
FROM (SELECT d.id, (SELECT min(e.id) FROM d AS e WHERE e.c = d.c AND e.b = d.b AND e.id <> d.id) AS o FROM d)""")
def rule_duplicate_document(t: Tables) -> DataFrame:
    return rules.duplicate_document(_hashes(t)).select("document_id", "passed", "severity", "message")


@plan(_R + """SELECT document_id, (SELECT min(o.document_id) FROM r AS o WHERE o.document_id <> r.document_id AND o.village = r.village AND (o.khasra_number = r.khasra_number OR o.survey_number = r.survey_number)) AS other_id FROM r WHERE village IS NOT NULL""")
def same_parcel(t: Tables) -> DataFrame:
    """The part of the duplicate rule that comes before owners are compared."""
    return rules.same_parcel(_records(t)).select("document_id", "other_id")


@plan()
def duplicate_records(t: Tables) -> DataFrame:
    """Records of one village with an equal number; their owners are compared by similarity, which SQL lacks."""
    return rules.duplicate_records(_records(t))


def _external(t: Tables) -> DataFrame:
    """Suppliers as the external mirror."""
    k = F.col("s_suppkey")
    return t.supplier.select(
        k.alias("id"), F.lit("LRMS").alias("source"), F.concat(F.lit("v"), (k % 20).cast("string")).alias("village"), (k % 50).cast("string").alias("khasra_number"), F.concat((k % 40).cast("string"), F.lit("/A")).alias("survey_number"),
        F.concat(F.lit("Owner#"), k.cast("string")).alias("owner_name"), F.abs("s_acctbal").alias("plot_area_sqm"), F.lit(None).cast("string").alias("khata_number"),
    )


@plan(_R + """, e AS (SELECT s_suppkey AS id, 'v' || s_suppkey % 20 AS village, CAST(s_suppkey % 50 AS VARCHAR) AS khasra, (s_suppkey % 40) || '/A' AS survey FROM supplier)
SELECT document_id, coalesce((SELECT min(id) FROM e WHERE khasra = khasra_number AND (r.village IS NULL OR e.village = lower(r.village))), (SELECT min(id) FROM e WHERE survey = survey_number AND (r.village IS NULL OR e.village = lower(r.village)))) AS external_id FROM r""")
def mirror_match(t: Tables) -> DataFrame:
    """The part of the cross-database rule that comes before fields are compared."""
    return rules.mirror_match(_records(t), _external(t)).select("document_id", F.col("e.id").alias("external_id"))


@plan()
def cross_db(t: Tables) -> DataFrame:
    return rules.cross_database(_records(t), _external(t))


@plan()
def all_rules(t: Tables) -> DataFrame:
    """How often each registered rule passed and failed, each run and written by itself."""
    r = _records(t)
    dates = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("mutation_date", "registration_date")])).alias("f")
    fields = r.select("document_id", "plot_area_sqm", dates).select("document_id", "f.*", (F.col("plot_area_sqm") % 100).alias("confidence"))
    found = rules.validate_to(new_path(t.spark, "validation"), records=r, parcels=_parcels(t), fields=fields, hashes=_hashes(t), external=_external(t), this_year=1996)
    return found.groupBy("rule_id", "severity", "passed").agg(F.count("*").alias("n")).orderBy("rule_id", "severity", "passed")


@plan("""
SELECT l_orderkey, round(100 * (0.45 * least(max(l_extendedprice) / 50000, 1) + 0.35 * least(max(l_quantity) / 60, 1) + 0.20 * least(count(*) / 6.0, 1)), 1) AS quality, max(l_quantity) < 8 AS blank, count(*) >= 2 AND count(DISTINCT l_linenumber) >= 3 AS plausible FROM lineitem GROUP BY l_orderkey""")
def quality_rules(t: Tables) -> DataFrame:
    """The numeric decision rules of page quality, blank pages and plausible tables, over numeric columns."""
    share = lambda c, top: F.least(c / top, F.lit(1.0))
    q = 100 * (0.45 * share(F.max("l_extendedprice"), 50000) + 0.35 * share(F.max("l_quantity"), 60) + 0.20 * share(F.count("*"), 6.0))
    return t.lineitem.groupBy("l_orderkey").agg(F.round(q, 1).alias("quality"), (F.max("l_quantity") < 8).alias("blank"), ((F.count("*") >= 2) & (F.count_distinct("l_linenumber") >= 3)).alias("plausible"))
