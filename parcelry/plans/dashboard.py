"""Dashboard, village and serving aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.operators.aggregates import histogram, mean_nonzero, percent, pivoted, progress, reliability, zero_filled
from parcelry.operators.records import different_numbers, place_partials, suggestion_partials, suggestions, village_owners, village_totals
from parcelry.operators.relational import tasks_for
from parcelry.plans.registry import plan
from parcelry.sources.stored import new_path
from parcelry.sources.tables import Tables


@plan("""
SELECT n_name, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS verified, count(*) FILTER (o_orderstatus = 'P') AS pending,
  count(*) FILTER (o_orderstatus = 'O') AS failed, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS progress_pct
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY total DESC, n_name""")
def geo_progress(t: Tables) -> DataFrame:
    o, s = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")), F.col("o_orderstatus")
    return progress(o, "n_name", s == "F", s == "P", s == "O").orderBy(F.desc("total"), "n_name")


@plan("""
SELECT level, place, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS verified FROM (
  SELECT 'region' AS level, r_name AS place, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'nation', n_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey) GROUP BY level, place""")
def geo_two_levels(t: Tables) -> DataFrame:
    """Both levels of places in one pass, by grouping sets."""
    o = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    per = o.groupingSets([[F.col("r_name")], [F.col("n_name")]], "r_name", "n_name").agg(F.grouping("r_name").alias("g"), F.count("*").alias("total"), F.count_if(F.col("o_orderstatus") == "F").alias("verified"))
    return per.select(F.when(F.col("g") == 0, "region").otherwise("nation").alias("level"), F.coalesce("r_name", "n_name").alias("place"), "total", "verified")


@plan("""
SELECT s AS status, count(o_orderkey) AS n FROM (VALUES ('F'), ('O'), ('P'), ('rejected')) d(s) LEFT JOIN orders ON o_orderstatus = s GROUP BY s""")
def status_histogram_zero_filled(t: Tables) -> DataFrame:
    dimension = t.spark.createDataFrame([("F",), ("O",), ("P",), ("rejected",)], "status string")
    return zero_filled(t.orders.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")), dimension, "status", "n")


@plan("""
SELECT count(*) AS total, count(*) FILTER (o_orderstatus <> 'P') AS processed, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / nullif(count(*) FILTER (o_orderstatus <> 'P'), 0), 1) AS auto_rate,
  round(avg(nullif(o_totalprice, 0)), 2) AS mean_price FROM orders""")
def funnel_kpis(t: Tables) -> DataFrame:
    done = F.count_if(F.col("o_orderstatus") != "P")
    return t.orders.agg(F.count("*").alias("total"), done.alias("processed"), percent(F.count_if(F.col("o_orderstatus") == "F"), done, 1).alias("auto_rate"), F.round(mean_nonzero(F.col("o_totalprice")), 2).alias("mean_price"))


@plan("SELECT coalesce(nullif(lang, ''), 'unknown') AS lang, count(*) AS n FROM documents GROUP BY 1")
def value_histogram(t: Tables) -> DataFrame:
    return histogram(t.documents, "lang", "unknown")


@plan("""
SELECT lang, count(*) AS fields, count(*) FILTER (quality = 0) AS corrections, round((1 - count(*) FILTER (quality = 0) / count(*)) * 100, 1) AS accuracy
FROM labels JOIN documents USING (doc_id) GROUP BY lang""")
def field_accuracy(t: Tables) -> DataFrame:
    j = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id")
    per = j.groupBy("lang").agg(F.count("*").alias("fields"), F.count_if(F.col("quality") == 0).alias("corrections"))
    return per.withColumn("accuracy", F.round((1 - F.col("corrections") / F.col("fields")) * 100, 1))


@plan("""
SELECT event_type, CAST(json_extract(props, '$.k') AS INT) AS severity, count(*) AS n FROM events WHERE value > 100 GROUP BY 1, 2""")
def failed_rule_stats(t: Tables) -> DataFrame:
    return t.events.filter("value > 100").groupBy("event_type", F.get_json_object("props", "$.k").cast("int").alias("severity")).agg(F.count("*").alias("n"))


@plan("SELECT lang, round(avg(quality), 4) AS mean_quality, CAST(sum(toxic) AS BIGINT) AS flagged FROM labels JOIN documents USING (doc_id) GROUP BY lang")
def avg_and_flag_sum(t: Tables) -> DataFrame:
    return t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").groupBy("lang").agg(F.round(F.avg("quality"), 4).alias("mean_quality"), F.sum(F.col("toxic").cast("long")).alias("flagged"))


@plan("""
SELECT strftime(d, '%Y-%m-%d') AS day, count(event_id) AS n FROM (SELECT CAST(range AS DATE) AS d FROM range(DATE '2024-01-20', DATE '2024-02-03', INTERVAL 1 DAY)) LEFT JOIN events ON CAST(ts AS DATE) = d GROUP BY d""")
def daily_throughput(t: Tables) -> DataFrame:
    """The 14 days up to a fixed end, days without events included."""
    days = t.spark.sql("SELECT date_format(d, 'yyyy-MM-dd') AS day FROM (SELECT explode(sequence(date'2024-01-20', date'2024-02-02')) AS d)")
    return zero_filled(t.events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n")), days, "day", "n")


@plan("""
WITH p AS (SELECT o_custkey AS owner, o_orderkey AS k, o_totalprice AS area FROM orders UNION ALL SELECT o_custkey, l_orderkey, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT owner, count(*) AS n, count(DISTINCT k) AS parcels, round(sum(area), 2) AS area FROM p GROUP BY owner ORDER BY area DESC, owner LIMIT 50""")
def owner_rollup_topk(t: Tables) -> DataFrame:
    """Records and all their parcels, per owner; the 50 with the largest area."""
    records = t.orders.select(F.col("o_custkey").alias("owner"), F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("area"))
    parcels = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("owner"), F.col("l_orderkey").alias("k"), F.col("l_extendedprice").alias("area"))
    per = records.unionByName(parcels).groupBy("owner").agg(F.count("*").alias("n"), F.count_distinct("k").alias("parcels"), F.round(F.sum("area"), 2).alias("area"))
    return per.orderBy(F.desc("area"), "owner").limit(50)


_PLACES = """
WITH r AS (SELECT o_orderkey AS document_id, r_name AS state, n_name AS district, c_mktsegment AS tehsil, 'V' || c_custkey % 7 AS village, c_name AS owner_name, CAST(o_orderkey AS VARCHAR) AS number, o_totalprice AS area, o_orderstatus = 'F' AS verified, o_orderdate, o_orderpriority
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
p AS (SELECT l_orderkey AS document_id, state, district, tehsil, village, CASE WHEN l_suppkey % 3 > 0 THEN 'Customer#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0') END AS owner_name, CASE WHEN l_partkey % 2 = 0 THEN CAST(l_partkey AS VARCHAR) END AS number, l_extendedprice AS area FROM lineitem JOIN r ON l_orderkey = document_id),
b AS (SELECT *, 'record' AS kind FROM (SELECT state, district, tehsil, village, owner_name, number, area, verified FROM r) UNION ALL SELECT state, district, tehsil, village, owner_name, number, area, NULL, 'parcel' FROM p)
"""
_TOTALS = "count(*) FILTER (kind = 'record') AS records, count(*) FILTER (kind = 'parcel') AS parcels, count(*) FILTER (verified) AS verified, count(*) FILTER (NOT verified) AS pending, count(DISTINCT number) AS khasras, min(number) AS lowest, max(number) AS highest, round(sum(area), 2) AS area_sqm, round(round(sum(area), 2) / 10000, 4) AS area_ha"


def _places(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Orders as records of places (region, nation, segment, a village by customer), order lines as their parcels."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    village = F.concat(F.lit("V"), (F.col("c_custkey") % 7).cast("string"))
    r = j.select(
        F.col("o_orderkey").alias("document_id"), F.col("r_name").alias("state"), F.col("n_name").alias("district"), F.col("c_mktsegment").alias("tehsil"), village.alias("village"), F.col("c_name").alias("owner_name"), F.col("o_orderkey").cast("string").alias("khasra_number"),
        F.col("o_totalprice").alias("plot_area_sqm"), (F.col("o_orderstatus") == "F").alias("is_verified"), F.col("o_orderdate").alias("created_at"), F.col("o_orderpriority").alias("land_classification"),
    )
    owner = F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("Customer#"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")))
    p = t.lineitem.select(F.col("l_orderkey").alias("document_id"), owner.alias("owner_name"), F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey").cast("string")).alias("parcel_number"), F.col("l_extendedprice").alias("area_sqm"))
    return r, p


@plan(f"""{_PLACES}, h AS (SELECT state, district, tehsil FROM r WHERE village ILIKE 'v3' ORDER BY document_id LIMIT 1)
SELECT 'v3' AS village, h.*, s.* FROM h, (SELECT {_TOTALS} FROM b WHERE village ILIKE 'v3') s""")
def village_summary(t: Tables) -> DataFrame:
    """One village by name, ignoring case: header of its first record, counts, different numbers, and the area of records and parcels."""
    r, p = _places(t)
    here = F.ilike("village", F.lit("v3"))
    head = r.filter(here).agg(F.min_by(F.struct("state", "district", "tehsil"), "document_id").alias("h")).filter("h is not null").select(F.lit("v3").alias("village"), "h.*")
    return head.join(F.broadcast(village_totals(place_partials(r.filter(here), p), [])))  # one row each


@plan(f"""{_PLACES} SELECT owner_name, count(*) AS records, round(coalesce(sum(area), 0), 2) AS area_sqm FROM b WHERE village ILIKE 'v3' AND owner_name IS NOT NULL GROUP BY owner_name ORDER BY area_sqm DESC, owner_name LIMIT 50""")
def village_owner_list(t: Tables) -> DataFrame:
    r, p = _places(t)
    return village_owners(place_partials(r.filter(F.ilike("village", F.lit("v3"))), p))


@plan(" UNION ALL ".join(f"SELECT * FROM ({_PLACES} SELECT {i} AS level, state, {'district' if i > 1 else 'NULL'} AS district, {'tehsil' if i > 2 else 'NULL'} AS tehsil, {_TOTALS} FROM b GROUP BY {', '.join(('state', 'district', 'tehsil')[:i])})" for i in (1, 2, 3)))
def place_levels(t: Tables) -> DataFrame:
    """Totals of states, districts and tehsils from one stored table of partials."""
    path = new_path(t.spark, "places")
    place_partials(*_places(t), tasks_for(t.orders, t.lineitem)).write.parquet(path)
    held = t.spark.read.parquet(path)
    numbers = different_numbers(held, ["state", "district", "tehsil"], tasks_for(held))
    none = F.lit(None).cast("string")

    def level(i: int) -> DataFrame:
        by = ["state", "district", "tehsil"][:i]
        got = village_totals(held, by, numbers)
        return got.select(F.lit(i).alias("level"), *[F.col(c) if c in by else none.alias(c) for c in ("state", "district", "tehsil")], *got.columns[i:])

    return level(1).unionByName(level(2)).unionByName(level(3))


@plan(f"""{_PLACES}, v AS (SELECT 'state' AS field, state AS value, o_orderdate FROM r UNION ALL SELECT 'district', district, o_orderdate FROM r WHERE state = (SELECT min(r_name) FROM region) UNION ALL SELECT 'tehsil', tehsil, o_orderdate FROM r WHERE state = (SELECT min(r_name) FROM region)
  UNION ALL SELECT 'village', village, o_orderdate FROM r WHERE state = (SELECT min(r_name) FROM region) AND tehsil = 'BUILDING' UNION ALL SELECT 'owner_name', owner_name, o_orderdate FROM r WHERE state = (SELECT min(r_name) FROM region) UNION ALL SELECT 'land_classification', o_orderpriority, o_orderdate FROM r WHERE state = (SELECT min(r_name) FROM region))
SELECT field, value, strftime(max(o_orderdate), '%Y-%m-%d') AS last_used, row_number() OVER (PARTITION BY field ORDER BY max(o_orderdate) DESC, value) AS place FROM v GROUP BY field, value QUALIFY place <= 15""")
def suggestions_recency(t: Tables) -> DataFrame:
    """Values last used in one state, and villages of one of its tehsils, from partials that serve every jurisdiction."""
    columns = ("state", "district", "tehsil", "village", "owner_name", "land_classification")
    state = t.region.agg(F.min("r_name")).first()[0]
    found = suggestions(suggestion_partials(_places(t)[0], columns), state=state, tehsil="BUILDING")
    return found.select("field", "value", F.date_format("last_used", "yyyy-MM-dd").alias("last_used"), "place")


@plan("""
SELECT o_orderkey, count(l_orderkey) AS parcels, round(coalesce(sum(l_quantity), 0), 2) AS area, CASE count(DISTINCT l_partkey) WHEN 0 THEN NULL WHEN 1 THEN CAST(min(l_partkey) AS VARCHAR) ELSE CAST(arg_min(l_partkey, (l_linenumber, l_partkey)) AS VARCHAR) || '-' || CAST(arg_max(l_partkey, (l_linenumber, l_partkey)) AS VARCHAR) END AS khasra,
  CASE count(DISTINCT l_suppkey) WHEN 0 THEN NULL WHEN 1 THEN CAST(min(l_suppkey) AS VARCHAR) ELSE count(DISTINCT l_suppkey) || ' owners' END AS owner
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def village_derived_header(t: Tables) -> DataFrame:
    """What a record's header takes from its parcels: the only number or first-last, the only owner or how many, the sum."""
    tasks = tasks_for(t.orders, t.lineitem)
    at = F.struct("l_linenumber", "l_partkey")
    per_owner = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition(tasks, "l_orderkey").groupBy("l_orderkey", "l_suppkey").agg(
        F.count("l_orderkey").alias("n"), F.sum("l_quantity").alias("area"), F.min(at).alias("first"), F.max(at).alias("last"), F.min("l_partkey").alias("low"), F.max("l_partkey").alias("high"),
    )
    lines = per_owner.groupBy("l_orderkey").agg(
        F.sum("n").alias("n"), F.sum("area").alias("area"), F.min("first").alias("first"), F.max("last").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"),
        F.count("l_suppkey").alias("owners"), F.min("l_suppkey").alias("owner"),
    )
    j = t.orders.select("o_orderkey").repartition(tasks, "o_orderkey").groupBy("o_orderkey").agg(F.count("*").alias("copies")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    text = lambda c: F.col(c).cast("string")
    khasra = F.when(F.col("low") == F.col("high"), text("low")).when(F.col("low") < F.col("high"), F.concat(text("first.l_partkey"), F.lit("-"), text("last.l_partkey")))
    owner = F.when(F.col("owners") == 1, text("owner")).when(F.col("owners") > 1, F.concat(text("owners"), F.lit(" owners")))
    return j.select("o_orderkey", F.coalesce(F.col("copies") * F.col("n"), F.lit(0)).alias("parcels"), F.round(F.coalesce(F.col("copies") * F.col("area"), F.lit(0.0)), 2).alias("area"), khasra.alias("khasra"), owner.alias("owner"))


@plan("""
SELECT count(DISTINCT o_custkey) AS owners, count(DISTINCT n_name) AS places, count(DISTINCT r_name) AS states, round(sum(o_totalprice), 2) AS area, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def kpi_distincts(t: Tables) -> DataFrame:
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    return j.agg(F.count_distinct("o_custkey").alias("owners"), F.count_distinct("n_name").alias("places"), F.count_distinct("r_name").alias("states"), F.round(F.sum("o_totalprice"), 2).alias("area"), F.count("*").alias("n"))


@plan("SELECT DISTINCT source FROM documents WHERE source IS NOT NULL ORDER BY source")
def distinct_options(t: Tables) -> DataFrame:
    return t.documents.select("source").filter("source is not null").distinct().orderBy("source")


@plan("""
WITH n AS (SELECT event_type, count(*) FILTER (user_id % 4 <> 1) AS n FROM events GROUP BY 1), c AS (SELECT event_type, count(*) AS corrections FROM events WHERE value < 20 GROUP BY 1)
SELECT event_type, n, coalesce(corrections, 0) AS corrections, round(greatest(0.7, least(1.0, 0.7 + 0.3 * (1 - coalesce(corrections, 0) / n))), 4) AS factor FROM n LEFT JOIN c USING (event_type) WHERE n >= 5""")
def reliability_(t: Tables) -> DataFrame:
    """Readings that aren't a human's, and corrections, per kind of event."""
    source = F.when(F.col("user_id") % 4 == 1, "human").otherwise("rule")
    return reliability(t.events.select("event_type", source.alias("source")), t.events.filter("value < 20"), "event_type")


@plan("""
SELECT l_orderkey, min(l_quantity) AS x, min(l_tax) AS y, max(l_quantity + 1) AS right_x, max(l_tax + 0.5) AS bottom, round(avg(CASE WHEN l_discount > 0 THEN l_discount END), 6) AS conf FROM lineitem GROUP BY l_orderkey""")
def line_boxes(t: Tables) -> DataFrame:
    """The union of the tokens' boxes of each line, and the mean of the positive confidences."""
    return t.lineitem.groupBy("l_orderkey").agg(F.min("l_quantity").alias("x"), F.min("l_tax").alias("y"), F.max(F.col("l_quantity") + 1).alias("right_x"), F.max(F.col("l_tax") + 0.5).alias("bottom"), F.round(F.avg(F.when(F.col("l_discount") > 0, F.col("l_discount"))), 6).alias("conf"))


@plan("""
WITH c AS (SELECT doc_id, CAST(quality * 90 AS DOUBLE) AS conf FROM labels UNION ALL SELECT event_id % 500, value FROM events)
SELECT doc_id, round(avg(conf), 1) AS confidence, round(avg(CASE WHEN conf > 0 THEN conf END), 1) AS positive FROM c GROUP BY doc_id""")
def doc_confidence(t: Tables) -> DataFrame:
    c = t.labels.select("doc_id", (F.col("quality") * 90).cast("double").alias("conf")).unionByName(t.events.select((F.col("event_id") % 500).alias("doc_id"), F.col("value").alias("conf")))
    return c.groupBy("doc_id").agg(F.round(F.avg("conf"), 1).alias("confidence"), F.round(F.avg(F.when(F.col("conf") > 0, F.col("conf"))), 1).alias("positive"))


@plan("SELECT l_orderkey, arg_min(f, (-c, f)) AS unit FROM (SELECT l_orderkey, l_returnflag AS f, count(*) AS c FROM lineitem GROUP BY 1, 2) GROUP BY l_orderkey")
def mode_unit(t: Tables) -> DataFrame:
    """The most frequent unit of each record; of equally frequent ones the first in order."""
    return t.lineitem.groupBy("l_orderkey").agg(F.mode("l_returnflag", True).alias("unit"))


@plan("""
SELECT o_orderkey, max(CASE WHEN l_linenumber = 1 THEN flags END) AS line_1, max(CASE WHEN l_linenumber = 2 THEN flags END) AS line_2, max(CASE WHEN l_linenumber = 3 THEN flags END) AS line_3,
  max(CASE WHEN l_linenumber = 4 THEN flags END) AS line_4, max(CASE WHEN l_linenumber = 5 THEN flags END) AS line_5, max(CASE WHEN l_linenumber = 6 THEN flags END) AS line_6, max(CASE WHEN l_linenumber = 7 THEN flags END) AS line_7
FROM (SELECT l_orderkey AS o_orderkey, l_linenumber, min(l_returnflag || '/' || l_linestatus) AS flags FROM lineitem GROUP BY 1, 2) GROUP BY o_orderkey""")
def eav_pivot(t: Tables) -> DataFrame:
    """Name and value rows as one wide row per record; the names are given, so no pass collects them."""
    rows = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), F.concat(F.lit("line_"), F.col("l_linenumber").cast("string")).alias("name"), F.concat_ws("/", "l_returnflag", "l_linestatus").alias("value"))
    return pivoted(rows, "o_orderkey", "name", "value", [f"line_{i}" for i in range(1, 8)])


@plan("SELECT n_name, count(*) AS records, round(100.0 * count(*) FILTER (o_orderstatus = 'F') / count(*))::DOUBLE AS coverage FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def village_coverage(t: Tables) -> DataFrame:
    """The verified share of each place's records, in whole percent."""
    j = t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
    per = j.groupBy("n_name").agg(F.count("*").alias("records"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    return per.select("n_name", "records", F.round(100 * F.col("done") / F.col("records")).alias("coverage"))
