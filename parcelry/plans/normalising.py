"""Normalisation functions over keys and names of the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.functions import text as tx
from parcelry.functions.area import compound_area_sqm, parse_area, shown_area, stated_area_sqm, unit_from_header
from parcelry.functions.dates import is_iso_like, parse_date, years_in
from parcelry.plans.registry import plan
from parcelry.sources.tables import Tables

_UNITS = ("ha", "acre", "bigha", "sq m", "furlong", "")


@plan("""
WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS BIGINT) AS q, CAST(l_orderkey % 6 AS BIGINT) AS m FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CAST(q AS DOUBLE) AS value, CASE m WHEN 0 THEN 'ha' WHEN 1 THEN 'acre' WHEN 2 THEN 'bigha' WHEN 3 THEN 'sq m' WHEN 4 THEN 'furlong' END AS unit,
  round(q * CASE m WHEN 0 THEN 10000.0 WHEN 1 THEN 4046.86 WHEN 2 THEN 2529.0 WHEN 3 THEN 1.0 END, 2)::DOUBLE AS sqm FROM a""")
def parse_area_q(t: Tables) -> DataFrame:
    unit = F.get(F.array(*map(F.lit, _UNITS)), (F.col("l_orderkey") % 6).cast("int"))
    area = parse_area(F.concat(F.col("l_quantity").cast("long").cast("string"), F.lit(" "), unit))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", area.alias("a")).select("l_orderkey", "l_linenumber", "l_partkey", "a.value", "a.unit", "a.sqm")


@plan("""
SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'no date ' || o_orderkey ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders""")
def parse_date_q(t: Tables) -> DataFrame:
    m, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    written = F.when(m == 0, F.date_format(d, "d/M/yyyy")).when(m == 1, F.date_format(d, "dd-MM-yyyy")).when(m == 2, F.date_format(d, "dd.MM.yyyy")).when(m == 3, F.date_format(d, "dd/MM/yy")).otherwise(F.concat(F.lit("no date "), F.col("o_orderkey").cast("string")))
    return t.orders.select("o_orderkey", parse_date(written).alias("iso"))


@plan("SELECT p_partkey, '015' || p_partkey || '/10' AS number FROM part")
def normalise_number_q(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.normalize_number(F.concat(F.lit(" .OlS"), F.col("p_partkey").cast("string"), F.lit("|I o-"))).alias("number"))


@plan("SELECT p_partkey, '10/' || p_partkey AS parcel FROM part")
def clean_parcel_q(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.clean_parcel_number(F.concat(F.lit("/lo//"), F.col("p_partkey").cast("string"), F.lit(" x/"))).alias("parcel"))


@plan("SELECT p_partkey, p_size || '.1' || p_size || CASE WHEN p_partkey % 2 = 0 THEN ' ha' ELSE '' END AS area FROM part")
def clean_area_q(t: Tables) -> DataFrame:
    size = F.col("p_size").cast("string")
    return t.part.select("p_partkey", tx.clean_area(F.concat(size, F.lit("..f"), size, F.when(F.col("p_partkey") % 2 == 0, " ha.").otherwise(" "))).alias("area"))


@plan("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS digits FROM part")
def digits_q(t: Tables) -> DataFrame:
    from parcelry.functions.constants import ASCII_DIGITS, DEVANAGARI_DIGITS

    there = F.translate(F.col("p_partkey").cast("string"), ASCII_DIGITS, DEVANAGARI_DIGITS)
    return t.part.select("p_partkey", tx.ascii_digits(there).alias("digits"))


def _contains(keys: list[str]) -> str:
    return " OR ".join(f"contains(lower(text), '{k}')" for k in keys)


def _doc_type_sql() -> str:
    from parcelry.functions.constants import DOC_TYPES

    return "SELECT doc_id, CASE " + " ".join(f"WHEN {_contains(list(ks))} THEN '{n}'" for n, ks in DOC_TYPES) + " ELSE 'unknown' END AS doc_type FROM documents"


@plan(_doc_type_sql())
def doc_type_q(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.doc_type(F.col("text")).alias("doc_type"))


@plan("""
SELECT o_orderkey, year(o_orderdate) AS y, year(o_orderdate) BETWEEN 1993 AND 1997 AS plausible FROM orders""")
def year_check_q(t: Tables) -> DataFrame:
    years = years_in(F.concat(F.lit("on "), F.date_format("o_orderdate", "d.M.yyyy"), F.lit(" no 12345")))
    return t.orders.select("o_orderkey", years[0].alias("y"), F.forall(years, lambda y: y.between(1993, 1997)).alias("plausible"))


@plan("SELECT o_orderkey, o_orderkey % 3 = 0 AS iso FROM orders")
def iso_check_q(t: Tables) -> DataFrame:
    written = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.date_format("o_orderdate", "d/M/yy"))
    return t.orders.select("o_orderkey", is_iso_like(written).alias("iso"))


@plan("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower('  ' || p_name || ' -- ' || p_brand || '#'), '[^\\pL\\pN\\s]', '', 'g'), '\\s+', ' ', 'g')) AS compared FROM part")
def compare_normalise(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", tx.comparable(F.concat(F.lit("  "), "p_name", F.lit(" -- "), "p_brand", F.lit("#"))).alias("compared"))


@plan("SELECT c_custkey, upper(substr(c_name, 1, 1)) || lower(substr(c_name, 2)) || '-Lal' AS name FROM customer")
def name_normalise(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", tx.normalize_name(F.concat(F.lit(" Shri.  "), "c_name", F.lit("-lAL ;"))).alias("name"))


@plan("""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN '10' || o_orderkey WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN CAST(o_orderkey AS VARCHAR) || '.0 ha' ELSE 'x ' || o_orderkey END AS v FROM orders""")
def field_dispatch(t: Tables) -> DataFrame:
    m, k = F.col("o_orderkey") % 4, F.col("o_orderkey").cast("string")
    field = F.get(F.array(*map(F.lit, ("khasra_number", "mutation_date", "plot_area", "remarks"))), m.cast("int"))
    value = F.when(m == 0, F.concat(F.lit("l O"), k)).when(m == 1, F.date_format("o_orderdate", "dd/MM/yyyy")).when(m == 2, F.concat(k, F.lit(" HA"))).otherwise(F.concat(F.lit(" x "), k, F.lit(" ")))
    return t.orders.select("o_orderkey", tx.normalize_field(field, value).alias("v"))


@plan("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'acre' WHEN 1 THEN 'ha' WHEN 2 THEN 'bigha' END AS unit FROM part""")
def header_unit(t: Tables) -> DataFrame:
    heading = F.get(F.array(*map(F.lit, ("Extent (Acre / bigha)", "रकबा (हे./बीघा)", "rakba bigha biswa", "extent"))), (F.col("p_partkey") % 4).cast("int"))
    return t.part.select("p_partkey", unit_from_header(heading).alias("unit"))


@plan("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_extendedprice >= 10000 THEN printf('%.3f ha', floor(l_extendedprice / 10) / 1000) ELSE printf('%.0f m2', floor(l_extendedprice / 10) * 10) END AS shown FROM lineitem")
def area_format(t: Tables) -> DataFrame:
    price = F.floor(F.col("l_extendedprice") / 10).cast("double") * 10
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", shown_area(price).alias("shown"))


@plan("SELECT page_id, CASE WHEN url LIKE '%.pdf' THEN '.pdf' ELSE '.bin' END AS extension, coalesce(nullif(left(regexp_extract(url, '([^/\\\\]*)$', 1), 256), ''), 'document') AS name FROM pages")
def safe_filename(t: Tables) -> DataFrame:
    return t.pages.select("page_id", tx.safe_extension(F.col("url")).alias("extension"), tx.safe_filename(F.col("url")).alias("name"))


@plan("SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' ELSE lang || ',eng' END AS packs, CASE lang WHEN 'en' THEN 'eng' ELSE lang || '+eng,eng+' || lang END AS orders FROM documents")
def lang_orderings(t: Tables) -> DataFrame:
    packs = tx.language_packs(F.array("lang", F.lit("zz"), F.lit("en")), ("eng", "fr", "de", "es"))
    return t.documents.select("doc_id", F.array_join(packs, ",").alias("packs"), F.array_join(tx.language_orderings(packs), ",").alias("orders"))


@plan("SELECT doc_id, array_to_string([CASE x WHEN 'en' THEN 'eng' WHEN 'hi' THEN 'hin' WHEN 'sa' THEN 'san' ELSE x END for x in [lang, 'hi', '', source, lang, 'sa'] if x <> '' AND x NOT IN ('en', 'fr', 'sa', 'src1')], ',') AS missing FROM documents")
def missing_languages(t: Tables) -> DataFrame:
    """The packs that each document asks for and that aren't installed."""
    asked = F.array("lang", F.lit("hi"), F.lit(""), "source", "lang", F.lit("sa"))
    return t.documents.select("doc_id", F.array_join(tx.missing_packs(asked, ("eng", "fr", "san", "src1")), ",").alias("missing"))


@plan("SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN p_size * 10000.0 WHEN 1 THEN p_size * 4046.86 ELSE p_size * 2529.0 + 5 * 126.45 END, 2)::DOUBLE AS sqm FROM part")
def compound_area(t: Tables) -> DataFrame:
    """Corrected readings: figures without letters are hectares, and all parts of a compound area count."""
    m, s = F.col("p_partkey") % 3, F.col("p_size").cast("string")
    bare, acre, both = stated_area_sqm(s), stated_area_sqm(F.concat(s, F.lit(" acre"))), compound_area_sqm(F.concat(s, F.lit(" bigha 5 biswa")))
    return t.part.select("p_partkey", F.when(m == 0, bare).when(m == 1, acre).otherwise(both).alias("sqm"))
