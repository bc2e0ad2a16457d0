"""Extraction plans: label and value pairs, shadow comparison, scores, shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelry.functions import fuzzy
from parcelry.functions import text as tx
from parcelry.functions.constants import ASCII_DIGITS, DEVANAGARI_DIGITS, LAND_CLASSES
from parcelry.operators import extraction as ex
from parcelry.operators.labels import TERMS, cleaned, label_matches
from parcelry.plans.registry import plan
from parcelry.sources.tables import Tables


@plan("""
WITH r AS (SELECT doc_id, lang, text AS p, CASE WHEN doc_id % 9 <> 0 THEN '  ' || replace(text, ' ', '  ') || CASE WHEN doc_id % 10 = 0 THEN ' misread' ELSE '!' END END AS s FROM documents),
c AS (SELECT lang, trim(regexp_replace(regexp_replace(lower(p), '[^\\pL\\pN\\s]', '', 'g'), '\\s+', ' ', 'g')) AS p, trim(regexp_replace(regexp_replace(lower(s), '[^\\pL\\pN\\s]', '', 'g'), '\\s+', ' ', 'g')) AS s FROM r)
SELECT lang, CASE WHEN s IS NULL THEN 'only_primary' WHEN p IS NULL THEN 'only_shadow' WHEN p = s THEN 'agree' ELSE 'disagree' END AS state, count(*) AS n FROM c GROUP BY 1, 2""")
def shadow_compare(t: Tables) -> DataFrame:
    """A first reading against a re-cased one that misses some documents and misreads others."""
    primary = t.documents.select(F.col("doc_id").alias("document_id"), F.col("lang").alias("field_name"), F.col("text").alias("value"))
    other = F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit("  ")), F.when(F.col("doc_id") % 10 == 0, " misread").otherwise("!"))
    shadow = t.documents.filter("doc_id % 9 <> 0").select(F.col("doc_id").alias("document_id"), F.col("lang").alias("field_name"), other.alias("value"))
    return ex.agreement(primary, shadow).groupBy(F.col("field_name").alias("lang"), "state").agg(F.count("*").alias("n"))


@plan("SELECT doc_id, CAST((SELECT count(*) FROM unnest(string_split_regex(trim(text), '[:;|]')) t(x) WHERE trim(x) <> '') AS INT) AS parts FROM documents")
def split_parts(t: Tables) -> DataFrame:
    parts = F.filter(F.split(F.trim("text"), "[:;|]"), lambda x: F.trim(x) != "")
    return t.documents.select("doc_id", F.size(parts).alias("parts"))


@plan()
def split_label_value(t: Tables) -> DataFrame:
    """Labelled lines made from orders, read back as fields: the label search is fuzzy, so SQL has no equal."""
    k = F.col("o_orderkey").cast("string")
    line = F.concat(F.lit("Khasra No : "), k, F.lit("  Village: Ram"), (F.col("o_custkey") % 9).cast("string"), F.lit("pur   Owner Name : Person "), F.col("o_custkey").cast("string"))
    return ex.candidates(t.orders.select(F.col("o_orderkey").alias("document_id"), F.lit(1).alias("line_no"), line.alias("line"), F.lit(90.0).alias("conf")))


def _label_sql() -> str:
    """Every fragment against every label: the longest common subsequence by rows of its table, one bit per letter of the label."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    terms = ", ".join(f"({i}, {quoted(label)}, '{field}')" for i, (label, field) in enumerate(TERMS))
    return rf"""
WITH l(o, label, field_name) AS (VALUES {terms}),
m AS (SELECT p_partkey, p_size % 6 AS kind, label AS x, p_size % length(label) + 1 AS k FROM part JOIN l ON o = p_partkey % {len(TERMS)}),
r AS (SELECT p_partkey, CASE kind WHEN 0 THEN x WHEN 1 THEN substr(x, 1, (k - 1)::INT) || substr(x, (k + 1)::INT) WHEN 2 THEN substr(x, 1, k::INT) || 'q' || substr(x, (k + 1)::INT) WHEN 3 THEN '(' || upper(x) || ' .:' WHEN 4 THEN x || substr(x, k::INT) ELSE substr(x, 1, (k - 1)::INT) || 'zq' || substr(x, (k + 2)::INT) END AS fragment FROM m),
c AS (SELECT *, trim(lower(trim(fragment)), '.:()') AS t FROM r),
d AS (SELECT DISTINCT t FROM c WHERE length(t) >= 2 AND (regexp_matches(t, '[\x{{0900}}-\x{{097F}}]') OR (length(regexp_replace(t, '[^\pL]', '', 'g')) >= 4 AND regexp_matches(t, '[aeiou]')))),
s AS (SELECT t, field_name, o, 200.0::DOUBLE * (length(label) - bit_count(list_reduce(list_prepend((1::BIGINT << length(label)) - 1, [list_sum([CASE WHEN substr(label, i::INT + 1, 1) = substr(t, j::INT, 1) THEN 1::BIGINT << i::INT ELSE 0 END for i in range(length(label))])::BIGINT for j in range(1, length(t) + 1)]),
  lambda v, h: ((v + (v & h)) | (v - (v & h))) & ((1::BIGINT << length(label)) - 1)))) / (length(label) + length(t)) AS score FROM d, l),
b AS (SELECT t, arg_max(field_name, (score, -o)) AS field_name, max(score) AS key_score FROM s WHERE score >= 85 GROUP BY t)
SELECT p_partkey, fragment, field_name, round(key_score, 6) AS key_score FROM c LEFT JOIN b USING (t)"""


@plan(_label_sql())
def label_search(t: Tables) -> DataFrame:
    """Labels with a letter lost, added or doubled, in capitals or torn, back to their fields; some no longer are any label."""
    labels = t.spark.createDataFrame([(i, label) for i, (label, _) in enumerate(TERMS)], "o int, label string")
    x, at = F.col("label"), F.col("p_size") % F.length("label") + 1
    edited = F.array(
        x, F.concat(F.substring(x, F.lit(1), at - 1), F.substring(x, at + 1, F.length(x))), F.concat(F.substring(x, F.lit(1), at), F.lit("q"), F.substring(x, at + 1, F.length(x))),
        F.concat(F.lit("("), F.upper(x), F.lit(" .:")), F.concat(x, F.substring(x, at, F.length(x))), F.concat(F.substring(x, F.lit(1), at - 1), F.lit("zq"), F.substring(x, at + 2, F.length(x))),
    )
    read = t.part.join(F.broadcast(labels), F.col("p_partkey") % len(TERMS) == F.col("o")).select("p_partkey", F.get(edited, (F.col("p_size") % 6).cast("int")).alias("read"))  # labels are fixed
    c = read.withColumn("fragment", cleaned(F.col("read")))
    found = c.join(label_matches(c.select("fragment").distinct()), "fragment", "left")
    return found.select("p_partkey", F.col("read").alias("fragment"), "field_name", F.round("key_score", 6).alias("key_score"))


@plan()
def conversation_fields(t: Tables) -> DataFrame:
    """Fields of whole conversations by labels, vocabulary and patterns: each turn's first words stand on a line of a form, with labels as they are misread."""
    words = F.split("text", " ")
    label = F.when(F.col("turn") % 3 == 0, "Ovner Name").when(F.col("turn") % 3 == 1, "Villlage").otherwise("Tehsi1")
    line = F.concat(label, F.lit(" : "), F.get(words, F.lit(0)), F.lit("   Khata No - "), (F.col("conv_id") % 97 + 1).cast("string"), F.lit("   "), "text")
    lines = t.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("line_no"), line.alias("line"), F.lit(50.0).alias("conf"))
    texts = t.conversations.groupBy(F.col("conv_id").alias("document_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return ex.extracted(lines, texts)


@plan("""
SELECT l_orderkey, l_linenumber, l_partkey, round(greatest(0, least(0.35 * 2 * l_quantity + 0.40 * (l_tax * 1000) + 25 * CASE WHEN l_linenumber <= 3 THEN 1 ELSE 0.36 END, 99)), 1) AS score, least(99, l_quantity + 10) AS learned,
  l_quantity < 85 OR l_returnflag = 'R' AS review, l_quantity + CASE WHEN l_linenumber <= 3 THEN 15 ELSE 0 END AS merged FROM lineitem""")
def score_merge_rules(t: Tables) -> DataFrame:
    q, good = F.col("l_quantity"), F.col("l_linenumber") <= 3
    valid = F.when(good, 1.0).otherwise(0.36)
    agreement = F.when(F.col("l_returnflag") == "R", "disagree").otherwise("agree")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", ex.score(2 * q, F.col("l_tax") * 1000, valid).alias("score"), ex.learned(q).alias("learned"), ex.needs_review(q, agreement).alias("review"), ex.merge_score(q, good, F.lit(True), F.col("l_linenumber").cast("string")).alias("merged"))


@plan("""
SELECT p_partkey, regexp_matches(p_name, '[\\w]') AS content, regexp_matches(p_brand, '^[\\pL\\pN#]+$') AND regexp_matches(p_brand, '[0-9]') AS identifier, length(regexp_replace(p_name, '[^!#$%&*+,;<=>?@]', '', 'g')) >= 3 AS signs, NOT regexp_matches(p_name, '[0-9]') AS person FROM part""")
def text_shape_checks(t: Tables) -> DataFrame:
    name, brand = F.col("p_name"), F.replace("p_brand", F.lit("#"), F.lit(""))
    return t.part.select("p_partkey", tx.has_content(F.array(name)).alias("content"), tx.is_identifier(brand).alias("identifier"), (tx.is_gibberish(F.lit("remarks"), name)).alias("signs"), tx.looks_like_person(name).alias("person"))


def _first_term_sql() -> str:
    return "SELECT doc_id, coalesce(" + ", ".join(f"CASE WHEN contains(lower(text), '{v}') THEN '{v}' END" for v in LAND_CLASSES) + ") AS land FROM documents"


@plan(_first_term_sql())
def land_class_q(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", tx.first_term(F.col("text"), LAND_CLASSES).alias("land"))


@plan()
def khasra_rows(t: Tables) -> DataFrame:
    """Devanagari register lines made from keys (the pattern looks behind, which the SQL engine's can't)."""
    n = F.translate((F.col("p_partkey") % 4000 + 10).cast("string"), ASCII_DIGITS, DEVANAGARI_DIGITS)
    return t.part.select("p_partkey", F.array_join(ex.khasra_numbers(F.concat(n, F.lit(" क बीघा १०५ बीघा"))), ",").alias("khasras"))


@plan("""
WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS kind, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, o_custkey % 900 + 100 AS n, o_orderpriority AS p FROM orders)
SELECT o_orderkey, CASE kind WHEN 0 THEN n || '.5 acre' WHEN 1 THEN d || '.' || m || '.' || y WHEN 2 THEN y || '-' || right(CAST(y + 1 AS VARCHAR), 2) WHEN 3 THEN 'रामपुर' || n WHEN 4 THEN trim(p, ' .,;:_-') ELSE 'no year' END AS value FROM r""")
def trim_value(t: Tables) -> DataFrame:
    """Raw values as they stand on forms: a figure with commentary, a date with strokes and spaces, a pair of years, misread words, a title behind the value."""
    k, n, day = F.col("o_orderkey") % 6, (F.col("o_custkey") % 900 + 100).cast("string"), F.col("o_orderdate")
    strokes = lambda c: F.replace(c, F.lit("1"), F.lit("l"))
    dated = F.concat_ws(" - ", *[strokes(f(day).cast("string")) for f in (F.dayofmonth, F.month, F.year)])
    years = F.concat(F.lit("सन "), F.translate(F.year(day).cast("string"), ASCII_DIGITS, DEVANAGARI_DIGITS), F.lit("-"), F.right((F.year(day) + 1).cast("string"), F.lit(2)), F.lit(" ...."))
    raw = F.array(F.concat(n, F.lit(",5 acre. (in words) ")), F.concat(dated, F.lit(" signed")), years, F.concat(F.lit("OM रामपुर"), n, F.lit(" ta  ____ ")), F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" .. Record of Rights 5")), F.lit(" no year * seal"))
    field = F.array(*map(F.lit, ("total_area", "mutation_date", "record_year", "village", "remarks", "record_year")))
    return t.orders.select("o_orderkey", ex.value_of(F.get(field, k.cast("int")), F.get(raw, k.cast("int"))).alias("value"))


@plan()
def fuzzy_ratio(t: Tables) -> DataFrame:
    """Similarities of part names with types (Indel similarity, which SQL lacks)."""
    names = t.part.select("p_name", "p_type").distinct()
    return names.select("p_name", "p_type", F.round(fuzzy.ratio("p_name", "p_type"), 2).alias("ratio"), F.round(fuzzy.token_set_ratio("p_name", "p_type"), 2).alias("token_set"), F.round(fuzzy.partial_ratio("p_name", "p_type"), 2).alias("partial"))


@plan()
def snap_vocab(t: Tables) -> DataFrame:
    """Misspelt terms back to the closed vocabulary."""
    word = F.get(F.array(*map(F.lit, ("wheet", "padddy", "sugarcan", "mustrd", "xyzzy"))), (F.col("p_partkey") % 5).cast("int"))
    return t.part.select("p_partkey", ex.snapped(word, "crop").alias("s")).select("p_partkey", "s.key", F.round("s.score", 2).alias("score"))


@plan()
def header_columns(t: Tables) -> DataFrame:
    """Headings to the table columns that they name."""
    heading = F.get(F.array(*map(F.lit, ("Khasra No.", "Owner Name", "land type / class", "remark", "qqqq"))), (F.col("p_partkey") % 5).cast("int"))
    return t.part.select("p_partkey", ex.heading_column(heading).alias("column_name"))


@plan("""
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 3 WHEN 0 THEN 'parcel_number' WHEN 1 THEN 'area' ELSE 'share' END AS k, CASE l_partkey % 4 WHEN 0 THEN CAST(l_partkey AS VARCHAR) WHEN 1 THEN l_partkey || '.' || l_suppkey WHEN 2 THEN l_returnflag ELSE '' END AS v FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN v = '' THEN 0 WHEN k = 'parcel_number' THEN CASE WHEN regexp_full_match(v, '[0-9]{1,5}') THEN 100 ELSE 20 END
  WHEN k = 'area' THEN CASE WHEN regexp_full_match(v, '[0-9]+[.][0-9]+') THEN 100 WHEN regexp_full_match(v, '[0-9]+') THEN 55 ELSE 20 END WHEN regexp_matches(v, '[0-9]') THEN 60 ELSE 10 END::DOUBLE AS score FROM c""")
def numeric_score_q(t: Tables) -> DataFrame:
    n, p = F.col("l_linenumber") % 3, F.col("l_partkey").cast("string")
    column = F.when(n == 0, "parcel_number").when(n == 1, "area").otherwise("share")
    kind = F.col("l_partkey") % 4
    value = F.when(kind == 0, p).when(kind == 1, F.concat(p, F.lit("."), F.col("l_suppkey").cast("string"))).when(kind == 2, F.col("l_returnflag")).otherwise("")
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", ex.numeric_score(column, value).alias("score"))


@plan("SELECT o_custkey AS table_id, o_orderpriority AS name, o_orderkey AS place FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) = 1")
def claimed_columns(t: Tables) -> DataFrame:
    found = t.orders.select(F.col("o_custkey").alias("table_id"), F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("score"))
    return ex.claimed_columns(found).select("table_id", "name", "place")


@plan("""
WITH s AS (SELECT user_id AS document_id, CASE event_id % 5 WHEN 0 THEN 'agree' WHEN 1 THEN 'disagree' WHEN 2 THEN 'only_shadow' WHEN 3 THEN 'agree' END AS state FROM events WHERE event_id % 7 <> 0)
SELECT document_id, count(*) FILTER (state = 'agree') AS agree, count(*) FILTER (state = 'disagree') AS disagree, count(*) FILTER (state IS NULL) AS only_primary, count(*) FILTER (state = 'only_shadow') AS only_shadow, count(*) AS compared,
  round(100.0 * count(*) FILTER (state = 'agree') / count(*), 1) AS verification_rate FROM s GROUP BY document_id""")
def agreement_summary(t: Tables) -> DataFrame:
    """Field states of events: every fifth has none, every seventh is metadata, which doesn't count."""
    n = F.col("event_id") % 5
    state = F.when(n.isin(0, 3), "agree").when(n == 1, "disagree").when(n == 2, "only_shadow")
    rows = t.events.select(F.col("user_id").alias("document_id"), F.col("event_type").alias("field_name"), F.when(F.col("event_id") % 7 == 0, "metadata").otherwise("rule").alias("source"), state.alias("state"))
    return ex.agreement_summary(rows)


@plan("SELECT event_id AS document_id, event_type AS field, CAST(value AS VARCHAR) AS primary_value, 'read ' || user_id AS shadow_value, CASE WHEN event_id % 2 = 0 THEN 'page' END AS shadow_source FROM events WHERE event_id % 5 = 1 AND event_id % 7 <> 0")
def disagreement_details(t: Tables) -> DataFrame:
    """Which fields of events two readings disagree on, and what each read."""
    n = F.col("event_id") % 5
    rows = t.events.select(
        F.col("event_id").alias("document_id"), F.col("event_type").alias("field_name"), F.when(F.col("event_id") % 7 == 0, "metadata").otherwise("rule").alias("source"), F.when(n.isin(0, 3), "agree").when(n == 1, "disagree").when(n == 2, "only_shadow").alias("state"),
        F.col("value").cast("string").alias("value"), F.concat(F.lit("read "), F.col("user_id").cast("string")).alias("shadow_value"), F.when(F.col("event_id") % 2 == 0, "page").alias("shadow_source"),
    )
    return ex.disagreements(rows)


_NAMES = ("parcel_number", "owner_name", "area", "crop", "share", "remarks", "khata_number", "possessor_name")


@plan("SELECT l_orderkey, bool_or(l_partkey % 8 IN (0, 1)) AS identified FROM lineitem GROUP BY l_orderkey")
def table_identifies(t: Tables) -> DataFrame:
    """Whether a table's columns tell parcels or owners (each line stands for a column)."""
    name = F.get(F.array(*map(F.lit, _NAMES)), (F.col("l_partkey") % 8).cast("int"))
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_set(name).alias("columns")).select("l_orderkey", ex.identifies_parcels(F.col("columns")).alias("identified"))


@plan("SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity = 50 THEN true ELSE l_quantity::DOUBLE / 2000 < 0.015 END AS blank FROM lineitem")
def blank_cells(t: Tables) -> DataFrame:
    """Cells by their share of ink; some have no inside."""
    ink = F.when(F.col("l_quantity") != 50, F.col("l_quantity").cast("double") / 2000)
    return t.lineitem.select("l_orderkey", "l_linenumber", ex.blank_cell(ink).alias("blank"))


@plan("""
WITH r AS (SELECT o_orderkey AS k, ['record_year', 'khata_number', 'owner_name'][o_orderkey % 3 + 1] AS field_name, CASE o_custkey % 3 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN 'l' || o_custkey ELSE NULL END AS value, (60 + o_custkey % 40)::DOUBLE AS conf,
  CASE o_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '--' WHEN 2 THEN o_custkey || '.' ELSE ' ' || year(o_orderdate) || '. ' END AS again, (55 + o_orderkey % 50)::DOUBLE AS conf2 FROM orders),
n AS (SELECT *, trim(again, ' ./-') AS new FROM r),
s AS (SELECT *, CASE field_name WHEN 'record_year' THEN regexp_full_match(new, '(19|20)[0-9]{2}') WHEN 'khata_number' THEN regexp_full_match(new, '[0-9]{1,6}') ELSE true END AS ok2,
  coalesce(CASE field_name WHEN 'record_year' THEN regexp_full_match(value, '(19|20)[0-9]{2}') WHEN 'khata_number' THEN regexp_full_match(value, '[0-9]{1,6}') ELSE true END, false) AS ok FROM n),
d AS (SELECT *, field_name <> 'owner_name' AND regexp_matches(new, '[0-9]') AND (conf2 >= conf + 5 OR (ok2 AND NOT ok)) AS taken FROM s)
SELECT k AS o_orderkey, field_name, CASE WHEN taken THEN new ELSE value END AS value, CASE WHEN taken THEN least(99.0, CASE WHEN ok2 THEN greatest(conf, conf2) ELSE conf2 END) ELSE conf END::DOUBLE AS confidence, CASE WHEN taken THEN 'rule+digits' ELSE 'rule' END AS source FROM d""")
def digit_rereads(t: Tables) -> DataFrame:
    """Readings of three fields and their second reading by digits alone."""
    k, c, year = F.col("o_orderkey"), F.col("o_custkey"), F.year("o_orderdate").cast("string")
    field = F.get(F.array(*map(F.lit, ("record_year", "khata_number", "owner_name"))), (k % 3).cast("int"))
    value = F.when(c % 3 == 0, year).when(c % 3 == 1, F.concat(F.lit("l"), c.cast("string")))
    again = F.when(c % 5 == 0, "").when(c % 5 == 1, "--").when(c % 5 == 2, F.concat(c.cast("string"), F.lit("."))).otherwise(F.concat(F.lit(" "), year, F.lit(". ")))
    got = ex.reread(field, value, (60 + c % 40).cast("double"), F.lit("rule"), again, (55 + k % 50).cast("double"))
    return t.orders.select("o_orderkey", field.alias("field_name"), got.alias("r")).select("o_orderkey", "field_name", "r.*")


@plan("SELECT l_orderkey, l_linenumber, round((10 * (l_quantity % 10))::DOUBLE * (0.85::DOUBLE + 0.15::DOUBLE * (20 * (l_partkey % 6))::DOUBLE / 100) * (CASE WHEN l_returnflag = 'R' THEN 0.8 ELSE 1.0 END)::DOUBLE, 1) AS confidence FROM lineitem")
def page_quality(t: Tables) -> DataFrame:
    """Confidences of readings, lowered on poor pages and for unreliable fields; the figures are such that none lies half-way, where the engines round apart."""
    confidence = ex.quality_factor((10 * (F.col("l_quantity") % 10)).cast("double"), (20 * (F.col("l_partkey") % 6)).cast("double"), F.when(F.col("l_returnflag") == "R", 0.8).otherwise(1.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", confidence.alias("confidence"))


@plan("""
WITH r AS (SELECT o_orderkey, ['khata_number', 'khasra_number', 'record_year', 'mutation_date', 'remarks'][o_orderkey % 5 + 1] AS field_name,
  [CAST(o_custkey AS VARCHAR), o_custkey || '/' || o_orderkey, CAST(year(o_orderdate) AS VARCHAR), strftime(o_orderdate, '%d-%m-%Y'), 'no ' || o_custkey, ''][o_custkey % 6 + 1] AS value FROM orders)
SELECT *, CASE field_name WHEN 'khata_number' THEN length(value) BETWEEN 1 AND 6 AND regexp_full_match(value, '[0-9]+') WHEN 'khasra_number' THEN regexp_full_match(value, '[0-9]{1,5}(/[0-9]{1,4})?')
  WHEN 'record_year' THEN length(value) = 4 AND coalesce(try_cast(value AS INT) BETWEEN 1900 AND 2099, false) WHEN 'mutation_date' THEN contains(value, '-') END AS shaped FROM r""")
def field_shapes(t: Tables) -> DataFrame:
    """Whether values have their field's shape; fields without one have no answer."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    field = F.get(F.array(*map(F.lit, ("khata_number", "khasra_number", "record_year", "mutation_date", "remarks"))), (k % 5).cast("int"))
    kinds = F.array(c.cast("string"), F.concat_ws("/", c, k), F.year("o_orderdate").cast("string"), F.date_format("o_orderdate", "dd-MM-yyyy"), F.concat(F.lit("no "), c.cast("string")), F.lit(""))
    r = t.orders.select("o_orderkey", field.alias("field_name"), F.get(kinds, (c % 6).cast("int")).alias("value"))
    return r.withColumn("shaped", tx.has_shape(F.col("field_name"), F.col("value")))
