"""Validation rules in a registry: each is a function from DataFrames to (document_id, rule_id, severity, passed, field_name, message)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.constants import DUPLICATE_SIMILARITY, OWNER_SIMILARITY, REVIEW
from parcelry.functions.dates import is_iso_like, plausible_years
from parcelry.functions.fuzzy import token_set_ratio
from parcelry.functions.text import blank_to_null, is_identifier

RULES: dict[str, tuple[Callable[..., DataFrame], tuple[str, ...]]] = {}
OUTCOME = ("document_id", "rule_id", "severity", "passed", "field_name", "message")


def rule(rule_id: str, *inputs: str):
    """Registers a rule with the names of the tables it takes; rules run in the order in which they are registered."""

    def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        RULES[rule_id] = f, inputs or ("records", "parcels")
        return f

    return keep


def outcome(df: DataFrame, rule_id: str, passed: Column, severity: Column | str, field: Column | str | None, message: Column | str, id_col: str = "document_id") -> DataFrame:
    plain = lambda c: F.lit(c) if isinstance(c, str) or c is None else c
    return df.select(
        F.col(id_col).alias("document_id"), F.lit(rule_id).alias("rule_id"), plain(severity).alias("severity"), F.coalesce(passed, F.lit(False)).alias("passed"),
        plain(field).cast("string").alias("field_name"), plain(message).cast("string").alias("message"),
    )


def present(c: Column) -> Column:
    return blank_to_null(c).isNotNull()


def _or(ok: Column, yes: str, no: str) -> Column:
    return F.when(F.coalesce(ok, F.lit(False)), yes).otherwise(no)


def _text(*parts: Column | str) -> Column:
    """Parts joined; a null part is left empty."""
    return F.concat(*[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts])


@rule("R01")
def mandatory_fields(records: DataFrame, parcels: DataFrame) -> DataFrame:
    """Owner and village, and one of survey, khasra and khata number; with parcels, every parcel needs an owner instead."""
    named = parcels.groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(present(F.col("owner_name"))).alias("named"))
    r = records.join(named, "document_id", "left")
    owner, village = present(F.col("owner_name")), present(F.col("village"))
    number = present(F.col("survey_number")) | present(F.col("khasra_number")) | present(F.col("khata_number"))
    stated = lambda f, ok: _text(f"Mandatory field '{f}' ", _or(ok, "present", "missing"))
    rows = F.when(F.col("n") > 0, _text(F.col("named"), " of ", F.col("n"), " parcel rows have an owner name")).otherwise(stated("owner_name", owner))
    checks = (("owner_name", F.when(F.col("n") > 0, F.col("named") == F.col("n")).otherwise(owner), rows), ("village", village, stated("village", village)), (None, number, _text("At least one of survey/khasra/khata number ", _or(number, "present", "missing"))))
    each = r.select("document_id", F.explode(F.array(*[F.struct(F.lit(f).cast("string").alias("f"), p.alias("p"), m.alias("m")) for f, p, m in checks])).alias("c"))
    return outcome(each, "R01", F.col("c.p"), "error", F.col("c.f"), F.col("c.m"))


def area_passes(sqm: Column) -> Column:
    return sqm.between(1, 5_000_000)


@rule("R02")
def area_range(records: DataFrame, parcels: DataFrame) -> DataFrame:
    """1 to 5,000,000 square metres; a missing area is a warning."""
    sqm = F.col("plot_area_sqm")
    ok = area_passes(sqm)
    return outcome(records, "R02", ok, F.when(sqm.isNull(), "warning").when(ok, "info").otherwise("error"), "plot_area", F.when(sqm.isNull(), "Plot area missing or unit not recognised").otherwise(_text("Plot area ", sqm, " sqm ", _or(ok, "within", "outside"), " plausible range")))


@rule("R03")
def identifier_format(records: DataFrame, parcels: DataFrame) -> DataFrame:
    """Identifiers have letters and digits, with a digit."""
    names = ("survey_number", "khasra_number", "khata_number")
    each = records.select("document_id", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("v")) for n in names])).alias("c")).filter("c.v is not null")
    ok = is_identifier(F.col("c.v"))
    return outcome(each, "R03", ok, "warning", F.col("c.f"), _text(F.col("c.f"), " '", F.col("c.v"), "' ", _or(ok, "looks valid", "has unexpected characters")))


@rule("R04")
def date_consistency(records: DataFrame, parcels: DataFrame) -> DataFrame:
    """Dates look like ISO dates, and the mutation doesn't come before the registration (compared as text)."""
    names = ("mutation_date", "registration_date")
    each = records.select("document_id", F.explode(F.array(*[F.struct(F.lit(n).alias("f"), F.col(n).alias("v")) for n in names])).alias("c")).filter("c.v is not null and c.v <> ''")
    ok = is_iso_like(F.col("c.v"))
    shape = outcome(each, "R04", ok, "warning", F.col("c.f"), _text(F.col("c.f"), " '", F.col("c.v"), "' ", _or(ok, "parsed to ISO date", "could not be parsed")))
    both = records.filter((F.length("mutation_date") == 10) & (F.length("registration_date") == 10))
    return shape.unionByName(outcome(both, "R04", F.col("mutation_date") >= F.col("registration_date"), "warning", "mutation_date", "Mutation date should not precede registration date"))


@rule("R05", "fields")
def low_confidence(fields: DataFrame, limit: float = REVIEW) -> DataFrame:
    """Per document, the fields below the limit, in name order."""
    low = F.array_sort(F.collect_list(F.when(F.col("confidence") < limit, F.col("field_name"))))
    per = fields.groupBy("document_id").agg(low.alias("low"))
    some = F.size("low") > 0
    return outcome(per, "R05", ~some, F.when(some, "warning").otherwise("info"), None, F.when(some, _text("Low-confidence fields require review: ", F.array_join("low", ", "))).otherwise("No field below review threshold"))


def with_other(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """rows with `other`: columns (document_id first) of the row with the smallest other document_id and the same keys; null if none.

    Only the two smallest ids of a key are looked for, so a key that many rows have is no join of all with all.
    """
    value = F.struct(*columns)
    lowest = rows.groupBy(*keys).agg(F.min(value).alias("low"))
    at = rows.join(lowest, keys)
    second = at.filter("document_id <> low.document_id").groupBy(*keys).agg(F.min(value).alias("second"))
    other = F.when(F.col("document_id") != F.col("low.document_id"), F.col("low")).otherwise(F.col("second"))
    return at.join(second, keys, "left").withColumn("other", other).drop("low", "second")


@rule("R06", "hashes")
def duplicate_document(hashes: DataFrame) -> DataFrame:
    """A document (document_id, sha256) with the bytes of another one."""
    known = with_other(hashes.filter("sha256 is not null"), ["sha256"], ["document_id"])
    rows = known.select("document_id", F.col("other.document_id").alias("o")).unionByName(hashes.filter("sha256 is null").select("document_id", F.lit(None).cast(hashes.schema["document_id"].dataType).alias("o")))
    ok = F.col("o").isNull()
    return outcome(rows, "R06", ok, F.when(ok, "info").otherwise("error"), None, F.when(ok, "No byte-identical duplicate").otherwise(_text("Exact duplicate of document ", F.col("o"))))


def same_parcel(records: DataFrame) -> DataFrame:
    """document_id, owner_name, other_id, other_owner: the first other record (smallest id) of the village with an equal number.

    Three equi-joins, one per kind of number, instead of one join on 'or'. Records without a village are left out; others without such a
    record have a null other_id.
    """
    here = records.filter(present(F.col("village")))
    found = here.select("document_id", F.lit(None).cast(f"struct<document_id:{records.schema['document_id'].dataType.simpleString()},owner_name:string>").alias("other"))
    for name in ("khasra_number", "survey_number", "khata_number"):
        of_kind = here.filter(present(F.col(name))).select("document_id", "owner_name", "village", name)
        found = found.unionByName(with_other(of_kind, ["village", name], ["document_id", "owner_name"]).select("document_id", "other"))
    first = found.groupBy("document_id").agg(F.min("other").alias("other"))
    return here.select("document_id", "owner_name").join(first, "document_id").select("document_id", "owner_name", F.col("other.document_id").alias("other_id"), F.col("other.owner_name").alias("other_owner"))


@rule("R07", "records")
def duplicate_records(records: DataFrame, similarity: float = DUPLICATE_SIMILARITY) -> DataFrame:
    """Another record of the same village with the same khasra, survey or khata number.

    The first match is scored: a similar owner is a duplicate, another owner a transfer.
    """
    rows = same_parcel(records)
    some = rows.filter("other_id is not null").withColumn("score", token_set_ratio(F.coalesce("owner_name", F.lit("")), F.coalesce("other_owner", F.lit(""))))
    same, percent = F.col("score") >= similarity, F.format_number("score", 0)
    message = F.when(same, _text("Possible duplicate record (doc ", F.col("other_id"), ", owner similarity ", percent, "%)")).otherwise(_text("Same parcel identifier as doc ", F.col("other_id"), " but different owner (similarity ", percent, "%)"))
    found = outcome(some, "R07", F.lit(False), F.when(same, "error").otherwise("warning"), F.when(~same, "owner_name"), message)
    return found.unionByName(outcome(rows.filter("other_id is null"), "R07", F.lit(True), "info", None, "No duplicate parcel record"))


def mirror_match(records: DataFrame, external: DataFrame) -> DataFrame:
    """records with e: the matching external record with the smallest id, by khasra or, only if that finds none, by survey number; or null.

    Villages are compared without case; a record without one matches any village. The mirror is cut down to its first record per key
    before it is joined, so a record meets at most one of each kind.
    """
    whole = F.struct("id", "owner_name", "plot_area_sqm", "khata_number", "source")
    r = records.withColumn("v", F.when(present(F.col("village")), F.lower("village")))
    for name in ("khasra_number", "survey_number"):
        kind = external.filter(present(F.col(name))).select(F.lower("village").alias("v"), F.col(name).alias("k"), whole.alias("e"))
        here = kind.groupBy("v", "k").agg(F.min("e").alias(f"here_{name}"))
        anywhere = kind.groupBy("k").agg(F.min("e").alias(f"any_{name}"))
        r = r.join(here.withColumnRenamed("k", name), ["v", name], "left").join(anywhere.withColumnRenamed("k", name), [name], "left")
    pick = lambda n: F.when(F.col("v").isNull(), F.col(f"any_{n}")).otherwise(F.col(f"here_{n}"))
    return r.select(*records.columns, F.coalesce(pick("khasra_number"), pick("survey_number")).alias("e"))


@rule("R08", "records", "external")
def cross_database(records: DataFrame, external: DataFrame, similarity: float = OWNER_SIMILARITY) -> DataFrame:
    """The matching external record: the owner is always compared, the area if both have one (within 5 %), the khata number if both
    have one. No match is a failed warning."""
    j = mirror_match(records, external)
    none = outcome(j.filter("e is null"), "R08", F.lit(False), "warning", None, "No matching record in the mirror (new record or unmapped parcel)")
    some = j.filter("e is not null").select("document_id", "owner_name", "plot_area_sqm", "khata_number", *[F.col(f"e.{c}").alias(f"e_{c}") for c in ("owner_name", "plot_area_sqm", "khata_number", "source")])
    scored = some.withColumn("score", token_set_ratio(F.coalesce("owner_name", F.lit("")), F.coalesce("e_owner_name", F.lit(""))))
    owner = outcome(scored, "R08", F.col("score") >= similarity, "warning", "owner_name", _text("Owner name vs ", F.col("e_source"), ": '", F.col("e_owner_name"), "' (similarity ", F.format_number("score", 0), "%)"))
    share = F.abs(F.col("plot_area_sqm") - F.col("e_plot_area_sqm")) / F.col("e_plot_area_sqm")
    area = outcome(some.filter("plot_area_sqm <> 0 and e_plot_area_sqm <> 0"), "R08", share <= 0.05, "warning", "plot_area", _text("Area differs from ", F.col("e_source"), " by ", F.format_number(share * 100, 1), "%"))
    both = some.filter(present(F.col("khata_number")) & present(F.col("e_khata_number")))
    khata = outcome(both, "R08", F.col("khata_number") == F.col("e_khata_number"), "warning", "khata_number", _text("Khata number vs ", F.col("e_source"), ": ", F.col("e_khata_number")))
    return none.unionByName(owner).unionByName(area).unionByName(khata)


def close_enough(total: Column, stated: Column) -> Column:
    """Within 2 % of the stated figure, or 50 units."""
    return F.abs(total - stated) <= F.greatest(0.02 * stated, F.lit(50.0))


@rule("R09")
def parcel_area_total(records: DataFrame, parcels: DataFrame) -> DataFrame:
    """The parcels' areas add up to the stated total; areas of 0 don't count."""
    total = parcels.groupBy("document_id").agg(F.round(F.sum(F.nullif("area_sqm", F.lit(0.0))), 2).alias("total"))
    r = records.join(total, "document_id", "inner")
    t, stated = F.col("total"), F.col("stated_sqm")
    ok = F.when(t.isNull(), False).when(stated.isNull(), True).otherwise(close_enough(t, stated))
    alone = stated.isNull() & t.isNotNull()
    message = F.when(t.isNull(), "No parcel area could be read, so the total cannot be checked").when(alone, _text("Parcel areas total ", t, " sqm (no stated total to compare)"))
    message = message.otherwise(_text("Parcel areas total ", t, " sqm vs stated total ", stated, " sqm (difference ", F.round(F.abs(t - stated)).cast("long"), " sqm)"))
    return outcome(r, "R09", ok, F.when(alone, "info").otherwise("warning"), F.when(~alone, "area"), message)


@rule("R10")
def parcel_identifiers(records: DataFrame, parcels: DataFrame) -> DataFrame:
    """No parcel without a number, no number twice, and figures only (with slashes)."""
    number = blank_to_null(F.col("parcel_number"))
    counts = parcels.groupBy("document_id", number.alias("k")).agg(F.count("*").alias("c"))
    bad = ~F.regexp_replace("k", "/", "").rlike(r"^\p{Nd}+$")
    listed = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("k")))), ", ")
    per = counts.groupBy("document_id").agg(F.coalesce(F.sum(F.when(F.col("k").isNull(), F.col("c"))), F.lit(0)).alias("missing"), listed(F.col("c") > 1).alias("twice"), listed(bad).alias("malformed"))
    kinds = (
        (F.col("missing") > 0, "error", _text("Parcel rows without a number: ", F.col("missing")), "Every parcel row has a number"),
        (F.col("twice") != "", "error", _text("Duplicate parcel numbers on this sheet: ", F.col("twice")), "Parcel numbers are unique"),
        (F.col("malformed") != "", "warning", _text("Parcel numbers with unexpected characters: ", F.col("malformed")), "Parcel numbers are well formed"),
    )
    each = per.select("document_id", F.explode(F.array(*[F.struct(F.lit(s).alias("s"), b.alias("bad"), F.when(b, no).otherwise(yes).alias("m")) for b, s, no, yes in kinds])).alias("c"))
    return outcome(each, "R10", ~F.col("c.bad"), F.col("c.s"), "parcel_number", F.col("c.m"))


@rule("R11")
def irrigation_split(records: DataFrame, parcels: DataFrame) -> DataFrame:
    """Irrigated and unirrigated areas add up to the total, where a total and one of them are stated."""
    a, b, t = (F.nullif(F.col(c), F.lit(0.0)) for c in ("irrigated_sqm", "unirrigated_sqm", "stated_sqm"))
    some = records.filter(t.isNotNull() & (a.isNotNull() | b.isNotNull()))
    split = F.coalesce(a, F.lit(0.0)) + F.coalesce(b, F.lit(0.0))
    figure = lambda c: F.round(c).cast("long")
    return outcome(some, "R11", close_enough(split, t), "warning", "irrigated_area", _text("Irrigated + unirrigated = ", figure(split), " sqm vs total ", figure(t), " sqm (difference ", figure(F.abs(split - t)), " sqm)"))


@rule("R12", "fields", "this_year")
def plausible_dates(fields: DataFrame, this_year: int) -> DataFrame:
    """Date-like fields that aren't blank have a year, and all years lie between 1850 and this year."""
    some = fields.filter(F.col("field_name").isin("record_year", "record_date", "mutation_date", "registration_date") & present(F.col("value")))
    ok = plausible_years(F.col("value"), this_year)
    message = F.when(F.coalesce(ok, F.lit(False)), _text(F.col("field_name"), " year looks plausible")).otherwise(_text(F.col("field_name"), " '", F.col("value"), "' has no recognisable year, or an implausible one"))
    return outcome(some, "R12", ok, "warning", F.col("field_name"), message)


def crashed(records: DataFrame, rule_id: str, why: Exception) -> DataFrame:
    """One failed warning for each record in place of a rule's outcomes."""
    first = str(why).strip().partition("\n")[0][:500]
    return outcome(records, rule_id, F.lit(False), "warning", None, f"Rule crashed: {first}")


def validate(**inputs) -> DataFrame:
    """The outcomes of all registered rules as one plan; inputs are the tables that they name.

    A rule that can't be planned over its inputs doesn't block the others: it gives each record one failed warning. One that raises in a task fails the
    whole plan; validate_to keeps such rules apart.
    """
    found = None
    for rule_id, (f, names) in RULES.items():
        try:
            one = f(*[inputs[n] for n in names])
        except Exception as why:  # noqa: BLE001
            one = crashed(inputs["records"], rule_id, why)
        found = one if found is None else found.unionByName(one)
    return found


def validate_to(path: str, **inputs) -> DataFrame:
    """The outcomes of all registered rules, each run and written by itself to a folder of path, and read back.

    A rule that raises, when it is planned or in a task, leaves one failed warning for each record, and the others' outcomes stay. Writing again replaces each rule's
    folder, so a validation that was cut off is run again as a whole.
    """
    for rule_id, (f, names) in RULES.items():
        target = f"{path}/rule={rule_id}"
        try:
            f(*[inputs[n] for n in names]).select(*OUTCOME).write.mode("overwrite").parquet(target)
        except Exception as why:  # noqa: BLE001  (a broken rule must never block the others)
            crashed(inputs["records"], rule_id, why).write.mode("overwrite").parquet(target)
    schema = crashed(inputs["records"], "", ValueError()).schema
    return inputs["records"].sparkSession.read.schema(schema).parquet(path)
