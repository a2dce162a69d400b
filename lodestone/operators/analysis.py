"""Tenders against standards: comparison, conflicts, draft specifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions.identifiers import year
from lodestone.functions.text import first_number, number_and_unit, squeezed, text
from lodestone.operators.joins import by_sorting


def status(tender: Column, standard: Column, equal: Column) -> Column:
    t, s = text(tender) != "", text(standard) != ""
    return F.when(~t, "TENDER_NOT_SPECIFIED").when(~s, "STANDARD_NOT_FOUND").when(equal, "MATCH").otherwise("MISMATCH")


def _first(specs: DataFrame, of: Column, take: str) -> Column:
    return F.min(F.when(of, F.struct("spec_ord", F.col(take).alias("v"))))["v"]


def comparison(reqs: DataFrame, specs: DataFrame) -> DataFrame:
    """(tender_id, requirement, tender, standard, status): material, capacity, dimensions and testing against the specifications (tender_id, spec_ord, property, value, nominal, tolerance, material) of its standard."""
    s = specs.groupBy("tender_id").agg(
        _first(specs, text("material") != "", "material").alias("s_material"),
        _first(specs, F.lower(text("property")).rlike("capacity|volume"), "value").alias("s_capacity"),
        _first(specs, F.lower(text("property")).rlike("length|diameter|width|height"), "value").alias("s_dimension"),
        _first(specs, F.lower(text("property")).rlike("length|diameter|width|height"), "tolerance").alias("s_tolerance"),
        F.bool_or(F.lower(text("property")).contains("test")).alias("s_test"),
    )
    b = reqs.join(by_sorting(s), "tender_id", "left").withColumn("t_dimension", F.get("dimensions", 0)).withColumn("t_testing", F.nullif(F.array_join("testing", ", "), F.lit("")))
    m, sm = squeezed("material"), squeezed("s_material")
    c, sc = first_number("capacity"), first_number("s_capacity")
    d, sd, tol = first_number("t_dimension"), first_number("s_dimension"), first_number("s_tolerance")
    row = lambda n, t, s_, eq: F.struct(F.lit(n).alias("requirement"), F.col(t).alias("tender"), s_.alias("standard"), status(F.col(t), s_, eq).alias("status"))
    test = F.when(F.col("s_test"), F.lit("specified"))
    rows = [
        row("material", "material", F.col("s_material"), F.contains(m, sm) | F.contains(sm, m)),
        row("capacity", "capacity", F.col("s_capacity"), F.coalesce(F.abs(c - sc) < 1e-6, squeezed("capacity") == squeezed("s_capacity"))),
        F.when(F.col("t_dimension").isNotNull() | F.col("s_dimension").isNotNull(), row("dimensions", "t_dimension", F.col("s_dimension"), F.coalesce(F.abs(d - sd) <= tol, F.lit(False)))),
        row("testing", "t_testing", test, F.col("s_test")),
    ]
    return b.select("tender_id", F.explode(F.array_compact(F.array(*rows))).alias("r")).select("tender_id", "r.*")


def value_conflicts(reqs: DataFrame, specs: DataFrame) -> DataFrame:
    """Dimensions more than 15 % off a nominal value of the tender's standards, once per parameter and standard; more than 30 % is high."""
    dims = reqs.select("tender_id", F.posexplode("dimensions").alias("dim_ord", "parameter")).withColumn("t", number_and_unit("parameter")[0])
    both = dims.join(by_sorting(specs), "tender_id").where("nominal <> 0 AND t IS NOT NULL")
    off = F.abs(F.col("t") - F.col("nominal")) / F.abs("nominal") * 100
    both = both.withColumn("off", off).where("off > 15")
    w = W.partitionBy("tender_id", "parameter", "standard_id").orderBy("dim_ord", "spec_ord")
    once = both.withColumn("n", F.row_number().over(w)).where("n = 1")
    return once.select("tender_id", "parameter", "standard_id", "nominal", F.when(F.col("off") > 30, "high").otherwise("medium").alias("severity"))


def matrix_conflicts(compared: DataFrame) -> DataFrame:
    """Mismatches of comparison() as conflicts, all high."""
    wrong = compared.where(F.col("status").isin("MISMATCH", "CONFLICT"))
    return wrong.select("tender_id", F.lit("value_mismatch").alias("type"), F.col("requirement").alias("parameter"), F.col("tender").alias("tender_value"), F.col("standard").alias("standard_value"), F.lit("high").alias("severity"))


def first_standards(specs: DataFrame, most: int) -> DataFrame:
    """The specifications of a tender's first `most` standards, in the order in which specifications name them."""
    w = W.partitionBy("tender_id")
    at = F.struct(F.min("spec_ord").over(W.partitionBy("tender_id", "standard_id")).alias("at"), "standard_id")
    placed = specs.withColumn("at", at).withColumn("place", F.dense_rank().over(w.orderBy("at")))
    return placed.where((F.col("place") <= most) & F.col("tender_id").isNotNull() & F.col("standard_id").isNotNull()).drop("at", "place")


def material_conflicts(reqs: DataFrame, specs: DataFrame) -> DataFrame:
    m, s = squeezed("t_material"), squeezed("material")
    known = F.lit(False)
    for x in config.CONFLICT_MATERIALS:
        known = known | F.contains(s, F.lit(x))
    both = reqs.select("tender_id", F.col("material").alias("t_material")).where("t_material IS NOT NULL").join(by_sorting(specs), "tender_id").where((s != "") & known & ~F.contains(m, s) & ~F.contains(s, m))
    return both.select("tender_id", "standard_id", "t_material", "material").distinct()


def version_conflicts(refs: DataFrame, standards: DataFrame) -> DataFrame:
    """References more than five years older than a recommended standard's edition; standards has (tender_id, standard_id, edition_year)."""
    return refs.join(by_sorting(standards), "tender_id").where(F.col("edition_year") > F.col("year") + 5).select("tender_id", "ref_id", "standard_id", "year", "edition_year")


def conflicts(reqs: DataFrame, specs: DataFrame, recommended: DataFrame, standards: DataFrame, most: int = 5) -> DataFrame:
    """(tender_id, type, parameter, standard_id, severity) of a tender's first standards: values, materials, and references to editions long replaced; each type, parameter and standard once."""
    near = first_standards(specs, most)
    values = value_conflicts(reqs, near).select("tender_id", F.lit("value_mismatch").alias("type"), "parameter", "standard_id", "severity")
    materials = material_conflicts(reqs, near).select("tender_id", F.lit("material_conflict").alias("type"), F.lit("material").alias("parameter"), "standard_id", F.lit("medium").alias("severity"))
    cited = reqs.select("tender_id", F.explode("refs").alias("ref_id")).withColumn("year", F.coalesce(year("ref_id"), F.regexp_extract("ref_id", "([0-9]{4})$", 1).try_cast("int")))
    editions = recommended.where(F.col("rank") <= most).select("tender_id", "standard_id").join(by_sorting(standards.select("standard_id", "edition_year")), "standard_id")
    versions = version_conflicts(cited, editions).select("tender_id", F.lit("version_conflict").alias("type"), F.col("ref_id").alias("parameter"), "standard_id", F.lit("medium").alias("severity"))
    return values.unionByName(materials).unionByName(versions).dropDuplicates(["tender_id", "type", "parameter", "standard_id"])


def compatible(a: Column, b: Column) -> Column:
    """struct(compatible, difference): numbers within 10 % and units equal; else the texts are equal."""
    (x, u), (y, v) = number_and_unit(a), number_and_unit(b)
    diff = F.when(y == 0, F.when(x == 0, 0.0).otherwise(100.0)).otherwise(F.abs(x - y) / F.abs(y) * 100)
    same_unit = F.lower(text(u)) == F.lower(text(v))
    return F.struct(F.when(diff.isNull(), squeezed(a) == squeezed(b)).otherwise((diff <= 10) & same_unit).alias("compatible"), diff.alias("difference"))


def specification(params: DataFrame, matches: DataFrame, specs: DataFrame, most: int = 10) -> DataFrame:
    """(tender_id, sort_order, parameter, requirement, status): a tender's own parameters, then specifications that no parameter covers.

    Items keep their places 0 to n - 1; what is added gets n, n + 2, n + 4, as its order is counted while the list grows.
    """
    own = matches.select("tender_id", F.col("ord").alias("sort_order"), F.col("name").alias("parameter"), F.col("value").alias("requirement"), F.when(F.col("score") >= 2, "supported").otherwise("requires_input").alias("status"))
    n = params.groupBy("tender_id").agg(F.count("*").alias("n"), F.collect_set("name").alias("names"))
    more = specs.join(by_sorting(n), "tender_id", "left").where(~F.exists(F.coalesce("names", F.array().cast("array<string>")), lambda x: F.contains(F.lower("property"), x)))
    once = W.partitionBy("tender_id", "standard_id", "property", "value").orderBy("spec_ord")
    more = more.withColumn("k", F.row_number().over(once)).where("k = 1")
    more = more.withColumn("j", F.row_number().over(W.partitionBy("tender_id").orderBy("spec_ord")) - 1).where(F.col("j") < most)
    requirement = F.when((text("unit") == "") | F.contains(F.col("value"), F.col("unit")), F.col("value")).otherwise(F.concat_ws(" ", "value", "unit"))
    added = more.select("tender_id", (F.coalesce("n", F.lit(0)) + 2 * F.col("j")).cast("int").alias("sort_order"), F.col("property").alias("parameter"), requirement.alias("requirement"), F.lit("additional").alias("status"))
    return own.unionByName(added)
