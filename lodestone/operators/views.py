"""What the screens show, as filters and sorts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import text


def search_any(df: DataFrame, needle: str, cols: list[str]) -> DataFrame:
    cond = F.lit(False)
    for c in cols:
        cond = cond | F.contains(F.lower(text(F.col(c).cast("string"))), F.lit(needle.lower()))
    return df.where(cond)


def spec_page(specs: DataFrame, category: str, needle: str, order: str, page: int, size: int = 8) -> DataFrame:
    """A page of specifications of a category that contain the needle, in order regardless of case."""
    found = search_any(specs.where(F.contains(F.lower("property"), F.lit(category.lower()))), needle, ["property", "value", "unit", "material"])
    return found.orderBy(F.lower(F.col(order).cast("string")), "spec_id").offset(page * size).limit(size)


def requirements_with(reqs: DataFrame, needle: str) -> DataFrame:
    """Requirements with the needle in one of five fields."""
    return search_any(reqs, needle, ["product", "material", "application", "capacity", "full_text"])


def evidence_cards(specs: DataFrame, needle: str = "") -> DataFrame:
    """(spec_id, section, page, card) of specifications as short texts, those with the needle in text, section or page."""
    card = F.concat_ws(" ", F.concat("property", F.lit(":")), "value", F.nullif("unit", F.lit("")))
    rows = specs.select("spec_id", F.col("property").alias("section"), "page", card.alias("card"))
    return search_any(rows, needle, ["card", "section", "page"]) if needle else rows


def tests_only(specs: DataFrame) -> DataFrame:
    return search_any(specs, "test", ["property", "condition"])


def reference_kind(kind: Column) -> Column:
    return F.when(F.contains(F.lower(text(kind)), F.lit("test")), "test_method").otherwise("normative")


def match_label(confidence: Column, score: Column) -> Column:
    return F.when((confidence == "HIGH") | (score >= 0.70), "Strong Match").when((confidence == "MEDIUM") | (score >= 0.40), "Relevant").otherwise("Low")


def tender_status(status: Column, tender: Column) -> Column:
    return F.when(F.lower(F.trim(text(tender))).isin("", "not specified"), "TENDER_NOT_SPECIFIED").otherwise(status)


def split_counts(df: DataFrame, by: str, column: str, values: list[str]) -> DataFrame:
    """A row a key of how many of its rows have each of the values, a column a value; other values count nowhere."""
    return df.groupBy(by).agg(*[F.count_if(F.col(column).eqNullSafe(F.lit(v))).alias(v) for v in values])


def toggled(events: DataFrame, by: list[str], order: str) -> DataFrame:
    """Keys that an odd number of toggles left on."""
    return events.groupBy(*by).agg(F.count("*").alias("n"), F.max(order).alias("last")).where("n % 2 = 1")


def pinned(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    w = W.partitionBy(*keys).orderBy(*order)
    return events.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")
