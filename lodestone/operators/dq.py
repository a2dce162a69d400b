"""Checks of the stored tables, one row a check."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import text


def _row(name: str, df: DataFrame, bad: Column, fails: str = "FAIL") -> DataFrame:
    """bad: an aggregate that should be 0."""
    n = F.coalesce(bad, F.lit(0)).cast("bigint")
    return df.agg(n.alias("bad")).select(F.lit(name).alias("check_name"), "bad", F.when(F.col("bad") > 0, fails).otherwise("PASS").alias("status"))


def report(standards: DataFrame, chunks: DataFrame, figures: DataFrame, tables: DataFrame, references: DataFrame, vectors: DataFrame, mapping: DataFrame) -> DataFrame:
    """The twelve checks: (check_name, bad, status)."""
    page = lambda c: F.count_if(F.coalesce(F.col(c), F.lit(0)) == 0)
    title = standards.agg((F.avg(F.when(text("title") == "", 1.0).otherwise(0.0)) > 0.4).cast("int").alias("bad"))
    many = figures.groupBy("standard_id").agg(F.count("*").alias("n")).where("n > 80")
    group = figures.where("confirmed").groupBy("duplicate_group").agg(F.count("*").alias("n")).where("n > 10")
    total = vectors.agg(F.count("*").alias("a")).crossJoin(mapping.agg(F.count("*").alias("b"))).select((F.col("a") - F.col("b")).alias("d"))
    rows = [
        _row("standard_ids", standards, F.count_if(text("standard_id") == "") + F.when(F.count("*") == 0, 1).otherwise(0)),
        _row("titles", title, F.max("bad"), "WARN"),
        _row("chunk_pages", chunks, page("page")),
        _row("figure_pages", figures, page("page")),
        _row("table_pages", tables, page("page")),
        _row("reference_sources", references, F.count_if(text("source") == "")),
        _row("figures_per_standard", many, F.count("*"), "WARN"),
        _row("figure_groups", group, F.count("*"), "WARN"),
        _row("short_chunks", chunks, F.count_if(F.length(F.trim(text("text"))) < 10)),
        _row("long_chunks", chunks, F.count_if(F.length(text("text")) > 6000), "WARN"),
        _row("broken_chunks", chunks, F.count_if(F.length(text("text")) - F.length(F.replace(text("text"), F.lit("�"), F.lit(""))) > 5), "WARN"),
        _row("vectors", total, F.abs(F.max("d"))),
    ]
    return reduce(DataFrame.unionByName, rows)


def overall(checks: DataFrame) -> DataFrame:
    return checks.agg(F.when(F.bool_or(F.col("status") == "FAIL"), "FAIL").otherwise("PASS").alias("overall"), F.count_if(F.col("status") != "PASS").alias("issues"))
