"""Standards as their readers see them: details, tables, references, counts, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import text
from lodestone.operators.ranking import confident, first_of


def detail(standards: DataFrame, sections: DataFrame, specs: DataFrame) -> DataFrame:
    """(standard_id, sections, specs): the first 30 sections by page and the first 20 specifications of enough confidence, each gathered before it is joined."""
    s = first_of(sections, "standard_id", ["page", "section_id"], 30).groupBy("standard_id").agg(F.array_sort(F.collect_list(F.struct("page", "section_id"))).alias("sections"))
    p = first_of(confident(specs), "standard_id", ["page", "spec_id"], 20).groupBy("standard_id").agg(F.array_sort(F.collect_list(F.struct("page", "spec_id"))).alias("specs"))
    out = standards.select("standard_id").join(s, "standard_id", "left").join(p, "standard_id", "left")
    return out


def cells(headers: Column | str, rows: Column | str, most: int = 20) -> tuple[Column, Column]:
    """The headers and the first rows of a table from JSON; both are empty if either is malformed."""
    h = F.from_json(F.when(text(headers) != "", F.col(headers) if isinstance(headers, str) else headers).otherwise("[]"), "array<string>")
    r = F.from_json(F.when(text(rows) != "", F.col(rows) if isinstance(rows, str) else rows).otherwise("[]"), "array<array<string>>")
    good = h.isNotNull() & r.isNotNull()
    return F.when(good, h).otherwise(F.array().cast("array<string>")), F.when(good, F.slice(r, 1, most)).otherwise(F.array().cast("array<array<string>>"))


def figure_rows(figures: DataFrame) -> DataFrame:
    """(standard_id, figures) with number, caption, page and whether each is confirmed, by page and id; a list a standard."""
    row = F.struct("page", "figure_id", "figure_number", "caption", F.coalesce("confirmed", F.lit(False)).alias("confirmed"))
    return figures.groupBy("standard_id").agg(F.sort_array(F.collect_list(row)).alias("figures"))


def reference_rows(references: DataFrame, most: int = 300) -> DataFrame:
    """References as a standard's readers see them: target, type, page, confidence and the first characters of the raw text, none where it is missing."""
    return references.select("standard_id", "reference_id", "target", F.col("target").alias("ref_standard"), "type", "page", "confidence", F.substring(text("raw_text"), 1, most).alias("raw"))


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n): the rows of each table."""
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def health(standards: DataFrame, chunks: DataFrame, vectors: DataFrame | None, postings: DataFrame | None) -> DataFrame:
    """One row: healthy with a corpus and both indexes, else degraded."""
    n = standards.agg(F.count("*").alias("corpus")).crossJoin(F.broadcast(chunks.agg(F.count("*").alias("chunks"))))  # rows of one
    state = lambda df: F.lit("missing" if df is None or df.isEmpty() else "loaded")
    n = n.withColumn("semantic_index", state(vectors)).withColumn("lexical_index", state(postings))
    good = (F.col("corpus") > 0) & (F.col("semantic_index") == "loaded") & (F.col("lexical_index") == "loaded")
    return n.withColumn("status", F.when(good, "healthy").otherwise("degraded"))


def by_key(rows: DataFrame, key: str, values: DataFrame) -> DataFrame:
    """The rows of the given keys."""
    return rows.join(values.select(key).distinct(), key, "left_semi")


def same_model(index_meta: DataFrame, model: str, dim: int) -> DataFrame:
    """index_meta (model, dim) with `problem`: null if the index was built by the model and has its dimension."""
    problem = F.when(~F.col("model").eqNullSafe(F.lit(model)), F.concat(F.lit("index built by "), F.coalesce("model", F.lit("unknown")))).when(~F.col("dim").eqNullSafe(F.lit(dim)), F.concat(F.lit("index has dimension "), F.coalesce(F.col("dim").cast("string"), F.lit("unknown"))))
    return index_meta.withColumn("problem", problem)


def checked_vectors(vectors: DataFrame, dim: int, vector: str = "vector") -> DataFrame:
    """The vectors; reading one of another dimension is an error."""
    wrong = F.raise_error(F.concat(F.lit(f"vectors must have dimension {dim}, not "), F.coalesce(F.size(vector), F.lit(-1)).cast("string")))
    return vectors.withColumn(vector, F.when(F.size(vector) == dim, F.col(vector)).otherwise(wrong))
