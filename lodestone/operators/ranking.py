"""From ranked chunks to recommended standards with their evidence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone import config
from lodestone.functions.text import rounded, text, word_set
from lodestone.operators.joins import by_sorting


def owner(hits: DataFrame) -> DataFrame:
    """Adds `standard`: the chunk's standard, else what its id has before _P, else `unknown`."""
    before = F.when(F.contains(F.col("chunk_id"), F.lit("_P")), F.get(F.split("chunk_id", "_P"), 0))
    return hits.withColumn("standard", F.coalesce(F.nullif("standard_id", F.lit("")), before, F.lit("unknown")))


def grouped(hits: DataFrame, score: str = "score", most: int = 3) -> DataFrame:
    """(query_id, standard, semantic, chunks, best_chunk_score, evidence_chunks): 0.6 of the best score and 0.4 of the mean of the best three, which are the evidence.

    Counts are partial sums and the best three are ranked within each task
    before the shuffle, so a hot standard sends three rows from each.
    """
    n = owner(hits).withColumn("at", F.struct((-F.col(score)).alias("order"), "chunk_id"))
    sizes = n.groupBy("query_id", "standard").agg(F.count("*").alias("chunks"), F.max(score).alias("best_chunk_score"))
    best = top_of(n, ["query_id", "standard"], "at", most).groupBy("query_id", "standard").agg(F.sort_array(F.collect_list("at")).alias("top"))
    scores = F.transform("top", lambda x: -x["order"])
    mean = F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size("top")
    out = sizes.join(best, ["query_id", "standard"]).withColumn("semantic", 0.6 * F.col("best_chunk_score") + 0.4 * mean)
    return out.select("query_id", "standard", "semantic", "chunks", "best_chunk_score", F.transform("top", lambda x: x["chunk_id"]).alias("evidence_chunks"))


def top_of(df: DataFrame, by: list[str], order: str, most: int) -> DataFrame:
    """The first `most` rows of each group; ranked within tasks before the shuffle, so a hot group sends no more than that from each."""
    return df.withColumn("n", F.row_number().over(W.partitionBy(*by).orderBy(order))).where(F.col("n") <= most).drop("n")


def title_overlap(query: Column, title: Column) -> Column:
    q, t = word_set(query), word_set(title)
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, t)) / F.size(q)).otherwise(0.0)


def recency(year: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.coalesce(year, F.lit(2000)) - 2000) / 26))


def scope() -> Column:
    """Of a group's chunks: 0.15 more than the best score of one in a scope section, 1 at most; 0 without one."""
    best = F.max(F.when(F.contains(F.lower(text("section")), F.lit("scope")), F.col("score")))
    return F.when(best.isNotNull(), F.least(F.lit(1.0), best + 0.15)).otherwise(0.0)


MATERIALS = re.search(r"\((\w+(?:\|\w+)+)\)", config.RANK_MATERIAL)[1].split("|")
"""All that a query can name."""


def named(chunks: DataFrame) -> DataFrame:
    """Chunks with `named`, the materials that their text and section contain, in place of the text. Found where the chunks are read, so that a chunk's text isn't sent on with each of its hits."""
    where = F.lower(F.concat_ws(" ", text("text"), text("section")))
    return chunks.withColumn("named", F.filter(F.array(*map(F.lit, MATERIALS)), lambda m: F.contains(where, m))).drop("text")


def ranked(hits: DataFrame, standards: DataFrame, queries: DataFrame, c: config.Config = config.DEFAULT) -> DataFrame:
    """Standards of each query by a weighted sum of their chunks' scores, title, scope, material and recency; standards that don't exist drop out. hits have fused scores of 0 to 1; the five parts of a score, the best chunk's score and the best three chunks stay beside it. Hits have their chunks' columns, as they are or by named()."""
    hits = hits if "named" in hits.columns else named(hits)
    words = F.array_distinct(F.transform(F.regexp_extract_all(text("query"), F.lit(config.RANK_MATERIAL), 1), lambda x: F.lower(x)))
    asked = queries.select("query_id", "query", words.alias("materials"))
    signals = owner(hits).join(asked, "query_id").withColumn("has", F.arrays_overlap("materials", "named"))
    signals = signals.groupBy("query_id", "standard").agg(
        scope().alias("scope"), F.when(F.max(F.size("materials")) > 0, F.least(F.lit(1.0), F.avg(F.when(F.col("has"), 1.0).otherwise(0.0)) + 0.2)).otherwise(0.0).alias("material")
    )
    known = standards.select(F.col("standard_id").alias("standard"), "title", "normalized_identifier", "edition_year")
    both = grouped(hits).join(signals, ["query_id", "standard"]).join(by_sorting(known), "standard").join(queries.select("query_id", "query"), "query_id")
    both = both.withColumn("title", title_overlap(F.col("query"), F.concat_ws(" ", "title", "normalized_identifier"))).withColumn("recency", recency(F.col("edition_year")))
    score = c.rank_semantic * F.col("semantic") + c.rank_title * F.col("title") + c.rank_scope * F.col("scope") + c.rank_material * F.col("material") + c.rank_recency * F.col("recency")
    both = both.select("query_id", "standard", rounded(score, 4).alias("score"), "chunks", "semantic", "title", "scope", "material", "recency", "best_chunk_score", "evidence_chunks")
    w = W.partitionBy("query_id").orderBy(F.col("score").desc(), "standard")
    return both.withColumn("rank", F.row_number().over(w))


def decided(ranking: DataFrame, queries: DataFrame, c: config.Config = config.DEFAULT) -> DataFrame:
    """(query_id, top_score, decision, confidence) for every query, also those without a hit."""
    best = ranking.where("rank = 1").select("query_id", F.col("score").alias("top_score"), F.col("chunks").alias("best_chunks"))
    out = queries.select("query_id").join(best, "query_id", "left")
    none = F.col("top_score").isNull() | (F.col("top_score") < c.abstain) | (F.col("best_chunks") == 0)
    level = F.when(none, "INSUFFICIENT_EVIDENCE").when(F.col("top_score") >= c.high, "HIGH").when(F.col("top_score") >= c.medium, "MEDIUM").otherwise("LOW")
    return out.select("query_id", "top_score", F.when(none, "ABSTAIN").otherwise("RECOMMEND").alias("decision"), level.alias("confidence"))


def explained(ranking: DataFrame, c: config.Config = config.DEFAULT) -> DataFrame:
    """Adds `relevance` and `why`, the parts of the score in words, to ranked standards."""
    part = lambda form, of: F.format_string(form, rounded(F.col(of), 2))
    why = F.array(part("Semantic relevance: %.2f", "semantic"), part("Title match: %.2f", "title"), part("Scope coverage: %.2f", "scope"))
    return ranking.withColumn("relevance", F.when(F.col("score") >= c.high, "HIGH").when(F.col("score") >= c.medium, "MEDIUM").otherwise("LOW")).withColumn("why", why)


def confident(specs: DataFrame, least: float = config.DEFAULT.spec_confidence) -> DataFrame:
    """Specifications of enough confidence; all of a standard that has none."""
    some = F.max((F.col("confidence") >= least).cast("int")).over(W.partitionBy("standard_id"))
    return specs.withColumn("some", some).where((F.col("confidence") >= least) | (F.col("some") == 0)).drop("some")


def first_of(df: DataFrame, by: str, order: list, n: int) -> DataFrame:
    return df.withColumn("n", F.row_number().over(W.partitionBy(by).orderBy(*order))).where(F.col("n") <= n).drop("n")


def evidence(standards: DataFrame, specs: DataFrame, references: DataFrame, chunks: DataFrame, tables: DataFrame, figures: DataFrame, compliance: DataFrame) -> DataFrame:
    """One row per standard with its first specifications, references, chunks, tables, confirmed figures and compliance marks; each child is cut and gathered before it is joined."""
    children = (
        (confident(specs), ["page", "spec_id"], "spec_id", 12, "specs"),
        (references, ["target"], "target", 10, "refs"),
        (chunks, ["page", "chunk_id"], "chunk_id", 3, "chunks"),
        (tables, ["page", "table_id"], "table_id", 5, "tables"),
        (figures.where("confirmed"), ["page", "figure_id"], "figure_id", 5, "figures"),
        (compliance, ["page", "compliance_id"], "compliance_id", 5, "compliance"),
    )
    out = standards.select("standard_id")
    for rows, order, name, n, alias in children:
        child = first_of(rows, "standard_id", order, n).groupBy("standard_id").agg(F.array_sort(F.collect_list(name)).alias(alias))
        out = out.join(child, "standard_id", "left")
    return out


def newer_editions(references: DataFrame, standards: DataFrame) -> DataFrame:
    """References (ref_id, base, year) to an edition older than the newest of that base, of several the first by id."""
    latest = standards.groupBy("base").agg(F.min(F.struct((-F.col("edition_year")).alias("age"), "edition_year", "standard_id")).alias("latest"))
    return references.join(by_sorting(latest), "base").where(F.col("year") < F.col("latest.edition_year")).select("ref_id", "base", "year", F.col("latest.edition_year").alias("latest_year"), F.col("latest.standard_id").alias("latest_id"))


def understood(requirements: DataFrame) -> DataFrame:
    """query_text: the built query, or the first 500 characters of a long text whose query is short."""
    short = (F.length("full_text") > 20) & (F.length("built") < 50)
    return requirements.withColumn("query_text", F.when(short, F.substring("full_text", 1, 500)).otherwise(F.col("built")))
