"""A corpus pipeline: language ID, near-duplicates, secrets, mixing, token ids.

STAGES lists the stages; each takes (spark, docs, sf_dir) and returns a
DataFrame that is written as Parquet and read again as the next stage's docs.
All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, langid, mixing, secrets, simhash
from lodestone.llm._common import ready, staged, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told. Rejected are texts that are null or without a letter (`und`); short texts with close codewords are kept. A null lang is filled with the prediction. Where no row has a label there is nothing to tell languages by: every text with a letter is kept, as `und`. Repeated rows stay, an empty table stays empty."""
    ready(spark)
    docs = docs.select(*COLUMNS)
    model = langid.train(docs)
    told = F.col("lang_pred") != "und" if model.langs else F.coalesce(F.col("text").rlike("\\p{L}"), F.lit(False))
    known = langid.identify(docs, model).where(told)
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts linked by a similarity of 0.8 or more of their sets of five-word shingles (`simhash.similar`): that with the smallest doc_id, of several texts of that doc_id the one with the smallest hash; of repeated rows, one. A null doc_id is kept where all of the group are null."""
    ready(spark)
    docs = docs.select(*COLUMNS)
    # a row is known by its doc_id and its text, as a doc_id may be null or name several texts
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    groups = simhash.similar(docs.select(key.alias("doc_id"), "text")).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    kept = groups.groupBy("component_id").agg(F.count("*").alias("n")).select(F.col("component_id.id").alias("id"), F.col("component_id.hash").alias("hash"), "n")
    rows = docs.join(kept, F.col("doc_id").eqNullSafe(F.col("id")) & (F.xxhash64("text") == F.col("hash")))
    # rows of one doc_id and text differ in source or lang at most; the first stays
    several = rows.where("n > 1").groupBy("id", "hash").agg(F.min(F.struct(F.xxhash64("source", "lang"), *COLUMNS)).alias("first"))
    return rows.where("n = 1").select(*COLUMNS).union(several.select("first.*").select(*COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are masked and n_chars follows the new text."""
    ready(spark)
    docs = docs.select(*COLUMNS)
    found = secrets.secrets(docs).where(F.size("spans") > 0).groupBy(F.col("doc_id").alias("of"), "text_md5").agg(F.any_value("spans").alias("spans"))
    rows = docs.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.md5("text") == F.col("text_md5")), "left")
    text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(secrets.masked(F.col("text"), F.col("spans")))
    rows = rows.withColumn("text", text)
    return rows.withColumn("n_chars", F.when(F.col("spans").isNull(), F.col("n_chars")).otherwise(F.length("text"))).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document row as often as the mix uses it, at least once; a null source is a source, an empty or null text has no tokens and is there once. Of rows that are equal in all columns the uses count together. An empty table stays empty."""
    ready(spark)
    docs = docs.select(*COLUMNS)
    key = F.xxhash64(*COLUMNS)
    sized = mixing.sizes(docs.withColumn("key", key), id_col="key").drop("text_hash")
    uses = mixing.schedule(sized).groupBy("doc_id").agg(F.count("*").cast("int").alias("uses"), F.count_if(F.col("pass") == 0).alias("rows")).withColumnRenamed("doc_id", "key")
    rows = docs.withColumn("key", key).join(uses, "key")
    again = lambda df: df.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "uses")).alias("use")).select(*COLUMNS)
    # equal rows are made one before their uses are spread
    several = rows.where("rows > 1").groupBy(*COLUMNS).agg(F.max("uses").alias("uses"))
    return again(rows.where("rows = 1")).union(again(several))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document row; null and empty texts have none, repeated rows stay, an empty table gives no rows."""
    ready(spark)
    return bpe.encoded(docs)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mixing_stage),
    ("encoding", encoding),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
