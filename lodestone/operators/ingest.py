"""Inventory of files and pages, incremental ingestion and exact duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import text


def content_hash(c: Column | str) -> Column:
    return F.sha2(F.col(c) if isinstance(c, str) else c, 256)


def document_id(hash_: Column) -> Column:
    return F.substring(hash_, 1, 16)


def probed(pages: DataFrame, threshold: int = 500) -> DataFrame:
    """(doc_id, pages, chars, images, status) from page rows (doc_id, chars, images)."""
    d = pages.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum("chars").alias("chars"), F.sum("images").alias("images"))
    low = (F.col("chars") < threshold) & (F.col("pages") > 0)
    status = (
        F.when(low & ((F.col("images") > 0.8 * F.col("pages")) | (F.col("chars") < 100)), "OCR_REQUIRED").when(low, "PARTIAL").when(F.col("chars") <= 50, "OCR_REQUIRED").otherwise("SUCCESS")
    )
    return d.withColumn("status", status)


def page_gate(pages: DataFrame, threshold: int = 30) -> DataFrame:
    n = F.length(F.trim(text("text")))
    return pages.withColumn("char_count", n).withColumn("has_text", n > threshold).withColumn("ocr_required", (n <= threshold) & (F.col("images") > 0))


def document_gate(gated: DataFrame) -> DataFrame:
    """(doc_id, ocr_pages, ocr_required): more than 30 % of pages, or fewer than 500 characters in all."""
    d = gated.groupBy("doc_id").agg(F.count_if("ocr_required").alias("ocr_pages"), F.count("*").alias("pages"), F.sum("char_count").alias("chars"))
    return d.select("doc_id", "ocr_pages", ((F.col("ocr_pages") > 0.3 * F.col("pages")) | (F.col("chars") < 500)).alias("ocr_required"))


def first_n(files: DataFrame, n: int, order: str = "path") -> DataFrame:
    return files.orderBy(order).limit(n)


def outcomes(docs: DataFrame, failures: DataFrame) -> DataFrame:
    """(doc_id, status, warnings) of documents whose stages may have failed: failures has (doc_id, stage, message). A failure of the whole is FAILED, one of the sections or too little text PARTIAL, any other only a warning; a document without failures is a SUCCESS."""
    by = failures.groupBy("doc_id").agg(
        F.bool_or(F.col("stage") == "document").alias("fatal"),
        F.bool_or(F.col("stage").isin("section", "low_text")).alias("part"),
        F.array_join(F.array_sort(F.collect_list(F.concat_ws("_failed:", "stage", "message"))), "; ").alias("warnings"),
    )
    out = docs.select("doc_id").join(by, "doc_id", "left")
    return out.select("doc_id", F.when(F.col("fatal"), "FAILED").when(F.col("part"), "PARTIAL").otherwise("SUCCESS").alias("status"), "warnings")


def manifest(docs: DataFrame, children: dict[str, DataFrame], key: str = "standard_id") -> DataFrame:
    """The documents with a count a kind of children: a row a document, also without any. Children are counted before they are joined."""
    for name, child in children.items():
        docs = docs.join(child.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return docs


def unseen(files: DataFrame, stored: DataFrame, key: str = "sha") -> DataFrame:
    return files.join(stored.select(key), key, "left_anti")


def duplicates(files: DataFrame, key: str = "sha", order: str = "path") -> DataFrame:
    """Adds `copy`: 0 for the first file of a content, then 1, 2, ...; where only the first matters, firsts() needs no window."""
    return files.withColumn("copy", F.row_number().over(W.partitionBy(key).orderBy(order)) - 1)


def firsts(files: DataFrame, key: str = "sha", order: str = "path") -> DataFrame:
    """(key, order, n): the first file of each content and how many have it, by partial minima: a content in a third of all files is no burden."""
    return files.groupBy(key).agg(F.min(order).alias(order), F.count("*").alias("n"))


def surplus(files: DataFrame, key: str = "sha") -> DataFrame:
    """One row: files, distinct contents and surplus copies. Counts are partial sums, so a content in a third of all files is no burden."""
    n = files.groupBy(key).agg(F.count("*").alias("n"))
    return n.agg(F.sum("n").alias("files"), F.count("*").alias("contents"), F.sum(F.col("n") - 1).alias("surplus"))


def status_counts(probes: DataFrame) -> DataFrame:
    return probes.groupBy("status").agg(F.count("*").alias("n"))


def tender_pages(tenders: DataFrame) -> DataFrame:
    """A plain text as one page."""
    return tenders.select(F.col("tender_id").alias("doc_id"), F.lit(1).alias("page"), F.col("text"), F.length(text("text")).cast("bigint").alias("char_count"))


def accepted(uploads: DataFrame, most_bytes: int = 25 << 20) -> DataFrame:
    return uploads.where((F.col("bytes") <= most_bytes) & F.lower("name").endswith(".pdf"))
