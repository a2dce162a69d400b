"""Files in and tables out."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.identifiers import file_hints
from lodestone.operators.ingest import content_hash, document_id


def scan(spark: SparkSession, root: str, pattern: str = "*.pdf") -> DataFrame:
    """Files below root: path, bytes, sha, doc_id and what the name hints at. Contents are hashed where they are read and not kept."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    number, year = file_hints(name)
    sha = content_hash("content")
    return raw.select("path", F.col("length").alias("bytes"), sha.alias("sha"), document_id(sha).alias("doc_id"), number.alias("number_hint"), year.alias("year_hint"))


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Page texts as JSON lines or Parquet, by suffix; malformed JSON rows give null columns instead of an error."""
    schema = "doc_id string, page int, text string, images int"
    return spark.read.schema(schema).json(path, mode="PERMISSIVE") if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def benchmark(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries of a benchmark file, one row a query."""
    schema = "queries array<struct<id:string,query:string,relevant_ids:array<string>,relevant_topics:array<string>,category:string,difficulty:string>>"
    return spark.read.schema(schema).json(path, multiLine=True).select(F.explode("queries").alias("q")).select("q.*")


def canonical(standards: DataFrame, sections: DataFrame, chunks: DataFrame, specs: DataFrame) -> DataFrame:
    """One nested row a standard; children are gathered before they are joined."""
    out = standards
    for name, child in (("sections", sections), ("chunks", chunks), ("specifications", specs)):
        cols = [c for c in child.columns if c != "standard_id"]
        out = out.join(child.groupBy("standard_id").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name)), "standard_id", "left")
    return out


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder for tables between steps, in the one that spark.checkpoint.dir names; a temporary one only where all runs in this process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-lodestone-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write_json(nested: DataFrame, path: str) -> None:
    nested.write.mode("overwrite").json(path)


def write_table(df: DataFrame, path: str, by: str | None = None) -> None:
    """Parquet; with `by`, only the partitions that df has are replaced."""
    w = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    (w.partitionBy(by) if by else w).parquet(path)
