"""Incremental ingestion as a stream of new page files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.operators.ingest import content_hash, unseen


def ingest(spark: SparkSession, source: str, schema: str, stored: str, checkpoint: str, sink: Callable[[DataFrame], None]) -> StreamingQuery:
    """Every batch of new files: rows whose text isn't stored yet, once each, are stored, the table a partition a batch, and go to the sink from there.

    The stored table is the manifest: all columns, `sha` and `batch`. A batch that
    runs again after a failure replaces its own partition and is compared with the
    other ones only, so that it stores and hands on the rows of its first run; a
    sink that replaces what it has of a `batch` has every text once.
    """

    def batch(df: DataFrame, n: int) -> None:
        new = df.withColumn("sha", content_hash("text")).dropDuplicates(["sha"])
        known = spark.read.schema("sha string, batch bigint").parquet(stored).where(F.col("batch") != n) if _exists(spark, stored) else spark.createDataFrame([], "sha string")
        part = f"{stored.rstrip('/')}/batch={n}"
        unseen(new, known).write.mode("overwrite").parquet(part)
        sink(spark.read.schema(new.schema).parquet(part).withColumn("batch", F.lit(n).cast("bigint")))

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path).limit(0).count()
    except Exception as e:  # nothing has been stored yet
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return True


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Events by type and window; those later than the watermark are left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
