"""Reading documents whose parts may be broken: what fails is put aside with its stage, the rest goes on."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.ingest import outcomes
from lodestone.sources.files import work_folder

PAGES = "array<struct<page:int,text:string,outline:string,tables:array<string>>>"
OUTLINE = "array<struct<level:int,title:string>>"
CELLS = "array<array<string>>"
ROWS = 256
"""Rows whose results a task holds at once."""


def isolated(rows: DataFrame, column: str, work: Callable[[Any], Any], kind: str, out: str = "out") -> DataFrame:
    """rows with `out`, what `work` makes of each value of a column, and `error`, the name of the exception where it raised one or made something that isn't of the kind; `out` is null then. Values are taken one by one, so that no failure touches another row."""
    kind = T._parse_datatype_string(kind)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, kind), T.StructField("error", T.StringType())])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        target = to_arrow_type(kind)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                b, values, errors = batch.slice(at, ROWS), [], []
                for x in b.column(column):
                    try:
                        values.append(pa.array([work(x.as_py())], target))
                        errors.append(None)
                    except Exception as e:  # a row's failure is its own
                        values.append(pa.nulls(1, target))
                        errors.append(type(e).__name__)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.concat_arrays(values), pa.array(errors, pa.string())], names=[*b.schema.names, out, "error"])

    return rows.mapInArrow(run, schema)


def page_list() -> Callable[[str], list]:
    """A reader of a document's JSON: {"pages": [{"page", "text", "outline", "tables"}]}."""

    def read(payload: str) -> list:
        import json

        pages = json.loads(payload, strict=False)["pages"]
        return [{"page": int(p["page"]), "text": p["text"], "outline": p.get("outline"), "tables": p.get("tables")} for p in pages]

    return read


def outline_list() -> Callable[[str], list]:
    def read(outline: str) -> list:
        import json

        return [{"level": int(level), "title": title} for level, title in json.loads(outline)]

    return read


def cell_rows() -> Callable[[str], list]:
    def read(table: str) -> list:
        import json

        return [[None if x is None else str(x) for x in row] for row in json.loads(table)]

    return read


def read_documents(raw: DataFrame) -> dict[str, DataFrame]:
    """pages, sections, tables, failures (doc_id, stage, message) and outcomes (doc_id, status, warnings) of raw (doc_id, payload).

    A payload that can't be read is a failure of the document, and there is
    nothing else of it; a broken outline or table is one of its stage, and the
    document keeps what else it has. Each step is written, so that nothing is
    read twice.
    """
    spark, folder = raw.sparkSession, work_folder(raw.sparkSession, "documents")

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    read = kept(isolated(raw.select("doc_id", "payload"), "payload", page_list(), PAGES, "pages").drop("payload"), "read")
    pages = read.select("doc_id", F.explode("pages").alias("p")).select("doc_id", "p.*")
    outlines = kept(isolated(pages.where("outline IS NOT NULL").select("doc_id", "page", "outline"), "outline", outline_list(), OUTLINE, "entries"), "outlines")
    each = pages.select("doc_id", "page", F.posexplode("tables").alias("table_no", "table"))
    tables = kept(isolated(each, "table", cell_rows(), CELLS, "cells").drop("table"), "tables")
    failed = lambda df, stage: df.where("error IS NOT NULL").select("doc_id", F.lit(stage).alias("stage"), F.col("error").alias("message"))
    failures = failed(read, "document").unionByName(failed(outlines, "section")).unionByName(failed(tables, "table"))
    sections = outlines.select("doc_id", "page", F.posexplode("entries").alias("pos", "e")).select("doc_id", "page", "pos", "e.*")
    return {
        "pages": pages.select("doc_id", "page", "text"),
        "sections": sections,
        "tables": tables.where("error IS NULL").drop("error"),
        "failures": failures,
        "outcomes": outcomes(raw, failures),
    }
