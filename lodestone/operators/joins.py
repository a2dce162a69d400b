"""How tables of unknown size are joined."""

from __future__ import annotations

from pyspark.sql import DataFrame


def by_sorting(df: DataFrame) -> DataFrame:
    """df for a join by sorting, whatever Spark takes its size to be: it counts an exploded row as one, and a file's rows as large as the compressed file, and would send millions of rows to every task by way of the driver."""
    return df.hint("merge")
