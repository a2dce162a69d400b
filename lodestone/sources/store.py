"""Tables that are replaced together: each save writes new folders, and one write of the version moves readers to all of them at once."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import graph

POINTERS = "version bigint, name string, path string"


class Store:
    """Named tables below a root folder.

    A version is a folder of rows (version, name, path), all of them in one
    file that Spark's commit makes visible as a whole: before that, and after a
    save that failed on the way, readers see the last version entire. Two saves
    at once want the same folder, and the second one fails. A DataFrame that was
    read stays as it was, as no folder is ever written over.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _pointers(self) -> dict[str, tuple[int, str]]:
        try:
            rows = self.spark.read.schema(POINTERS).json(f"{self.root}/versions/*")
        except AnalysisException:  # nothing was saved yet
            return {}
        last = rows.groupBy("name").agg(F.max(F.struct("version", "path")).alias("p"))
        return {r["name"]: (r["p"]["version"], r["p"]["path"]) for r in last.collect()}  # a row a table

    def version(self) -> int:
        return max((v for v, _ in self._pointers().values()), default=0)

    def names(self) -> list[str]:
        return sorted(self._pointers())

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._pointers()[name][1])

    def save(self, tables: dict[str, DataFrame]) -> int:
        """The tables in place of those of their names; others stay. Returns the new version."""
        found = self._pointers()
        version = max((v for v, _ in found.values()), default=0) + 1
        made = []
        for name, df in tables.items():
            path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            made.append((version, name, path))
        self.spark.createDataFrame(made, POINTERS).coalesce(1).write.mode("error").json(f"{self.root}/versions/{version:012}")
        return version

    def replace(self, tables: dict[str, DataFrame], by: str = "workspace_id") -> int:
        """Of each table the rows of the workspaces that its new rows name give way to these; all tables move at once."""
        found = self._pointers()
        return self.save({name: graph.replaced(self.read(name), df, by) if name in found else df for name, df in tables.items()})

    def delete(self, gone: DataFrame, by: str = "workspace_id") -> int:
        """The rows of these workspaces leave every table that has such a column."""
        tables = {name: self.read(name) for name in self.names()}
        return self.save({name: graph.deleted(df, gone.select(by).distinct(), by) for name, df in tables.items() if by in df.columns})
