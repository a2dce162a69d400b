"""Connected components by alternating large-star and small-star steps, as DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import staged

CHUNK = 1 << 18
"""Edges that a task contracts at a time."""


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges as a star for each component of theirs: (node, least node), the least nodes themselves left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(nodes))
    while True:
        before = low.copy()
        least = np.minimum(low[x], low[y])
        for end in (x, y):
            np.minimum.at(low, low[end], least)
            np.minimum.at(low, end, least)
        low = low[low]
        if (low == before).all():
            break
    far = low != np.arange(len(nodes))
    return nodes[far], nodes[low[far]]


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def done(held: list) -> pa.RecordBatch:
        v, u = contracted(*(np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in held]) for c in ("v", "u")))
        return pa.RecordBatch.from_arrays([pa.array(x, held[0].schema.field("v").type) for x in (v, u)], names=["v", "u"])

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= CHUNK:
            yield done(held)
            held = []
    if held:
        yield done(held)


def _stars(e: DataFrame) -> bool:
    """Whether no node has two smaller neighbours, or both a smaller and a larger one: components are then told by their edges."""
    ends = e.select(F.explode(F.array(F.struct(F.col("v").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")), F.struct(F.col("u").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))).alias("x")).select("x.*")
    each = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return each.where("down > 1 OR (down = 1 AND up = 1)").isEmpty()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge: root is the smallest node reachable. Self-loops and repeated edges do no harm; no edges give no rows.

    Tasks contract the edges they read, a bounded number at a time, to stars;
    rounds of large and small stars do the rest. Minima are partial aggregates
    and the joins back are on the node, so a hub is never gathered in one
    place. Each round is written to the shared folder and ends the lineage.
    Rounds grow with the logarithm of the longest path.
    """

    kind = edges.schema[a].dataType.simpleString()

    def written(df: DataFrame) -> DataFrame:
        return staged(df.mapInArrow(_contract, f"v {kind}, u {kind}").distinct(), "edges")

    e = written(edges.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where("v <> u"))
    while not _stars(e):
        # large star: every larger neighbour of a node moves to the node's smallest neighbour
        both = e.select(F.explode(F.array(F.struct("v", "u"), F.struct(F.col("u").alias("v"), F.col("v").alias("u")))).alias("x")).select("x.*")
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"))
        large = both.join(low, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u")).where("v <> u")
        # small star: every smaller neighbour, and the node, move to the smallest
        low = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(low, "v").select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("x"))
        e = written(small.select(F.col("x.u").alias("v"), F.col("x.m").alias("u")).where("v <> u"))
    return e.union(e.select("u", "u").distinct()).toDF("node", "root")
