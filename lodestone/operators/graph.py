"""Relationship graphs and workspaces as edge and row tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.text import text
from lodestone.operators.ranking import first_of


def new_edges(references: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, target, type, confidence) of references that are no edge yet; of several the surest, then the smallest type."""
    order = F.struct(F.col("confidence").isNull(), -F.col("confidence"), "type")
    once = references.groupBy("source", "target").agg(F.min_by(F.struct("type", "confidence"), order).alias("x")).select("source", "target", "x.*")
    return once.join(edges.select("source", "target"), ["source", "target"], "left_anti").select("source", "target", "type", "confidence")


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.coalesce("type", F.lit("unknown")).alias("type")).agg(F.count("*").alias("n"))


def ego_graphs(roots: DataFrame, sections: DataFrame, specs: DataFrame, references: DataFrame, standards: DataFrame) -> DataFrame:
    """(root, kind, node, known): up to 15 sections, 10 specifications and 15 references of each root standard; known tells whether a reference is in the corpus."""
    part = lambda df, kind, node, n: first_of(df.join(roots.select(F.col("standard_id")), "standard_id", "left_semi"), "standard_id", [node], n).select(F.col("standard_id").alias("root"), F.lit(kind).alias("kind"), F.col(node).alias("node"))
    refs = part(references, "references", "target", 15)
    there = standards.select(F.col("standard_id").alias("node"), F.lit(True).alias("there"))
    refs = refs.join(there, "node", "left").select("root", "kind", "node", F.coalesce("there", F.lit(False)).alias("known"))
    own = part(sections, "contains", "section_id", 15).unionByName(part(specs, "specifies", "spec_id", 10)).withColumn("known", F.lit(True))
    return own.unionByName(refs)


def workspace_graph(traces: DataFrame, items: DataFrame, edges: DataFrame, most: int = 5) -> DataFrame:
    """(workspace_id, source, target, type): requirements to the standards they are traced to, and references between standards of the workspace, `most` a standard."""
    members = traces.select("workspace_id", "standard_id").union(items.select("workspace_id", "standard_id")).where("standard_id IS NOT NULL").distinct()
    traced = traces.where("standard_id IS NOT NULL").select("workspace_id", F.col("requirement_id").alias("source"), F.col("standard_id").alias("target"), F.lit("traceable_to").alias("type")).distinct()
    # of a workspace only members that some reference names, and of these each source is paired by the shorter of two lists: its references or its workspace's targets
    edges = edges.select("source", "target", "type")
    out, named = edges.groupBy("source").agg(F.count("*").alias("n_out")), edges.select("target").distinct()
    b = members.select("workspace_id", F.col("standard_id").alias("target")).join(named, "target", "left_semi")
    a = members.select("workspace_id", F.col("standard_id").alias("source")).join(out, "source")
    a = a.join(b.groupBy("workspace_id").agg(F.count("*").alias("n_in")), "workspace_id")
    by_edge = a.where("n_out <= n_in").join(edges, "source").join(b, ["workspace_id", "target"])
    by_member = a.where("n_out > n_in").join(b, "workspace_id").join(edges, ["source", "target"])
    cross = by_edge.select("workspace_id", "source", "target", "type").unionByName(by_member.select("workspace_id", "source", "target", "type"))
    w = W.partitionBy("workspace_id", "source").orderBy("target", "type")
    cross = cross.withColumn("n", F.row_number().over(w)).where(F.col("n") <= most)
    return traced.unionByName(cross.select("workspace_id", "source", "target", "type"))


def all_relationships(edges: DataFrame, most: int = 200) -> DataFrame:
    """The first relationships by source and target; a target that the corpus doesn't have goes by its identifier (`target_identifier`, where edges have one)."""
    if "target_identifier" in edges.columns:
        edges = edges.withColumn("target", F.coalesce(F.nullif("target", F.lit("")), F.col("target_identifier"))).drop("target_identifier")
    return edges.orderBy("source", "target").limit(most)


def unique_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes once each, the first by order."""
    return nodes.groupBy(F.col("node").alias("key")).agg(F.min_by(F.struct(*nodes.columns), F.struct("ord")).alias("x")).select("x.*")


def upserted(old: DataFrame, new: DataFrame, key: str, keep_old_if_empty: list[str]) -> DataFrame:
    """new over old by key; the named columns keep their old value where the new one is null or empty."""
    cols = [c for c in new.columns if c != key]
    a, b = old.alias("a"), new.alias("b")
    pick = [F.coalesce(F.nullif(F.col(f"b.{c}").cast("string"), F.lit("")).cast(new.schema[c].dataType), F.col(f"a.{c}")).alias(c) if c in keep_old_if_empty else F.when(F.col(f"b.{key}").isNotNull(), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")).alias(c) for c in cols]
    return a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer").select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *pick)


def last_writes(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Each key's last row by order."""
    return rows.groupBy(*[F.col(k).alias(f"key_{k}") for k in keys]).agg(F.max_by(F.struct(*rows.columns), F.struct(order)).alias("x")).select("x.*")


def replaced(old: DataFrame, new: DataFrame, by: str = "workspace_id") -> DataFrame:
    """new instead of everything old in the same workspaces."""
    return old.join(new.select(by).distinct(), by, "left_anti").unionByName(new)


def requirement_rows(reqs: DataFrame, most: int = 5) -> DataFrame:
    """(tender_id, category, parameter, value, is_specified) of requirements as a workspace keeps them: a row a value, of lists the first `most`."""
    one = lambda c: F.when(text(c) != "", F.array(F.struct(F.lit(c).alias("category"), F.col(c).alias("value")))).otherwise(F.array())
    many = lambda c: F.transform(F.slice(c, 1, most), lambda x: F.struct(F.lit(c).alias("category"), x.alias("value")))
    parts = [p.cast("array<struct<category:string,value:string>>") for p in (*map(one, ("product", "material", "application", "capacity")), *map(many, ("testing", "safety")))]
    rows = reqs.select("tender_id", F.explode(F.concat(*parts)).alias("r"))
    return rows.select("tender_id", "r.category", F.col("r.category").alias("parameter"), "r.value", F.lit(1).alias("is_specified"))


def deleted(rows: DataFrame, gone: DataFrame, by: str = "workspace_id") -> DataFrame:
    return rows.join(gone.select(by), by, "left_anti")


def workspaces(ws: DataFrame, items: DataFrame) -> DataFrame:
    """Workspaces with their items in sort order."""
    i = items.groupBy("workspace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sort_order", "item_id"))), lambda x: x["item_id"].cast("string")), ",").alias("items"), F.count("*").alias("n_items"))
    return ws.join(i, "workspace_id", "left").select("*").withColumn("n_items", F.coalesce("n_items", F.lit(0)))


def created(requests: DataFrame) -> DataFrame:
    """New workspaces from requests (request_id, name, description, created_at): the id comes from the request's, so that a request that is made again gives the same one; a missing name is made from the id."""
    id_ = F.concat(F.lit("WS_"), F.substring(F.sha2(F.col("request_id").cast("string"), 256), 1, 12))
    new = requests.withColumn("workspace_id", id_)
    name = F.coalesce(F.nullif("name", F.lit("")), F.concat(F.lit("Procurement "), F.substring("workspace_id", 1, 8)))
    return new.select("workspace_id", name.alias("name"), "description", F.lit("active").alias("status"), "created_at")


def listed(ws: DataFrame) -> DataFrame:
    """Workspaces, the newest first."""
    return ws.orderBy(F.col("created_at").desc(), "workspace_id")


def updated(ws: DataFrame, changes: DataFrame, columns: tuple[str, ...] = ("name", "description", "status")) -> DataFrame:
    """Workspaces with the columns that a change names; null leaves a column as it is, and changes of unknown workspaces do nothing."""
    new = changes.select("workspace_id", *[F.col(c).alias(f"new_{c}") for c in columns])
    return ws.join(new, "workspace_id", "left").select("workspace_id", *[F.coalesce(f"new_{c}", c).alias(c) for c in columns])
