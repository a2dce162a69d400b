"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors of a label are compared in tiles of two chunks. A tile multiplies the
vectors quantised to int8; each vector's quantisation error e = |x - xq| is
known, so the true cosine differs from the quantised one by at most
ex + (1 + ex) ey. Only pairs that may reach the threshold within that bound are
computed again in double precision. Equal vectors are one class, compared once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table
from ._graph import components

THRESHOLD = 0.98
CHUNK_BYTES = 1 << 22
"""A chunk holds so many bytes of doubles, 64 to 8192 vectors: what a tile needs in memory, whatever the label's size."""
STRIP = 512
DENSE = 0.02
"""Strips with a larger share of candidates are computed again whole; pairs within NEAR of the threshold then once more pair by pair, so that every decision rests on the same sum."""
NEAR = 1e-9


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        dims, keys, vecs = [], [], []
        for label, value in zip(b.column("label").to_pylist(), b.column("embedding")):
            x = None
            if label is not None and value.is_valid and not value.values.null_count:
                x = np.asarray(value.values, dtype=np.float64) + 0.0  # no negative zero
                if not len(x) or not np.isfinite(x).all() or not x.any():
                    x = None
            if x is not None:
                raw = x.tobytes()
                dims.append(len(x))
                keys.append(hashlib.md5(f"{label}|".encode() + raw).hexdigest())
                vecs.append(raw)
            else:
                dims.append(None)
                keys.append(None)
                vecs.append(None)
        yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(dims, pa.int32()), pa.array(keys, pa.string()), pa.array(vecs, pa.binary())], names=["vec_id", "label", "dim", "key", "vec"])


def _scaled(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by their largest component, so that no square overflows, and their lengths then."""
    v = raw / np.abs(raw).max(axis=1, keepdims=True)
    return v, np.sqrt((v * v).sum(axis=1))


def quantised(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scale, error) of the unit vectors."""
    v, norm = _scaled(raw)
    x = v / norm[:, None]
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.sqrt(((x - q * scale[:, None]) ** 2).sum(axis=1))


PACKED = "label {label}, dim int, chunk bigint, chunks bigint, keys binary, counts binary, raw binary, q binary, scale binary, error binary"


def _pack(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("key")
    n, dim = rows.num_rows, rows.column("dim")[0].as_py()
    raw = np.frombuffer(b"".join(rows.column("vec").to_pylist()), np.float64).reshape(n, dim)
    q, scale, error = quantised(raw)
    blobs = [bytes.fromhex("".join(rows.column("key").to_pylist())), np.asarray(rows.column("n"), np.int64).tobytes(), raw.tobytes(), q.tobytes(), scale.tobytes(), error.tobytes()]
    one = [rows.column(c).combine_chunks().slice(0, 1) for c in ("label", "dim", "chunk", "chunks")]
    return pa.Table.from_arrays([*one, *[pa.array([x], pa.binary()) for x in blobs]], names=["label", "dim", "chunk", "chunks", "keys", "counts", "raw", "q", "scale", "error"])


class Forest:
    """Union-find over the rows of a tile."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.root[a], self.root[b]
        some = x != y
        if not some.any():
            return
        pairs = np.unique(np.minimum(x, y)[some] * len(self.root) + np.maximum(x, y)[some])
        up: dict[int, int] = {}

        def top(v: int) -> int:
            while v in up:
                v = up[v]
            return v

        for p in pairs.tolist():
            v, w = top(p // len(self.root)), top(p % len(self.root))
            if v != w:
                up[max(v, w)] = min(v, w)
        to = np.arange(len(self.root))
        for v in up:
            to[v] = top(v)
        self.root = to[self.root]


def _cosines(va: np.ndarray, na: np.ndarray, vb: np.ndarray, nb: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Of pairs of rows, a bounded number at a time."""
    parts = [np.einsum("ij,ij->i", va[r[k : k + 65536]], vb[c[k : k + 65536]]) for k in range(0, len(r), 65536)]
    return np.concatenate(parts) / (na[r] * nb[c]) if parts else np.zeros(0)


def tile(a: dict, b: dict, same: bool, dim: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(linked copies of each row of a and then b, root row of each). same: a is b, and a row is not compared with itself."""
    def of(x: dict) -> tuple:
        raw = np.frombuffer(x["raw"], np.float64).reshape(-1, dim)
        exact = np.float32 if dim * 127 * 127 < 1 << 24 else np.float64  # sums of int8 products stay exact
        return (*_scaled(raw), np.frombuffer(x["q"], np.int8).reshape(-1, dim).astype(exact), np.frombuffer(x["scale"]), np.frombuffer(x["error"]), np.frombuffer(x["counts"], np.int64))

    va, na, qa, sa, ea, ca = of(a)
    vb, nb, qb, sb, eb, cb = (va, na, qa, sa, ea, ca) if same else of(b)
    n, m = len(va), len(vb)
    shift = 0 if same else n
    links, forest = np.zeros(shift + m, np.int64), Forest(shift + m)
    for at in range(0, n, STRIP):
        rows = slice(at, min(n, at + STRIP))
        s = (qa[rows] @ qb.T) * sa[rows, None] * sb
        may = s >= threshold - 1e-9 - (ea[rows, None] + (1 + ea[rows, None]) * eb)
        if same:
            may &= np.arange(at, rows.stop)[:, None] < np.arange(m)
        r, c = np.nonzero(may)
        if not len(r):
            continue
        if len(r) > DENSE * may.size:
            cos = (va[rows] @ vb.T / (na[rows, None] * nb))[r, c]
            again = np.abs(cos - threshold) < NEAR
            cos[again] = _cosines(va, na, vb, nb, at + r[again], c[again])
        else:
            cos = _cosines(va, na, vb, nb, at + r, c)
        r, c = r[cos >= threshold] + at, c[cos >= threshold]
        links[: max(n, 1)] += np.bincount(r, weights=cb[c], minlength=n).astype(np.int64)[: max(n, 1)]
        links[shift:] += np.bincount(c, weights=ca[r], minlength=m).astype(np.int64)
        # stars first: each row with its first partner, each column with its first
        ur, i = np.unique(r, return_index=True)
        forest.link(ur, c[i] + shift)
        uc, i = np.unique(c, return_index=True)
        forest.link(r[i], uc + shift)
        forest.link(r, c + shift)
    return links, forest.root


def _tiles(threshold: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """The one or two chunks of a tile."""
        rows = rows.sort_by("chunk").to_pylist()
        a, b = rows[0], rows[-1]
        links, root = tile(a, b, len(rows) == 1, a["dim"], threshold)
        names = a["keys"] if len(rows) == 1 else a["keys"] + b["keys"]
        name = lambda i: names[16 * i : 16 * i + 16].hex()
        some = np.nonzero(links)[0].tolist()
        return pa.table({"key": pa.array([name(i) for i in some], pa.string()), "links": pa.array(links[some], pa.int64()), "root": pa.array([name(int(root[i])) for i in some], pa.string())})

    return run


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row per vector row: vec_id, n_links, component_id, kept.

    Rows link when their labels are equal and their cosine reaches the
    threshold. A null label, a null, empty or zero vector, one with a null or
    non-finite component, and vectors of different lengths link with nothing.
    Repeated rows are separate vectors and link with each other. An empty table
    gives no rows. A vector may have any length that fits a task; a chunk holds
    64 at least.
    """
    label = vectors.schema[label_col].dataType.simpleString()
    ident = vectors.schema[id_col].dataType.simpleString()
    df = vectors.select(F.col(id_col).alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("embedding"))
    keyed = staged(df.mapInArrow(_keyed, f"vec_id {ident}, label {label}, dim int, key string, vec binary"), "vectors")
    classes = keyed.where("key IS NOT NULL").groupBy("label", "dim", "key").agg(F.count("*").alias("n"), F.min("vec_id").alias("low"), F.any_value("vec").alias("vec"))
    classes = staged(classes, "vector-classes")
    each = F.greatest(F.lit(64), F.least(F.lit(8192), F.floor(F.lit(CHUNK_BYTES) / (8 * F.col("dim")))))
    chunks = classes.groupBy("label", "dim").agg(F.ceil(F.count("*") / F.max(each)).alias("chunks"))
    dealt = classes.join(chunks, ["label", "dim"]).withColumn("chunk", F.pmod(F.xxhash64("key"), "chunks"))
    packed = dealt.groupBy("label", "dim", "chunk").applyInArrow(_pack, PACKED.format(label=label))
    packed = staged(packed, "vector-chunks")
    pairs = packed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("chunks") - 1)))
    pairs = pairs.withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
    found = staged(pairs.groupBy("label", "dim", "i", "j").applyInArrow(_tiles(threshold), "key string, links bigint, root string"), "vector-links")
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    root = components(found, "key", "root").select(F.col("node").alias("key"), "root")
    of = classes.select("key", "n", "low").join(links, "key", "left").join(root, "key", "left").withColumn("root", F.coalesce("root", "key"))
    # written, so that a large component's rows can be split in the join
    of = staged(of, "vector-roots")
    least = staged(of.groupBy("root").agg(F.min("low").alias("least")), "vector-least")
    of = staged(of.join(least, "root").select("key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "least"), "vector-components")
    out = keyed.select("vec_id", "key").join(of, "key", "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("least", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("least", "vec_id")).alias("kept"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), ok AS (
  SELECT vec_id, label, e FROM v
  WHERE label IS NOT NULL AND e IS NOT NULL AND len(e) > 0
    AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), r(v, m) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT l.b, r.m FROM r JOIN l ON l.a = r.v
), c AS (
  SELECT v, min(m) AS m FROM r GROUP BY v
), n AS (
  SELECT a, count(*) AS n FROM l GROUP BY a
)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.m AS component_id, e.vec_id = c.m AS kept
FROM embeddings e JOIN c ON c.v = e.vec_id LEFT JOIN n ON n.a = e.vec_id
"""
