"""Hard negatives by Strassen products of int64 tiles and mergeable heaps.

Vectors are scaled and floored to integers, so that scores are exact. Rows lie
in chunks, anchors in blocks. A tile, a block by a chunk, is multiplied by
Strassen's recursion with zero padding; sums of 64-bit integers wrap, which
does no harm as the scores themselves fit. Each tile leaves a bounded heap an
anchor, and heaps merge, a bounded number at a time, round after round:

1. blocks meet the chunks that may hold their labels; heaps of the best rows of
   the same label give an anchor's positives;
2. blocks, dealt anew with their positives, meet all chunks; heaps of the best
   rows of other labels inside of each positive's window give its negatives.

The anchors are the stated query set, compared with all rows in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import staged, table

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LEAST_SHARE = 80
"""Per cent of the positive's score that a negative reaches at least."""
CHUNK_BYTES = 1 << 22
"""A chunk holds so many bytes of int64 components, 64 to 8192 rows."""
BLOCK = 1024
STRIP = 128
"""Anchors of a block, and of those that are scored at a time."""
LEAF = 16
"""Products with a side of so many are done directly."""
FAN = 32
"""Heaps of so many tiles are merged in one task."""
LONGEST = 2.0**31
"""Rows at least as long take no part, so that scores fit 64 bits."""


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b of int64 by Strassen's recursion; odd sides are padded with zeros."""
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return a @ b
    a = np.pad(a, ((0, m % 2), (0, k % 2)))
    b = np.pad(b, ((0, k % 2), (0, n % 2)))
    y, z, x = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:y, :z], a[:y, z:], a[y:, :z], a[y:, z:]
    b11, b12, b21, b22 = b[:z, :x], b[:z, x:], b[z:, :x], b[z:, x:]
    c = np.empty((2 * y, 2 * x), np.int64)
    p = product(a11 + a22, b11 + b22)
    c[:y, :x] = p
    c[y:, x:] = p
    p = product(a21 + a22, b11)
    c[y:, :x] = p
    c[y:, x:] -= p
    p = product(a11, b12 - b22)
    c[:y, x:] = p
    c[y:, x:] += p
    p = product(a22, b21 - b11)
    c[:y, :x] += p
    c[y:, :x] += p
    p = product(a11 + a12, b22)
    c[:y, :x] -= p
    c[:y, x:] += p
    c[y:, x:] += product(a21 - a11, b11 + b12)
    c[:y, :x] += product(a12 - a22, b21 + b22)
    return c[:m, :n]


def _quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """dim and int64 components of the rows that take part."""
    for b in batches:
        lists = b.column("embedding")
        ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
        values = lists.values.slice(ends[0], ends[-1] - ends[0])
        x = np.asarray(pc.fill_null(values.cast(pa.float64()), np.nan), np.float64)
        with np.errstate(all="ignore"):
            x = np.floor(SCALE * x)
        bounds = (ends - ends[0]).astype(np.int64)
        good = np.isfinite(x)
        x[~good] = 0
        bad = np.concatenate([[0], np.cumsum(~good)])
        far = np.abs(x) >= LONGEST
        x[far] = LONGEST
        square = np.array([float(x[i:j] @ x[i:j]) for i, j in zip(bounds.tolist(), bounds[1:].tolist())])
        ok = (bad[bounds[1:]] == bad[bounds[:-1]]) & (square < LONGEST**2 * (1 - 1e-9)) & np.asarray(lists.is_valid()) & np.asarray(b.column("label").is_valid())
        raw = x.astype("<i8").tobytes()
        q = pa.array([raw[8 * i : 8 * j] if o else None for i, j, o in zip(bounds.tolist(), bounds[1:].tolist(), ok.tolist())], pa.binary())
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("uid", "vec_id", "label", "anchor")), pa.array(np.diff(bounds), pa.int32()), q], names=["uid", "vec_id", "label", "anchor", "dim", "q"])


PACK = "dim int, name string, n int, uid binary, id binary, none binary, label binary, q binary, width int, positives binary"


def _pack(rows: pa.Table) -> pa.Table:
    """A chunk or block as one row, in the order of ids, null ids last; components as narrow as they fit."""
    rows = rows.sort_by([("vec_id", "ascending"), ("uid", "ascending")])
    n, dim = rows.num_rows, rows.column("dim")[0].as_py()
    q = np.frombuffer(b"".join(rows.column("q").to_pylist()), "<i8")
    most = int(np.abs(q).max()) if len(q) else 0
    width = next(w for w in (2, 4, 8) if most < 1 << (8 * w - 1))
    ids = np.asarray(pc.fill_null(rows.column("vec_id"), 0), np.int64)
    none = np.asarray(rows.column("vec_id").is_null(), np.uint8)
    positives = np.asarray(rows.column("positives").combine_chunks().flatten(), np.int64).tobytes() if "positives" in rows.column_names else b""
    blobs = [np.asarray(rows.column("uid"), np.int64), ids, none, np.asarray(rows.column("label"), np.int64), q.astype(f"<i{width}")]
    return pa.Table.from_arrays(
        [pa.array([dim], pa.int32()), pa.array([rows.column("name")[0].as_py()]), pa.array([n], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in blobs), pa.array([width], pa.int32()), pa.array([positives], pa.binary())],
        names=["dim", "name", "n", "uid", "id", "none", "label", "q", "width", "positives"],
    )


class Rows:
    """A packed chunk or block."""

    def __init__(self, row: dict):
        self.n = row["n"]
        self.uid, self.id, self.label = (np.frombuffer(row[c], np.int64) for c in ("uid", "id", "label"))
        self.none = np.frombuffer(row["none"], np.uint8)
        self.q = np.frombuffer(row["q"], f"<i{row['width']}").reshape(self.n, row["dim"]).astype(np.int64)
        self.positives = np.frombuffer(row["positives"], np.int64)


HEAP = "block string, part bigint, anchor bigint, slot int, score bigint, id bigint, none boolean"
FIELDS = pa.schema([("block", pa.string()), ("part", pa.int64()), ("anchor", pa.int64()), ("slot", pa.int32()), ("score", pa.int64()), ("id", pa.int64()), ("none", pa.bool_())])


def cut(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ident: np.ndarray, none: np.ndarray, most: int) -> np.ndarray:
    """Indices, in order, of the first `most` entries of each anchor and slot: higher scores first, then smaller ids, null ids last."""
    order = np.lexsort((ident, none, ~score, slot, anchor))
    a, s = anchor[order], slot[order]
    first = np.ones(len(order), bool)
    first[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    at = np.arange(len(order))
    return order[at - np.maximum.accumulate(np.where(first, at, 0)) < most]


def _heap(block: str, part: int, anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, ident: np.ndarray, none: np.ndarray, most: int) -> pa.Table:
    keep = cut(anchor, slot, score, ident, none, most)
    columns = [pa.array([block] * len(keep), pa.string()), pa.array(np.full(len(keep), part, np.int64)), *(pa.array(x[keep]) for x in (anchor, slot.astype(np.int32), score, ident, none.astype(bool)))]
    return pa.Table.from_arrays(columns, schema=FIELDS)


def _best(a: Rows, b: Rows, rows: slice, score: np.ndarray, most: int) -> tuple[np.ndarray, ...]:
    """Of a strip's anchors the best rows of their label, themselves left out."""
    key = np.where((a.label[rows, None] == b.label) & (a.uid[rows, None] != b.uid), ~score, np.iinfo(np.int64).max)
    least = np.partition(key, most - 1, axis=1)[:, most - 1 : most] if b.n > most else np.iinfo(np.int64).max - 1
    r, c = np.nonzero((key <= least) & (key < np.iinfo(np.int64).max))
    return r, np.zeros(len(r), np.int64), c


def _inside(a: Rows, b: Rows, rows: slice, score: np.ndarray, most: int, slots: int, share: int) -> tuple[np.ndarray, ...]:
    """Of a strip's anchors the best rows of other labels in the window of each of their positives."""
    positive = a.positives.reshape(a.n, slots)[rows]
    there = positive > np.iinfo(np.int64).min
    floor = positive // 100 * share - (-(positive % 100) * share) // 100
    low = np.where(there, floor, np.iinfo(np.int64).max).min(axis=1)
    r, c = np.nonzero((score >= low[:, None]) & (score <= positive.max(axis=1)[:, None]) & (a.label[rows, None] != b.label))
    s = score[r, c]
    found = []
    for slot in range(slots):
        at = np.flatnonzero(there[r, slot] & (s >= floor[r, slot]) & (s <= positive[r, slot]))
        at = at[cut(r[at], np.zeros(len(at), np.int64), s[at], b.id[c[at]], b.none[c[at]], most)]
        found.append((r[at], np.full(len(at), slot), c[at]))
    return tuple(np.concatenate(x) for x in zip(*found))


def _tiles(pick, most: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """A block and a chunk."""
        chunk, block = rows.sort_by("is_block").to_pylist()
        a, b = Rows(block), Rows(chunk)
        turned = np.ascontiguousarray(b.q.T)
        tables = []
        for at in range(0, a.n, STRIP):
            strip = slice(at, min(a.n, at + STRIP))
            score = product(a.q[strip], turned)
            r, slot, c = pick(a, b, strip, score)
            tables.append(_heap(block["name"], chunk["part"], a.uid[at + r], slot, score[r, c], b.id[c], b.none[c], most))
        return pa.concat_tables(tables)

    return run


def _merge(most: int):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        anchor, slot, score, ident = (np.asarray(rows.column(c)) for c in ("anchor", "slot", "score", "id"))
        return _heap(key[0].as_py(), key[1].as_py(), anchor, slot, score, ident, np.asarray(rows.column("none")), most)

    return run


def _heaps(blocks: DataFrame, chunks: DataFrame, on: list[str], pick, most: int, total: int, fan: int, name: str) -> DataFrame:
    """Heaps of all tiles of blocks and chunks that agree in `on`, merged to one an anchor and slot."""
    pairs = blocks.select(*on, F.col("name").alias("block")).join(chunks.select(*on, "part", F.col("name").alias("chunk")), on).select("block", "chunk", "part")
    pairs = staged(pairs, f"{name}-pairs")
    packed = [c for c in blocks.columns if c not in (*on, "part")] + (["dim"] if "dim" in on else [])
    left = blocks.join(pairs, F.col("name") == F.col("block")).select("block", "chunk", "part", F.lit(True).alias("is_block"), *packed)
    right = chunks.join(pairs.drop("part"), F.col("name") == F.col("chunk")).select("block", "chunk", "part", F.lit(False).alias("is_block"), *packed)
    heaps = staged(left.unionByName(right).groupBy("block", "chunk").applyInArrow(_tiles(pick, most), HEAP), name)
    parts = total
    while parts > 1:
        parts = -(-parts // fan)
        heaps = heaps.withColumn("part", F.floor(F.col("part") / fan)).groupBy("block", "part").applyInArrow(_merge(most), HEAP)
        heaps = staged(heaps, f"{name}-merged")
    return heaps


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = POSITIVES, negatives: int = NEGATIVES, least_share: int = LEAST_SHARE,
    chunk_bytes: int = CHUNK_BYTES, block: int = BLOCK, fan: int = FAN,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: of each anchor and each of its positives the best rows of other labels whose score is in the positive's window, from `least_share` per cent of its score to that score.

    Anchors are the rows where `anchor` holds. A null label or vector, a null
    or non-finite component, and a scaled length of LONGEST or more take no
    part; nor do vectors of other lengths than the anchor's. A negative
    positive score has an empty window. Ties go by smaller ids, null ids last.
    Repeated rows are rows of their own, also as each other's positives. An
    empty table, or no anchors, give no rows. Integer labels are compared as
    such, others by a 64-bit hash. Other columns play no part.
    """
    df = vectors.select(
        F.monotonically_increasing_id().alias("uid"), F.col(id_col).cast("bigint").alias("vec_id"), F.xxhash64(label_col).alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(vector_col).alias("embedding"), F.col(label_col).isNull().alias("none")
    ).withColumn("label", F.when(~F.col("none"), F.col("label"))).drop("none")
    rows = staged(df.mapInArrow(_quantised, "uid bigint, vec_id bigint, label bigint, anchor boolean, dim int, q binary").where("q IS NOT NULL"), "mining")

    # homes: a label of a chunk's size or more, or a pool of smaller ones
    each = F.greatest(F.lit(64), F.least(F.lit(8192), F.floor(F.lit(chunk_bytes) / (8 * F.greatest("dim", F.lit(1)))))).cast("bigint")
    labels = staged(rows.groupBy("dim", "label").agg(F.count("*").alias("n"), F.count_if("anchor").alias("anchors")).withColumn("each", each), "mining-labels")
    pools = labels.where("n < each").groupBy("dim").agg(F.ceil(F.sum("n") / F.max("each")).alias("pools"))
    homes = labels.join(pools, "dim", "left").withColumn("home", F.when(F.col("n") < F.col("each"), F.concat(F.lit("pool "), F.pmod(F.xxhash64("label"), "pools"))).otherwise(F.concat(F.lit("label "), "label")))
    sizes = homes.groupBy("dim", "home").agg(F.ceil(F.sum("n") / F.max("each")).alias("chunks"), F.ceil(F.sum("anchors") / block).alias("blocks"))
    homes = staged(homes.join(sizes, ["dim", "home"]).select("dim", "label", "home", "chunks", "blocks"), "mining-homes")
    dealt = rows.join(homes, ["dim", "label"])
    piece = lambda n: F.pmod(F.xxhash64("uid"), F.greatest(F.col(n), F.lit(1)))
    named = lambda df, *keys: df.withColumn("name", F.concat_ws("/", "dim", *keys))
    chunks = named(dealt, "home", piece("chunks")).groupBy("name").applyInArrow(_pack, PACK)
    chunks = staged(chunks.withColumn("home", F.split("name", "/")[1]), "mining-chunks")
    total = chunks.count()
    chunks = chunks.withColumn("part", F.pmod(F.xxhash64("name"), F.lit(max(total, 1))))

    blocks = staged(named(dealt.where("anchor"), "home", piece("blocks")).groupBy("name").applyInArrow(_pack, PACK).withColumn("home", F.split("name", "/")[1]), "mining-blocks")
    best = _heaps(blocks, chunks, ["dim", "home"], lambda a, b, rows, score: _best(a, b, rows, score, positives), positives, total, fan, "mining-positives")
    best = best.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "none", "id"))).alias("best"))
    best = staged(best.withColumnRenamed("anchor", "uid"), "mining-best")

    blank = F.array_repeat(F.lit(np.iinfo(np.int64).min), positives)
    scores = F.slice(F.concat(F.transform("best", lambda x: -x["order"]), blank), 1, positives)
    asked = rows.where("anchor").join(best.select("uid", scores.alias("positives")), "uid")
    number = rows.where("anchor").groupBy("dim").agg(F.ceil(F.count("*") / block).alias("blocks"))
    blocks = staged(named(asked.join(number, "dim"), piece("blocks")).groupBy("name").applyInArrow(_pack, PACK), "mining-asked")
    found = _heaps(blocks, chunks.drop("home"), ["dim"], lambda a, b, rows, score: _inside(a, b, rows, score, negatives, positives, least_share), negatives, total, fan, "mining-negatives")

    of = rows.where("anchor").select("uid", F.col("vec_id").alias("anchor_id")).join(best, "uid").select("uid", "anchor_id", F.posexplode("best").alias("slot", "p"))
    of = of.select(F.col("uid").alias("anchor"), "slot", "anchor_id", F.when(~F.col("p.none"), F.col("p.id")).alias("positive_id"), (-F.col("p.order")).alias("positive_score"))
    heaps = found.groupBy("anchor", "slot").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("order"), "none", "id"))).alias("heap"))
    out = heaps.join(of, ["anchor", "slot"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("heap").alias("at", "n"))
    return out.select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.when(~F.col("n.none"), F.col("n.id")).alias("negative_id"), "positive_score", (-F.col("n.order")).alias("negative_score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label").cast("bigint"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT row_number() OVER () AS uid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.uid, a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.uid <> b.uid AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), p AS (
  SELECT uid, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY uid ORDER BY score DESC, id) AS slot FROM s WHERE same QUALIFY slot <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.uid, p.slot ORDER BY s.score DESC, s.id)::INT AS rank, s.id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.uid = p.uid AND NOT s.same AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
