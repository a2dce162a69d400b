"""Benchmark decontamination by winnowing.

A window is WINDOW consecutive words of an item, or a shorter item as a whole.
Of the k-gram hashes of a text the least of each w in a row is a fingerprint;
with k + w - 1 = WINDOW any span of WINDOW words that two texts share has a
fingerprint in common, so none is missed. Fingerprints of documents are joined
with those of the items, and each hit is extended left and right to the windows
that cover it, which must be windows of an item. Shorter items have a winnowing
of their own length, so that the guarantee holds for them too.

A bitmap of at most FILTER_BITS bits of the items' fingerprints goes to the
tasks and drops most document fingerprints before the shuffle; the join after
it is exact, so a crowded bitmap costs time only. Windows and grams are known
by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import slices, staged, table

WINDOW = 10
GRAM = 5
FILTER_BITS = 1 << 26
"""The bitmap has 16 bits a fingerprint of the items, a power of two of them, and no more than so many."""
PART = 1 << 20
"""Bytes of text, or words, that are hashed at a time."""
BASE = np.uint64(0x9E3779B97F4A7C15)
"""An odd multiplier; hashes are sums of powers of it."""


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n - 1, 0), base, np.uint64))])[:n]


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
UP, DOWN = _powers(BASE, 4 * PART), _powers(INVERSE, 4 * PART)
_byte = np.arange(256)
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte)
IS_WORD = ((LOWER >= 48) & (LOWER <= 57)) | ((LOWER >= 97) & (LOWER <= 122)) | (_byte >= 128)
CODE = _mixed((LOWER + 1).astype(np.uint64) * BASE)


def _cut(data: np.ndarray, at: int) -> int:
    """The first place from `at` on that is not inside a word."""
    while at < len(data):
        out = np.flatnonzero(~IS_WORD[data[at : at + 4096]])
        if len(out):
            return at + int(out[0])
        at += 4096
    return len(data)


def _hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, number of words before each bound). data: bytes of texts in turn, bounds: where each starts, and the end."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    word = IS_WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = bounds[(bounds > 0) & (bounds < len(data))]
    first[inner] = word[inner]
    last[inner - 1] = word[inner - 1]
    a, b = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = (UP, DOWN) if len(data) < len(UP) else (_powers(BASE, len(data) + 1), _powers(INVERSE, len(data) + 1))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(CODE[data] * up[: len(data)])])
    return _mixed((total[b] - total[a]) * down[a]), np.searchsorted(a, bounds)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts, offsets of each text). Null texts have no words; long texts are hashed in parts that end between words."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[0] == bounds[-1]:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    if len(data) <= 2 * PART or len(texts) > 1:
        return _hashes(data, bounds)
    parts, at = [], 0
    while at < len(data):
        to = _cut(data, min(len(data), at + PART))
        parts.append(_hashes(data[at:to], np.array([0, to - at]))[0])
        at = to
    h = np.concatenate(parts)
    return h, np.array([0, len(h)])


def _gram(h: np.ndarray, at: np.ndarray | slice, k: int, length: int) -> np.ndarray:
    """Hash of the k words from each place; length keeps windows of different lengths apart."""
    total = np.full(len(h[at]), length, np.uint64)
    for j in range(k):
        where = slice(at.start + j, at.stop + j) if isinstance(at, slice) else at + j
        total = total * BASE + h[where]
    return _mixed(total)


def fingerprints(h: np.ndarray, doc: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the fingerprints of texts: of the k-grams in each `length` words those of the least hash. doc: the text of each word."""
    k = min(gram, length)
    w = length - k + 1
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    g = _gram(h, slice(0, len(h) - k + 1), k, length)
    least = g[:n].copy()
    for j in range(1, w):
        np.minimum(least, g[j : n + j], out=least)
    least[doc[:n] != doc[length - 1 :]] = 0
    chosen = np.zeros(len(g), np.uint64)
    for j in range(w):
        np.maximum(chosen[j : n + j], least, out=chosen[j : n + j])
    at = np.flatnonzero(chosen == g)
    return at, g[at]


def _covering(h: np.ndarray, doc: np.ndarray, at: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(index of the hit, start, hash) of the windows that cover each hit: it extended left and right."""
    w = length - min(gram, length) + 1
    start = (at[:, None] - np.arange(w)).ravel()
    of = np.repeat(np.arange(len(at)), w)
    inside = (start >= 0) & (start + length <= len(h))
    start, of = start[inside], of[inside]
    one = doc[start] == doc[start + length - 1]
    start, of = start[one], of[one]
    return of, start, _gram(h, start, length, length + 64)


SPAN = pa.struct([("window", pa.int64()), ("start", pa.int64())])
HIT = pa.struct([("gram", pa.int64()), ("len", pa.int32()), ("spans", pa.list_(SPAN))])


def _lists(counts: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), values)


def _hits(h: np.ndarray, offsets: np.ndarray, classes: list[int], gram: int, bits: np.ndarray) -> pa.Array:
    """Of each text its fingerprints that the bitmap has, one entry a distinct gram, with the windows that cover them."""
    shift = np.uint64(65 - (8 * len(bits)).bit_length())
    found = []
    for length in classes:
        # a long text in parts that share length - 1 words, so that each window is inside of one
        for begin in range(0, max(1, len(h) - length + 1), PART):
            part = slice(begin, min(len(h), begin + PART + length - 1))
            doc = np.searchsorted(offsets, np.arange(part.start, part.stop), side="right") - 1
            at, g = fingerprints(h[part], doc, length, gram)
            slot = (g >> shift).astype(np.int64)
            there = (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1
            at, g = at[there], g[there]
            of, start, window = _covering(h[part], doc, at, length, gram)
            found.append((doc[start].astype(np.int64), g[of].view(np.int64), np.full(len(of), length), window.view(np.int64), start + begin - offsets[doc[start]]))
    doc, g, length, window, start = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((start, window, length, g, doc))
    doc, g, length, window, start = (x[order] for x in (doc, g, length, window, start))
    rows = np.stack([doc, g, length, window, start])
    new = np.ones(len(doc), bool)
    new[1:] = (rows[:, 1:] != rows[:, :-1]).any(axis=0)
    doc, g, length, window, start = rows[:, new]
    head = np.ones(len(doc), bool)
    head[1:] = (doc[1:] != doc[:-1]) | (g[1:] != g[:-1]) | (length[1:] != length[:-1])
    heads = np.flatnonzero(head)
    spans = _lists(np.diff(np.append(heads, len(doc))), pa.StructArray.from_arrays([pa.array(window), pa.array(start)], fields=list(SPAN)))
    hits = pa.StructArray.from_arrays([pa.array(g[heads]), pa.array(length[heads], pa.int32()), spans], fields=list(HIT))
    return _lists(np.bincount(doc[heads], minlength=len(offsets) - 1), hits)


def _of_items(longest: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows and fingerprints of items."""
        for batch in batches:
            for b in slices(batch, "text", PART):
                h, offsets = word_hashes(b.column("text"))
                lengths, windows, grams = [], [], []
                for a, z in zip(offsets.tolist(), offsets[1:].tolist()):
                    one = h[a:z]
                    length = min(longest, len(one))
                    lengths.append(length)
                    if not length:
                        windows.append([])
                        grams.append([])
                        continue
                    starts = np.arange(len(one) - length + 1)
                    windows.append(np.unique(_gram(one, starts, length, length + 64).view(np.int64)))
                    grams.append(np.unique(fingerprints(one, np.zeros(len(one), np.int64), length, gram)[1].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [b.column("item_id"), pa.array(lengths, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (windows, grams))], names=["item_id", "len", "windows", "grams"]
                )

    return run


def _of_documents(classes: list[int], gram: int, bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of documents and those of their fingerprints that items may have."""
        for batch in batches:
            for b in slices(batch, "text", PART):
                h, offsets = word_hashes(b.column("text"))
                hits = _hits(h, offsets, classes, gram, bits.value) if classes else pa.array([[]] * b.num_rows, pa.list_(HIT))
                yield pa.RecordBatch.from_arrays([b.column("uid"), b.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), hits], names=["uid", "doc_id", "n_words", "hits"])

    return run


def bitmap(grams: DataFrame, most: int = FILTER_BITS) -> np.ndarray:
    """Bits of the leading digits of the column `gram`, made in tasks; at most `most` bits come to the driver."""
    n = grams.count()
    size = min(most, max(1024, 1 << (16 * n - 1).bit_length() if n else 0))
    slot = F.shiftrightunsigned("gram", 65 - size.bit_length())
    bit = F.expr("shiftleft(1L, cast(slot % 64 AS int))")
    cells = grams.select(slot.alias("slot")).groupBy((F.col("slot") / 64).cast("int").alias("cell")).agg(F.bit_or(bit).alias("bits")).toArrow()
    bits = np.zeros(size // 64, np.int64)
    bits[np.asarray(cells.column("cell"))] = np.asarray(cells.column("bits"))
    return bits.view(np.uint8)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, gram: int = GRAM
) -> DataFrame:
    """One row per document row: doc_id, n_words, spans, item_ids.

    Words are runs of digits, Latin letters in lower case and all characters
    beyond ASCII. spans: runs of words (start, end exclusive, in order, apart)
    that lie in occurrences of windows of items. item_ids: the ids as strings,
    in order, each once, of the items of which a window occurs; a null id
    is the empty string. Null and empty texts have no words; items without
    words are in nothing. Repeated documents are rows of their own. Either
    table may be empty. Other columns play no part.
    """
    spark = docs.sparkSession
    ident = docs.schema[id_col].dataType.simpleString()
    named = items.select(F.coalesce(F.col(item_id_col).cast("string"), F.lit("")).alias("item_id"), F.col(item_text_col).alias("text"))
    tests = staged(named.mapInArrow(_of_items(window, gram), "item_id string, len int, windows array<bigint>, grams array<bigint>").where("len > 0"), "items")
    classes = sorted(r[0] for r in tests.select("len").distinct().collect())
    grams = staged(tests.select("len", F.explode("grams").alias("gram")).distinct(), "item-grams")
    windows = staged(tests.select(F.explode("windows").alias("window"), "item_id").distinct(), "item-windows")
    bits = spark.sparkContext.broadcast(bitmap(grams))
    rows = docs.select(F.monotonically_increasing_id().alias("uid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = "array<struct<gram: bigint, len: int, spans: array<struct<window: bigint, start: bigint>>>>"
    read = staged(rows.mapInArrow(_of_documents(classes, gram, bits), f"uid bigint, doc_id {ident}, n_words bigint, hits {kind}"), "document-hits")

    hits = read.where(F.size("hits") > 0).select("uid", F.explode("hits").alias("h")).select("uid", "h.*")
    extended = hits.join(grams, ["len", "gram"], "left_semi").select("uid", "len", F.explode("spans").alias("s")).select("uid", "len", "s.*")
    found = staged(extended.join(windows.select("window").distinct(), "window", "left_semi").distinct(), "document-windows")

    before = W.partitionBy("uid").orderBy("start").rowsBetween(W.unboundedPreceding, -1)
    end = F.col("start") + F.col("len")
    edges = found.select("uid", "start", end.alias("end")).withColumn("new", F.coalesce(F.col("start") > F.max("end").over(before), F.lit(True)).cast("int"))
    runs = edges.withColumn("run", F.sum("new").over(W.partitionBy("uid").orderBy("start").rowsBetween(W.unboundedPreceding, 0)))
    runs = runs.groupBy("uid", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = runs.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    # documents with the same set of windows have the same items, which are gathered once a set
    sets = found.groupBy("uid").agg(F.sort_array(F.collect_set("window")).alias("windows")).withColumn("set", F.md5(F.array_join(F.col("windows").cast("array<string>"), ",")))
    sets = staged(sets, "window-sets")
    each = sets.groupBy("set").agg(F.any_value("windows").alias("windows")).select("set", F.explode("windows").alias("window"))
    members = each.join(windows, "window").groupBy("set").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"))
    of = spans.join(sets.select("uid", "set").join(members, "set"), "uid").drop("set")
    none = "CAST(array() AS array<struct<start: bigint, end: bigint>>)"
    return read.select("uid", "doc_id", "n_words").join(of, "uid", "left").select(
        "doc_id", "n_words", F.coalesce("spans", F.expr(none)).alias("spans"), F.coalesce("item_ids", F.expr("CAST(array() AS array<string>)")).alias("item_ids")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("bigint").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated")
    )


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS uid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), i AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s : s + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) AS s FROM i WHERE len(w) > 0)
), dw AS (
  SELECT uid, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
  FROM (SELECT uid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hit AS (
  SELECT dw.uid, dw.n, dw.s, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n
), words AS (
  SELECT uid, count(DISTINCT p) AS n_hit FROM (SELECT uid, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY uid
), items AS (
  SELECT uid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT uid, item_id FROM hit) GROUP BY uid
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (uid) LEFT JOIN items USING (uid)
"""
