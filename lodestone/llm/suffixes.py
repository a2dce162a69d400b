"""Passages that repeat across documents, by sparse suffix arrays.

Of every document's word suffixes only those at minimisers are kept: in each
run of WINDOW word k-grams the one with the least hash. Two copies of a passage
of LEAST words choose the same minimiser within its first WINDOW k-grams, and
share at least LEAST - WINDOW + 1 words from there on. So:

1. the kept suffixes are sorted by the hash of that many words, over the whole
   corpus, and compared with their neighbours; those unlike both drop out;
2. each suffix that is left is extended left and right to the passages of LEAST
   words that hang on it. They are sorted again, and those of equal key, which
   are neighbours, are compared: starts whose passages two different texts have
   become runs, and runs that touch become spans.

Nothing is paired inside a group, so a passage in a third of all documents
costs what its words cost. Hashes have 64 bits.
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

LEAST = 50
"""Words a repeated passage has at least."""
GRAM = 8
WINDOW = 32
ROWS = 4096
"""About so many suffixes are compared at a time."""
BASE = 0x9E3779B97F4A7C15
"""An odd multiplier."""


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in turn, offsets of each text). Words are split at ASCII white space."""
    import xxhash

    lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    flat = lists.flatten()
    coded = flat.dictionary_encode()
    of = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    index, offsets = np.asarray(coded.indices), offsets - offsets[0]
    # a leading or trailing white space leaves an empty word
    full = np.asarray(pc.not_equal(coded.dictionary, pa.scalar("", pa.large_string())))[index] if len(index) else np.zeros(0, bool)
    return of[index[full]] if len(index) else of, np.concatenate([[0], np.cumsum(full)])[offsets]


class Rolling:
    """Hashes of all runs of n words of one text, for any n."""

    powers = np.ones(1, np.uint64)
    inverses = np.ones(1, np.uint64)

    def __init__(self, words: np.ndarray):
        if len(words) >= len(Rolling.powers):
            n = 2 * len(words) + 1
            for name, b in (("powers", BASE), ("inverses", pow(BASE, -1, 1 << 64))):
                setattr(Rolling, name, np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, b, np.uint64)]), dtype=np.uint64))
        self.n = len(words)
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(words * Rolling.powers[: self.n], dtype=np.uint64)])

    def runs(self, n: int) -> np.ndarray:
        k = self.n - n + 1
        return mixed((self.sums[n:] - self.sums[:k]) * Rolling.inverses[:k]) if k > 0 else np.zeros(0, np.uint64)


def minimisers(grams: np.ndarray, window: int) -> np.ndarray:
    """For each run of `window` k-grams the place of its least one, the first of equals."""
    if len(grams) < window:
        return np.zeros(0, np.int64)
    out = np.empty(len(grams) - window + 1, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, window)
    for at in range(0, len(out), 8192):
        out[at : at + 8192] = view[at : at + 8192].argmin(axis=1)
    return out + np.arange(len(out))


def _suffixes(least: int, gram: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b, "text"):
                words, offsets = word_hashes(part.column("text"))
                keys, texts, places = [], [], []
                for c, s, e in zip(part.column("cls").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist()):
                    if e - s < least:
                        continue
                    r = Rolling(words[s:e])
                    # windows of k-grams that start a passage of `least` words
                    chosen = np.unique(minimisers(r.runs(gram), window)[: r.n - least + 1])
                    keys.append(r.runs(least - window + 1)[chosen])
                    texts.append(np.full(len(chosen), c, np.int64))
                    places.append(chosen)
                if keys:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(texts)), pa.array(np.concatenate(places).astype(np.int32))], names=["key", "cls", "place"])

    return run


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted suffixes those whose key is a neighbour's. `edge` rows settle what the partition's bounds leave open:
    a lone suffix at a bound, or, without a text, that a key at a bound is matched already."""
    names = ["key", "cls", "place", "edge"]

    def rows(k, c, p, edge) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(k, pa.int64()), pa.array(c, pa.int64()), pa.array(p, pa.int32()), pa.array(np.full(len(k), edge))], names=names)

    held = None  # the last row so far and whether it equals the one before
    first = True
    for b in batches:
        if not b.num_rows:
            continue
        k, c, p = (np.asarray(b.column(n)) for n in ("key", "cls", "place"))
        before = False
        if held is not None:
            k, c, p = (np.concatenate([[x], y]) for x, y in zip(held[:3], (k, c, p)))
            before = held[3]
        like = k[1:] == k[:-1]
        live = np.concatenate([[before], like])[:-1] | like
        if first and len(k) > 1:
            first = False
            yield rows(k[:1], [None] if like[0] else c[:1], [None] if like[0] else p[:1], True)
        if live.any():
            yield rows(k[:-1][live], c[:-1][live], p[:-1][live], False)
        held = (k[-1], c[-1], p[-1], bool(like[-1]) if len(like) else before)
    if held is not None:
        k, c, p, before = held
        if before:
            yield rows([k], [c], [p], False)
        yield rows([k], [None if before else c], [None if before else p], True)


def _anchored(least: int, gram: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each matched suffix of a text: its key, and for the starts of the passages that hang on it the hash of each,
        which is the suffix extended to the left and to the right as far as a passage reaches. Of a text with copies also a row without a key, with its last start."""
        for b in batches:
            for part in slices(b, "text", 1 << 20):
                words, offsets = word_hashes(part.column("text"))
                rows, keys, starts, counts, hashes = [], [], [], [], []
                for i, (live, copies) in enumerate(zip(part.column("places"), part.column("copies").to_pylist())):
                    r = Rolling(words[offsets[i] : offsets[i + 1]])
                    if copies > 1 and r.n >= least:
                        rows, keys, starts, counts = [*rows, [i]], [*keys, [0]], [*starts, [r.n - least]], [*counts, [-1]]
                    if not live.is_valid:
                        continue
                    place = minimisers(r.runs(gram), window)[: r.n - least + 1]
                    first = np.concatenate([[0], np.nonzero(np.diff(place))[0] + 1])  # the starts of an anchor are one run
                    n = np.diff(np.concatenate([first, [len(place)]]))
                    kept = np.isin(place[first], np.asarray(live.values))
                    rows.append(np.full(int(kept.sum()), i))
                    keys.append(r.runs(least - window + 1)[place[first[kept]]].view(np.int64))
                    starts.append(first[kept])
                    counts.append(n[kept])
                    hashes.append(r.runs(least)[np.repeat(kept, n)])
                if not rows:
                    continue
                rows, keys, starts, counts = (np.concatenate(x).astype(np.int64) for x in (rows, keys, starts, counts))
                whole = pa.array(counts < 0)
                ends = np.concatenate([[0], np.cumsum(8 * np.maximum(counts, 0))]).astype(np.int64)
                raw = np.concatenate([*hashes, np.zeros(0, np.uint64)])
                packed = pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(raw)]).cast(pa.binary())
                own = part.select(["cls", "low"]).take(pa.array(rows))
                yield pa.RecordBatch.from_arrays(
                    [pc.if_else(whole, None, pa.array(keys)), own.column("cls"), own.column("low"), pa.array(starts.astype(np.int32)), packed], names=["key", "cls", "low", "start", "passages"]
                )

    return run


# the kinds of rows that _matched gives out
RUN, BOUND_RUN, PART, SHARED, OPEN = range(5)


def _matched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of starts whose passages another text has too, from suffixes sorted by key and the smallest doc_id.

    Only suffixes of one key are compared, so those between the first and the
    last key of a partition are settled here (RUN). Keys at its bounds may go
    on in other partitions: their runs are given out with the hash of what
    passages they have (BOUND_RUN), those passages once for each such hash
    (PART) and once with their smallest doc_id (SHARED), and the passages of
    one text alone with their place (OPEN).
    """
    import xxhash

    def given(t: pa.Table, kind: int, row: np.ndarray, a: np.ndarray, b: np.ndarray, first: np.ndarray, passage: np.ndarray | None = None, parts: np.ndarray | None = None) -> pa.RecordBatch:
        take = lambda c, at: t.column(c).combine_chunks().take(pa.array(at))
        whole = lambda x: pa.nulls(len(row), pa.int64()) if x is None else pa.array(x)
        columns = [pa.array(np.full(len(row), kind, np.int32)), take("cls", row), pa.array(a), pa.array(b), take("low", first), whole(passage), whole(parts)]
        return pa.RecordBatch.from_arrays(columns, names=["kind", "cls", "a", "b", "first_doc", "passage", "parts"])

    def compared(t: pa.Table, bound: bool) -> Iterator[pa.RecordBatch]:
        n = np.asarray(pc.binary_length(t.column("passages").combine_chunks())).astype(np.int64) // 8
        h = np.frombuffer(b"".join(t.column("passages").to_pylist()), np.int64)
        row = np.repeat(np.arange(len(n)), n)
        at = (np.asarray(t.column("start"))[row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
        cls = np.asarray(t.column("cls"))[row]
        values, head, same = np.unique(h, return_index=True, return_inverse=True)
        shared = np.zeros(len(head), bool)
        shared[same[cls != cls[head][same]]] = True
        hit = np.nonzero(shared[same])[0]
        if len(hit):
            begin = np.nonzero(np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(row[hit]) > 0)]))[0]
            end = np.concatenate([begin[1:], [len(hit)]]) - 1
            # rows come by their smallest doc_id, so the first row with a passage has its smallest
            first = np.minimum.reduceat(row[head[same[hit]]], begin)
            x, y = hit[begin], hit[end]
            if not bound:
                yield given(t, RUN, row[x], at[x], at[y], first)
                return
            parts = np.array([xxhash.xxh3_64_intdigest(h[i : j + 1].tobytes()) for i, j in zip(x.tolist(), y.tolist())], np.uint64).view(np.int64)
            yield given(t, BOUND_RUN, row[x], at[x], at[y], first, None, parts)
            for k in np.unique(parts, return_index=True)[1].tolist():
                own = np.arange(x[k], y[k] + 1)
                yield given(t, PART, row[own], at[own], at[own], row[own], h[own], np.full(len(own), parts[k]))
            own = head[shared]
            yield given(t, SHARED, row[own], at[own], at[own], row[own], values[shared])
        alone = np.nonzero(~shared[same])[0] if bound else np.zeros(0, np.int64)
        if len(alone):
            yield given(t, OPEN, row[alone], at[alone], at[alone], row[alone], h[alone])

    def cut(t: pa.Table, bound: bool) -> Iterator[pa.RecordBatch]:
        """About ROWS suffixes at a time, of settled ones whole keys; what is at a bound is settled later, wherever it is cut."""
        k, at = np.asarray(t.column("key")), 0
        while at < len(k):
            to = min(len(k), at + ROWS)
            to = to if bound else int(np.searchsorted(k, k[to - 1], side="right"))
            yield from compared(t.slice(at, to - at), bound)
            at = to

    held: pa.Table | None = None  # the rows of the last key so far
    least = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]) if held is not None else t
        k = np.asarray(t.column("key"))
        least = k[0] if least is None else least
        some, many = np.searchsorted(k, least, side="right"), np.searchsorted(k, k[-1])
        yield from cut(t.slice(0, some), True)
        if some < many:
            yield from cut(t.slice(some, many - some), False)
        held = t.slice(max(some, many)) if max(some, many) < t.num_rows else None
    if held is not None:
        yield from cut(held, True)


def repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per maximal span of words that lies within repeated passages: doc_id, start_word, end_word (exclusive), n_words, first_doc.

    A passage of `least` words or more repeats if another document holds it
    too; repeats inside one document alone don't count. Equal texts are whole
    repeats of each other. first_doc is the smallest doc_id that holds one of
    the span's passages, or the whole text where the span is one. Documents
    without repeats, with null, empty or short texts give no row; repeated rows
    are documents of equal text. A null doc_id is a span's first only if all
    are null.
    """
    if least < window + gram - 1:
        raise ValueError("a window of k-grams must fit into a passage")
    kind = docs.schema[id_col].dataType.simpleString()
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull()).withColumn("cls", F.xxhash64("text"))
    found = df.select("cls", "text").mapInArrow(_suffixes(least, gram, window), "key bigint, cls bigint, place int")
    found = found.distinct()  # equal texts have equal suffixes
    order = found.repartitionByRange("key", "cls", "place").sortWithinPartitions("key", "cls", "place")
    near = staged(order.mapInArrow(_neighbours, "key bigint, cls bigint, place int, edge boolean"), "suffixes")
    open_ = near.where("edge").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    live = near.where("NOT edge").select("cls", "place").union(near.where("edge AND cls IS NOT NULL").join(open_, "key", "left_semi").select("cls", "place"))
    places = live.groupBy("cls").agg(F.collect_set("place").alias("places"))
    classes = df.groupBy("cls").agg(F.count("*").alias("copies"), F.min("doc_id").alias("low"))
    wanted = staged(classes.join(places, "cls", "left").where("places IS NOT NULL OR copies > 1").withColumnRenamed("cls", "of"), "suffix-texts")
    texts = df.join(wanted, (F.col("cls") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("low"))).select("cls", "low", "copies", "text", "places")
    anchored = staged(texts.mapInArrow(_anchored(least, gram, window), f"key bigint, cls bigint, low {kind}, start int, passages binary"), "suffix-anchors")
    order = ["key", F.col("low").asc_nulls_last(), "cls", "start"]
    sorted_ = anchored.where("key IS NOT NULL").repartitionByRange(*order).sortWithinPartitions(*order)
    matched = staged(sorted_.mapInArrow(_matched, f"kind int, cls bigint, a int, b int, first_doc {kind}, passage bigint, parts bigint"), "suffix-matches")
    passages = matched.where(F.col("kind").isin(SHARED, OPEN)).groupBy("passage").agg(F.min("cls").alias("x"), F.max("cls").alias("z"), F.min("kind").alias("kind"), F.min("first_doc").alias("first_doc"))
    passages = staged(passages.where((F.col("x") != F.col("z")) | (F.col("kind") == SHARED)).select("passage", "first_doc"), "suffix-passages")
    # a run's smallest doc_id is that of its passages; all texts of a hot passage have the same few
    firsts = matched.where(F.col("kind") == PART).select("parts", "passage").distinct().join(passages, "passage").groupBy("parts").agg(F.min("first_doc").alias("first_doc"))
    firsts = staged(firsts, "suffix-firsts")
    runs = matched.where(F.col("kind").isin(RUN, BOUND_RUN)).select("cls", "a", "b", "first_doc", "parts")
    runs = runs.unionByName(matched.where(F.col("kind") == OPEN).drop("first_doc").join(passages, "passage").select("cls", "a", "b", "first_doc", "parts"))
    runs = runs.unionByName(anchored.where("key IS NULL").select("cls", F.lit(0).alias("a"), F.col("start").alias("b"), F.col("low").alias("first_doc"), F.lit(None).cast("bigint").alias("parts")))
    by = W.partitionBy("cls").orderBy("a")
    reached = F.max("b").over(by.rowsBetween(W.unboundedPreceding, -1))
    runs = runs.withColumn("new", F.coalesce((F.col("a") > reached + least).cast("int"), F.lit(1)))
    runs = runs.withColumn("span", F.sum("new").over(by.rowsBetween(W.unboundedPreceding, 0)))
    spans = runs.groupBy("cls", "span").agg(F.min("a").alias("start_word"), (F.max("b") + least).alias("end_word"), F.min("first_doc").alias("first_doc"), F.array_sort(F.collect_set("parts")).alias("parts")).drop("span")
    spans = staged(spans.withColumn("all", F.when(F.size("parts") > 0, F.xxhash64("parts"))), "suffix-spans")
    # texts with the same passages have the same parts, so that these are few
    lists = spans.where("all IS NOT NULL").select("all", "parts").distinct().select("all", F.explode("parts").alias("parts"))
    lists = staged(lists.join(firsts, "parts").groupBy("all").agg(F.min("first_doc").alias("least")), "suffix-lists")
    spans = spans.join(lists, "all", "left").select("cls", "start_word", "end_word", F.least("first_doc", "least").alias("first_doc"))
    spans = staged(spans, "suffix-repeats")  # so that the rows of a text with many copies can be split in the join
    return df.select("doc_id", "cls").join(spans, "cls").select("doc_id", "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"), "first_doc")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, text, list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL
), c AS (
  SELECT text, count(*) AS copies, min(doc_id) AS low, any_value(ws) AS ws, row_number() OVER () AS cls FROM d GROUP BY text
), w AS (
  SELECT cls, low, copies, i AS start, md5(array_to_string(ws[i + 1:i + 50], ' ')) AS win FROM (SELECT *, unnest(range(0, len(ws) - 49)) AS i FROM c WHERE len(ws) >= 50)
), s AS (
  SELECT win, min(low) AS first_doc FROM w GROUP BY win HAVING min(cls) <> max(cls)
), h AS (
  SELECT cls, start, first_doc, CASE WHEN start <= lag(start) OVER v + 50 THEN 0 ELSE 1 END AS new FROM w JOIN s USING (win) WHERE copies = 1 WINDOW v AS (PARTITION BY cls ORDER BY start)
), g AS (
  SELECT *, sum(new) OVER (PARTITION BY cls ORDER BY start) AS span FROM h
), r AS (
  SELECT cls, min(start) AS start_word, max(start) + 50 AS end_word, min(first_doc) AS first_doc FROM g GROUP BY cls, span
  UNION ALL SELECT cls, 0, len(ws), least(low, f) FROM c LEFT JOIN (SELECT cls, min(first_doc) AS f FROM w JOIN s USING (win) GROUP BY cls) USING (cls) WHERE copies > 1 AND len(ws) >= 50
)
SELECT d.doc_id, start_word::INT AS start_word, end_word::INT AS end_word, (end_word - start_word)::INT AS n_words, first_doc FROM r JOIN c USING (cls) JOIN d ON d.text = c.text
"""
