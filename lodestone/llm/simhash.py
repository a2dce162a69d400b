"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints that differ in at most 4 of 64 bits agree on at least 3 of 7
blocks, so every link shares one of the 35 keys made of three blocks (27 bits
or more). Only distinct fingerprints are compared, copies are counted first,
and pairs are never expanded inside a dense group:

1. every key links its fingerprints to the commonest one among them, verified
   by Hamming distance, which settles dense groups with one row a member;
2. components are formed; keys whose fingerprints are all in one component
   have nothing left to say and drop out;
3. in the remaining keys pairs of different components are verified, in full;
   of these, members of a key's largest component are on one side only.

The components are then those of the complete link graph: a pair that is never
compared was already connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import slices, staged, table
from ._graph import components

DISTANCE = 4
SHINGLE = 4
BLOCKS = 7
SEED = 42


def hashes(text: bytes, shingle: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """The text's words, joined by spaces, and the XXH64 of their shingles; words are split at ASCII white space and A-Z lower-cased. Fewer words than a shingle has are one shingle."""
    import xxhash

    words = text.lower().split()  # on bytes: A-Z only, and space and \x09-\x0D only
    buf, of = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        found = [of(buf, SEED)] if words else []
    else:
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1) - 1
        found = [of(buf[a:b], SEED) for a, b in zip((end - size)[: 1 - shingle].tolist(), end[shingle - 1 :].tolist())]
    return buf, np.array(found, np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int((np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))[2 * ones > len(h)]).sum(dtype=np.uint64)) if len(h) else 0


def fingerprint(text: bytes) -> int:
    """Unsigned 64-bit SimHash of the text's word shingles."""
    return majority(hashes(text)[1])


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        of = [fingerprint(x or b"") for x in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.array(of, np.uint64).view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_batches, f"doc_id {kind}, fp bigint")


def cut(blocks: int) -> list[int]:
    """Masks of the blocks, as signed longs."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def keys(fp: Column, blocks: int = BLOCKS, distance: int = DISTANCE) -> Column:
    """An array with a key for each choice of blocks - distance blocks: its number and the bits of those blocks."""
    cuts = [round(i * 64 / blocks) for i in range(blocks + 1)]
    masks = []
    for chosen in combinations(range(blocks), blocks - distance):
        m = sum(((1 << (cuts[i + 1] - cuts[i])) - 1) << cuts[i] for i in chosen)
        masks.append(m - (1 << 64) if m >> 63 else m)
    return F.array(*[F.struct(F.lit(i).cast("tinyint").alias("k"), fp.bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)])


def hamming(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def met(a: DataFrame, b: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join by sorting. Spark takes exploded keys to be as small as their fingerprints, and a file's rows to be as small as the file, and would send either to every task by way of the driver."""
    return a.join(b.hint("merge"), on, how)


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """(fp, root) for every fingerprint linked with another one, from distinct (fp, n): root is the smallest fingerprint of its component."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.select("*", F.explode(keys(F.col("fp"), blocks, distance)).alias("key")).select("*", "key.k", "key.bits").drop("key")

    # any centre gives true links; the commonest settles most
    centre = keyed(distinct).groupBy("k", "bits").agg(F.max_by("fp", "n").alias("centre"), F.count("*").alias("members")).where("members > 1")
    shared = staged(met(keyed(distinct.select("fp")), centre.select("k", "bits", "centre"), ["k", "bits"]).select("k", "bits", "fp", "centre"), "simhash-keys")
    root = components(shared.where((F.col("fp") != F.col("centre")) & (hamming("fp", "centre") <= distance)).select("fp", "centre"), "fp", "centre")
    rooted = met(shared.select("k", "bits", "fp"), root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    rooted = staged(rooted, "simhash-rooted")
    # a key's largest component is never compared with itself, only what is outside of it with all
    largest = rooted.groupBy("k", "bits", "root").agg(F.count("*").alias("n")).groupBy("k", "bits").agg(F.max_by("root", "n").alias("largest"), F.count("*").alias("roots")).where("roots > 1")
    mixed = staged(met(rooted, largest.select("k", "bits", "largest"), ["k", "bits"]), "simhash-mixed")
    outside = mixed.where("root <> largest").select("k", "bits", F.col("fp").alias("fp2"), F.col("root").alias("root2"))
    rest = met(mixed, outside, ["k", "bits"]).where((F.col("root") != F.col("root2")) & (hamming("fp", "fp2") <= distance))
    # of the second round's links only what they join matters: components of the first round
    joined = components(rest.select("root", "root2"), "root", "root2").withColumnRenamed("root", "final")
    root = met(root, joined.withColumnRenamed("node", "root"), "root", "full_outer").select(F.coalesce("node", "root").alias("fp"), F.coalesce("final", "root").alias("root"))
    return root


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE, blocks: int = BLOCKS) -> DataFrame:
    """One row per document row: doc_id, fp (signed long), component_id, the smallest doc_id of the documents reachable by links.

    Null, empty and blank texts have fingerprint zero and link with one another
    like any other. Texts are used whole. Repeated rows and equal doc_ids stay
    as they are. A null doc_id is never a component's smallest unless all are null.
    """
    fps = staged(fingerprints(docs, id_col, text_col), "simhash")
    distinct = staged(fps.groupBy("fp").agg(F.count("*").alias("n"), F.min("doc_id").alias("low")), "simhash-distinct")
    # written, so that a large component's rows can be split in the join
    linked = staged(met(distinct.select("fp", "low"), links(distinct.select("fp", "n"), distance, blocks), "fp"), "simhash-roots")
    least = linked.groupBy("root").agg(F.min("low").alias("least"))
    least = staged(met(linked.select("fp", "root"), least, "root").select("fp", "least"), "simhash-least")
    of = staged(met(distinct.select("fp", "low"), least, "fp", "left").select("fp", F.coalesce("least", "low").alias("component_id")), "simhash-components")
    return met(fps, of, "fp").select("doc_id", "fp", "component_id")


# -- texts of a similarity, by fingerprints and bands

WORDS = 5
SIMILARITY = 0.8
FINGERPRINTS = 3
FAR = 44
"""Of the 192 bits of three fingerprints; texts of a similarity of 0.8 differ in about 29, with a deviation of 5."""
LEAST, APART = 240, 63
"""Least hashes of a set, and of how many two sets may differ, by four bits each: sets of a similarity of 0.8 differ in 45, with a deviation of 6, those of 0.7 in 68."""
TILE = 32
"""Nodes of a key that are met together, about so many."""
BANDS, ROWS = 20, 6
"""Texts of a similarity s share a band of ROWS least hashes with a chance of 1 - (1 - s^ROWS)^BANDS: 0.998 for 0.8, 0.02 for 0.3."""


def again(h: np.ndarray, turn: int) -> np.ndarray:
    """Other hashes of what h are hashes of; for turn 0 h itself."""
    if turn:
        h = h ^ np.uint64(0x9E3779B97F4A7C15 * turn % 2**64)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        h = h ^ (h >> np.uint64(31))
    return h


def least_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """The least of the hashes under each of n multipliers."""
    by = again(np.arange(1, n + 1, dtype=np.uint64), 1) | np.uint64(1)
    out = np.full(n, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 4096):
        np.minimum(out, (by[:, None] * h[at : at + 4096]).min(axis=1), out=out)
    return out


def banded(h: np.ndarray, bands: int, rows: int, n: int = LEAST) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of each band of the first of n least hashes, four bits of each of the n, sixteen of them a word)."""
    least = again(least_hashes(h, max(n, bands * rows)), 1)
    total = np.arange(bands, dtype=np.uint64)
    for i in range(rows):
        total = again(total * np.uint64(0x9E3779B97F4A7C15) + least[: bands * rows].reshape(bands, rows)[:, i], 1)
    few = np.zeros(-(-n // 16) * 16, np.uint64)
    few[:n] = least[:n] & np.uint64(15)
    return total, (few.reshape(-1, 16) << np.arange(0, 64, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, fingerprints: int = FINGERPRINTS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, node (a hash of the text's words in order), size (its different shingles), f0, f1, ...: SimHashes of its set of shingles by different hashes, hashes of the set's bands, and a few bits of each of its least hashes; a text without words has none of these."""
    kind = docs.schema[id_col].dataType.simpleString()
    names = [f"f{i}" for i in range(fingerprints)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in batches:
            found, of_bands, of_least = [], [], []
            for x in b.column("text").cast(pa.binary()).to_pylist():
                buf, h = hashes(x or b"", shingle)
                h = np.unique(h)
                found.append((xxhash.xxh64_intdigest(buf, SEED), len(h), *(majority(again(h, i)) for i in range(fingerprints))))
                keys_, least = banded(h, bands, rows) if len(h) else (np.zeros(0, np.uint64),) * 2
                of_bands.append(keys_.view(np.int64))
                of_least.append(least.view(np.int64))
            of = np.array(found, np.uint64).reshape(-1, 2 + fingerprints).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(of[:, i]) for i in range(2 + fingerprints)), *(pa.array(x, pa.list_(pa.int64())) for x in (of_bands, of_least))], names=["doc_id", "node", "size", *names, "bands", "least"])

    schema = ", ".join([f"doc_id {kind}", "node bigint", "size bigint", *(f"{x} bigint" for x in names), "bands array<bigint>", "least array<bigint>"])
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def _shingle_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(node, set) of a column of texts; set has the text's different shingles, as hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for b in slices(batch, "text"):
                of = [hashes(x or b"", shingle) for x in b.column("text").cast(pa.binary()).to_pylist()]
                nodes = np.array([xxhash.xxh64_intdigest(buf, SEED) for buf, _ in of], np.uint64).view(np.int64)
                sets = pa.array([np.unique(h).view(np.int64) for _, h in of], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), sets], names=["node", "set"])

    return texts.mapInArrow(run, "node bigint, set array<bigint>").groupBy("node").agg(F.any_value("set").alias("set"))


def similar(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY, fingerprints: int = FINGERPRINTS, far: int = FAR,
    distance: int = DISTANCE, blocks: int = BLOCKS, bands: int = BANDS, rows: int = ROWS, least_apart: int = APART,
) -> DataFrame:
    """One row per document row: doc_id, node (a hash of its words), component_id, the smallest doc_id of the documents reachable by links.

    Texts link if the Jaccard similarity of their sets of word shingles is
    `similarity` or more, as counted on the sets themselves. Close texts share
    a pigeonhole key of their SimHash. Most of a similarity of 0.8 don't, as
    their SimHashes differ in 10 bits, not 4; they meet in bands of least
    hashes. Of all that meet those are verified that differ in at most `far`
    bits of several SimHashes and in at most `least_apart` of the least hashes,
    three deviations and more beyond what texts of 0.8 do; the README has the
    share of pairs that is found.
    Equal word sequences are one node. Pairs are verified

    1. of each node the closest of its keys' centres,
    2. of each node and each tile of a key the closest of another component,
    3. of components that are still apart all pairs,

    so that dense groups are joined before they would be paired out. A key's
    nodes lie in tiles of about TILE; a row is a node with the tile it meets,
    and in round 3 with the sets of those in it that are close. Every close
    pair is still verified, but none is a row of a join or a shuffle.

    Null, empty and blank texts are one node, linked with no other; texts of
    fewer words than a shingle link with equal ones only. Repeated rows and equal
    doc_ids stay as they are. A null doc_id is never a component's smallest
    unless all are null. An empty table gives no rows.
    """
    names = [f"f{i}" for i in range(fingerprints)]
    fps = staged(wide_fingerprints(docs, id_col, text_col, shingle, fingerprints, bands, rows), "similar")
    nodes = staged(fps.groupBy("node").agg(F.min("doc_id").alias("low"), *(F.any_value(x).alias(x) for x in ("size", *names, "bands", "least"))), "similar-nodes")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def sets_of(asked: DataFrame) -> DataFrame:
        """(node, set) of the asked nodes, staged."""
        asked = asked.distinct().join(nodes.select("node", "low"), "node")
        # one document of a node will do; others of its doc_id do no harm
        return staged(_shingle_sets(texts.join(asked.select("low").distinct(), F.col("doc_id").eqNullSafe(F.col("low")), "left_semi").select("text"), shingle), "similar-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        """Of staged pairs (a, b, ...) those whose texts are similar."""
        sets = sets_of(pairs.select(F.explode(F.array("a", "b")).alias("node")))
        both = pairs.join(sets.toDF("a", "set_a"), "a").join(sets.toDF("b", "set_b"), "b").withColumn("common", F.size(F.array_intersect("set_a", "set_b")))
        return both.where(F.col("common") / (F.size("set_a") + F.size("set_b") - F.col("common")) >= similarity).drop("set_a", "set_b", "common")

    def marked(end: str, *more: str) -> DataFrame:
        return nodes.select(F.col("node").alias(end), F.struct("size", "least", *names, *more).alias(f"of_{end}"))

    # a four-bit place differs where any of its bits does
    spread = lambda x: x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseOR(F.shiftrightunsigned(x, 2)).bitwiseOR(F.shiftrightunsigned(x, 3)).bitwiseAND(F.lit(0x1111111111111111))

    def apart(a: Column, b: Column) -> Column:
        return sum((F.bit_count(a[x].bitwiseXOR(b[x])) for x in names), F.lit(0))

    def close(a: Column, b: Column) -> Column:
        words = [F.bit_count(spread(F.get(a["least"], i).bitwiseXOR(F.get(b["least"], i)))) for i in range(-(-LEAST // 16))]
        return (apart(a, b) <= far) & (sum(words[1:], words[0]) <= least_apart) & (F.least(a["size"], b["size"]) >= similarity * F.greatest(a["size"], b["size"]))

    # a key's last bits say whether it is a band, or the blocks it is made of
    low = blocks + 1
    chosen = F.array(*[F.lit(sum(1 << i for i in x)).cast("long") for x in combinations(range(blocks), blocks - distance)])
    of_blocks = F.transform(keys(F.col("f0"), blocks, distance), lambda x: F.shiftleft(F.xxhash64(x["k"], x["bits"]), low).bitwiseOR(F.element_at(chosen, x["k"].cast("int") + 1)))
    band = F.lit(1 << blocks).cast("long")
    of_bands = F.transform("bands", lambda x: F.shiftleft(x, low).bitwiseOR(band))
    nodes = nodes.withColumn("bands", of_bands)
    keyed = nodes.where("size > 0").select(F.explode(F.concat(of_blocks, "bands")).alias("key"), "node")
    # the greatest node, so that keys of one dense group mostly have the same centre
    centre = keyed.groupBy("key").agg(F.max("node").alias("centre"), F.count("*").alias("members")).where("members > 1")
    shared = staged(keyed.join(centre.select("key", "centre"), "key"), "similar-keys")

    met = shared.where("node <> centre").select(F.col("node").alias("a"), F.col("centre").alias("b")).distinct().join(marked("a"), "a").join(marked("b"), "b")
    ends = F.col("of_a"), F.col("of_b")
    closest = met.where(close(*ends)).groupBy("a").agg(F.min_by("b", F.struct(apart(*ends), "b")).alias("b"))
    root = staged(components(verified(staged(closest, "similar-closest")), "a", "b"), "similar-first")

    rooted = shared.select("key", "node").join(root, "node", "left").select("key", F.col("node"), F.coalesce("root", "node").alias("root"))
    rooted = staged(rooted, "similar-rooted")
    largest = rooted.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", "n").alias("largest"), F.count("*").alias("roots"), F.sum("n").alias("members")).where("roots > 1")
    tile = F.pmod(F.xxhash64("node"), F.ceil(F.col("members") / TILE)).cast("int").alias("tile")
    mixed = rooted.join(largest.select("key", "largest", "members"), "key").select("key", tile, "largest", "root", F.col("node").alias("a"))
    mixed = staged(mixed.join(marked("a", "bands"), "a"), "similar-mixed")

    own = F.col("key").bitwiseAND(F.lit((1 << blocks) - 1))
    upto = own
    for by in (1, 2, 4, 8, 16):
        upto = upto.bitwiseOR(F.shiftright(upto, by))

    def meets(a: Column, b: Column) -> Column:
        """A pair is met at the first of its keys alone: at blocks, where no equal block comes before the key's last one but the key's own, and else at the first band of both."""
        equal = sum((F.when(a["f0"].bitwiseXOR(b["f0"]).bitwiseAND(F.lit(m).cast("long")) == 0, 1 << i).otherwise(0) for i, m in enumerate(cut(blocks))), F.lit(0)).cast("long")
        at_band = (F.bit_count(equal) < blocks - distance) & (F.get(F.array_intersect(a["bands"], b["bands"]), 0) == F.col("key"))
        return F.when(F.col("key").bitwiseAND(band) == 0, equal.bitwiseAND(upto) == own).otherwise(at_band)

    def across(mixed: DataFrame) -> DataFrame:
        """(key, tile, b, of_b, root_b, others): nodes outside of their key's largest component with the close ones of other components in a tile, each pair once."""
        tiles = mixed.groupBy("key", "tile").agg(F.collect_list(F.struct("a", "root", (F.col("first") == F.col("largest")).alias("inner"), "of_a")).alias("all"))
        outside = mixed.where("first <> largest").select("key", F.col("a").alias("b"), F.col("of_a").alias("of_b"), F.col("root").alias("root_b"))
        wanted = lambda x: (x["root"] != F.col("root_b")) & (x["inner"] | (x["a"] < F.col("b"))) & close(x["of_a"], F.col("of_b")) & meets(x["of_a"], F.col("of_b"))
        return tiles.join(outside, "key").where(F.exists("all", wanted)).select("key", "tile", "b", "of_b", "root_b", F.filter("all", wanted).alias("others"))

    ends = F.struct(F.least("root", "root_b").alias("u"), F.greatest("root", "root_b").alias("v"))
    nearest = F.array_min(F.transform("others", lambda x: F.struct(apart(x["of_a"], F.col("of_b")).alias("apart"), x["a"].alias("a"), x["root"].alias("root"))))
    pairs = across(mixed.withColumn("first", F.col("root"))).select("b", "root_b", nearest.alias("x")).select("b", "root_b", "x.*")
    pairs = pairs.groupBy(ends.alias("ends")).agg(F.min_by(F.struct("a", "b"), F.struct("apart", "a", "b")).alias("pair"))
    second = staged(components(verified(staged(pairs.select("ends.u", "ends.v", "pair.a", "pair.b"), "similar-second")), "u", "v"), "similar-joined")

    rest = mixed.withColumnRenamed("root", "first").join(second.toDF("first", "root"), "first", "left").withColumn("root", F.coalesce("root", "first"))
    met = staged(across(rest).select("key", "tile", "b", "root_b", F.transform("others", lambda x: F.struct(x["a"].alias("a"), x["root"].alias("root"))).alias("others")), "similar-third")
    asked = staged(met.groupBy("key", "tile").agg(F.array_distinct(F.flatten(F.collect_list("others.a"))).alias("all")).select("key", "tile", F.explode("all").alias("node")), "similar-asked")
    sets = sets_of(asked.select("node").union(met.select("b")))
    of_tile = asked.join(sets, "node").groupBy("key", "tile").agg(F.map_from_entries(F.collect_list(F.struct("node", "set"))).alias("sets"))

    def counted(x: Column) -> Column:
        of_a = F.element_at("sets", x["a"])
        return F.struct(x["root"].alias("root"), F.size(of_a).alias("n"), F.size(F.array_intersect(of_a, F.col("set_b"))).alias("common"))

    both = met.join(sets.toDF("b", "set_b"), "b").join(of_tile, ["key", "tile"]).select("root_b", F.size("set_b").alias("n_b"), F.transform("others", counted).alias("others"))
    linked = F.filter("others", lambda x: x["common"] / (x["n"] + F.col("n_b") - x["common"]) >= similarity)
    third = both.select("root_b", F.explode(F.array_distinct(F.transform(linked, lambda x: x["root"]))).alias("root"))
    third = staged(components(third, "root", "root_b"), "similar-rest")

    final = nodes.select("node", "low").join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    for more in (second, third):
        final = final.join(more.toDF("root", "next"), "root", "left").select("node", "low", F.coalesce("next", "root").alias("root"))
    final = staged(final, "similar-roots")
    least = final.groupBy("root").agg(F.min("low").alias("component_id"))
    of = staged(final.select("node", "root").join(least, "root").select("node", "component_id"), "similar-components")
    return fps.join(of, "node").select("doc_id", "node", "component_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
