"""Alignment of two tokenizers' tokens by interval coalescing.

Tokens of both are intervals of bytes. All are sorted by start, ends run up to
their maximum, and a group breaks where a start reaches it; within a group the
overlapping pairs are the links.

Neither tokenizer looks across a break of text between a character that isn't
white space and a space or newline: the first splits there before it merges,
and the second has no piece with a space after something else or with a
newline (checked when it is loaded). So both take texts apart in units, each
distinct one once, and groups never span units.

A block is the documents of some megabytes of text. It is written with its
units, their links and, once a block, the distinct id pairs with the number of
its documents that have them. Pairs are summed over blocks, and each block gets
the sums of its own pairs back: what is shuffled is pairs by blocks, not by
documents or tokens, and no table of pairs goes to the driver.
"""

from __future__ import annotations

import hashlib
import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, staged, table
from ._tokenizer import BYTES, PRINTED, tokenizer_path

BYTE_BPE = "byte_bpe_50k.json"
PIECE_BPE = "piece_bpe_32k.model"
BLOCK = 1 << 22
"""Bytes of text of a block; a longer text is a block of its own."""
REMEMBERED = 60_000
"""A worker that knows more units after a block goes on with the commonest of it, of those that were in it more than once; a bound on memory only."""
SPACE = "\\t-\\r\\x1c- \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
UNEVEN = f"^[{SPACE}]|[{SPACE}][ \\n]"
"""Texts with white space in a row, or at their start, are split by BREAK."""
COMMA, BAR, SEMICOLON = (pa.scalar(x, pa.large_string()) for x in ",|;")
BREAK = re.compile(r"(?<=\S)(?=[ \n])")


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.LargeListArray:
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), values)


def _offsets(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def coalesced(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each A interval, group of each B interval), from 0 in turn; intervals that overlap, at once or by others, share a group."""
    start, end = np.concatenate([starts_a, starts_b]), np.concatenate([ends_a, ends_b])
    order = np.lexsort((np.arange(len(start)), start))
    reach = np.maximum.accumulate(end[order])
    broken = np.zeros(len(order), np.int64)
    broken[1:] = start[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(broken)
    return group[: len(starts_a)], group[len(starts_a) :]


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A, B) indices of the overlapping pairs of two rows of intervals, each in order and apart."""
    low = np.searchsorted(ends_b, starts_a, side="right")
    n = np.searchsorted(starts_b, ends_a, side="left") - low
    a = np.repeat(np.arange(len(starts_a)), n)
    return a, np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


class Known:
    """What is known of units, by number: tokens of A and of B, groups and links (all 0 where bytes differ), groups as text, id pairs of the links."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.numbers = np.zeros((0, 4), np.int64)
        self.right = np.zeros(0, bool)
        self.text: list[bytes] = []
        self.pairs = np.zeros(0, np.int64)
        self.bounds = np.zeros(1, np.int64)

    def add(self, units: list[str], numbers: np.ndarray, right: np.ndarray, text: list[bytes], pairs: np.ndarray) -> None:
        self.at.update(zip(units, range(len(self.at), len(self.at) + len(units))))
        self.numbers = np.concatenate([self.numbers, numbers])
        self.right = np.concatenate([self.right, right])
        self.text += text
        self.pairs = np.concatenate([self.pairs, pairs])
        self.bounds = _offsets(self.numbers[:, 3])

    def kept(self, units: np.ndarray) -> Known:
        """Only the units of these numbers."""
        names = list(self.at)
        out = Known()
        take, _ = _taken(self.bounds, units)
        out.add([names[i] for i in units.tolist()], self.numbers[units], self.right[units], [self.text[i] for i in units.tolist()], self.pairs[take])
        return out


def _taken(bounds: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the rows' entries, number of entries of each row)."""
    n = bounds[rows + 1] - bounds[rows]
    return np.arange(int(n.sum())) + np.repeat(bounds[rows] - (np.cumsum(n) - n), n), n


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


class Pair:
    """Both tokenizers and what is known of units."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        shown = {chr(x): x for x in PRINTED} | {chr(n): x for x, n in BYTES.items()}
        names = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size(with_added_tokens=True))]
        self.a_bytes = [bytes(shown[c] for c in x) if all(c in shown for c in x) else x.encode() for x in names]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
        self.a_size, self.b_size = (np.array([len(x) for x in t], np.int64) for t in (self.a_bytes, self.b_bytes))
        whole = [x for i, x in enumerate(pieces) if not self.b.is_byte(i)]
        self.splits = not any("\n" in x or re.search("[^▁]▁", x) for x in whole) and [self.b_bytes[i] for i in self.b.encode("\n")] == [b" ", b"\n"]
        self.known = Known()

    def units(self, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(distinct units, units of all texts in turn by index, offsets of each text). A unit has its leading space; null and empty texts have none."""
        # copied, as kernels on lists misread a slice's offset
        texts = pa.concat_arrays([texts.cast(pa.large_string()), pa.array([], pa.large_string())])
        some = pc.fill_null(pc.greater(pc.binary_length(texts), 0), False)
        even = pc.and_(some, pc.invert(pc.fill_null(pc.match_substring_regex(texts, UNEVEN), False))) if self.splits else pc.and_(some, False)
        words = pc.split_pattern(pc.replace_substring(pc.if_else(even, texts, pa.scalar(None, pa.large_string())), "\n", " \n"), " ")
        coded = words.flatten().dictionary_encode()
        names = [x if x[:1] == "\n" else " " + x for x in coded.dictionary.to_pylist()]
        index = np.asarray(coded.indices, np.int32)
        counts = np.asarray(pc.fill_null(pc.list_value_length(words), 0), np.int64)
        odd = np.flatnonzero(np.asarray(pc.and_(some, pc.invert(even))))
        if len(odd):
            at = {x: i for i, x in enumerate(names)}
            parts = np.split(index, np.cumsum(counts)[:-1])
            for i in odd.tolist():
                whole = " " + texts[i].as_py()
                parts[i] = np.array([at.setdefault(x, len(at)) for x in (BREAK.split(whole) if self.splits else [whole])], np.int32)
                counts[i] = len(parts[i])
            names, index = list(at), np.concatenate(parts)
        return names, index, _offsets(counts)

    def encoded(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        a = [x.ids for x in self.a.encode_batch_fast(units, add_special_tokens=False)]
        if not self.splits:
            return a, self.b.encode([x[1:] for x in units], num_threads=1)
        return a, [x[2:] for x in self.b.encode(["\n" + x for x in units], num_threads=1)]

    def each(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """(ids of A, tokens a unit, ids of B, tokens a unit, which units both spell byte for byte); the others have no tokens."""
        a, b = self.encoded(units)
        right = [b"".join(map(self.a_bytes.__getitem__, x)) == u == b"".join(map(self.b_bytes.__getitem__, y)) for x, y, u in zip(a, b, (u.encode() for u in units))]
        a, b = ([x if r else [] for x, r in zip(xs, right)] for xs in (a, b))
        return *_flat(a), *_flat(b), np.array(right, bool)

    def joined(self, units: list[str]) -> tuple[np.ndarray, ...]:
        """each() of units that don't end with white space: many are encoded as one text, which splits where they meet, and told apart by bytes. Where bytes differ, halves are tried until few are left."""
        if len(units) <= 64:
            return self.each(units)
        raw = [u.encode() for u in units]
        ends, whole = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw))), b"".join(raw)
        texts = lambda n: ["".join(units[i : i + n]) for i in range(0, len(units), n)]
        ids_a = _flat([x.ids for x in self.a.encode_batch_fast(texts(200), add_special_tokens=False)])[0]
        ids_b = _flat([x[2:] for x in self.b.encode(["\n" + x for x in texts(10)], num_threads=1)])[0]
        found = []
        for ids, table, sizes in ((ids_a, self.a_bytes, self.a_size), (ids_b, self.b_bytes, self.b_size)):
            stops = np.cumsum(sizes[ids])
            last = np.searchsorted(stops, ends)
            if len(stops) == 0 or last[-1] >= len(stops) or (stops[last] != ends).any() or b"".join(map(table.__getitem__, ids.tolist())) != whole:
                half = len(units) // 2
                return tuple(np.concatenate(x) for x in zip(self.joined(units[:half]), self.joined(units[half:])))
            found += [ids, np.diff(last, prepend=-1)]
        return *found, np.ones(len(units), bool)

    def learn(self, units: list[str]) -> None:
        ids_a, na, ids_b, nb, right = self.joined(units) if self.splits and not units[0][-1].isspace() else self.each(units)
        numbers = np.zeros((len(units), 4), np.int64)
        if not len(ids_a):
            self.known.add(units, numbers, right, [b""] * len(units), np.zeros(0, np.int64))
            return
        ends_a, ends_b = np.cumsum(self.a_size[ids_a]), np.cumsum(self.b_size[ids_b])
        starts_a, starts_b = ends_a - self.a_size[ids_a], ends_b - self.b_size[ids_b]
        group_a, group_b = coalesced(starts_a, ends_a, starts_b, ends_b)
        unit_a = np.repeat(np.arange(len(units)), na)
        link_a, link_b = overlaps(starts_a, ends_a, starts_b, ends_b)
        groups = int(group_a[-1]) + 1
        # both tokenizers end with each unit, so a group is of one unit
        per_unit = np.bincount(unit_a[np.flatnonzero(np.diff(group_a, prepend=-1))], minlength=len(units))
        text = [pc.binary_join(_lists(_offsets(np.bincount(g, minlength=groups)), pa.array(ids).cast(pa.large_string())), COMMA) for ids, g in ((ids_a, group_a), (ids_b, group_b))]
        text = pc.binary_join(_lists(_offsets(per_unit), pc.binary_join_element_wise(*text, BAR)), SEMICOLON).cast(pa.large_binary()).to_pylist()
        numbers[:] = np.stack([na, nb, per_unit, np.bincount(unit_a[link_a], minlength=len(units))], axis=1)
        self.known.add(units, numbers, right, text, ids_a[link_a] << 32 | ids_b[link_b])

    def numbered(self, units: list[str]) -> np.ndarray:
        """The units' numbers in `known`; new ones are learned."""
        at = self.known.at
        fresh = [u for u in units if u not in at]
        for part in ([u for u in fresh if not u[-1].isspace()], [u for u in fresh if u[-1].isspace()]):
            for i in range(0, len(part), 20_000):
                self.learn(part[i : i + 20_000])
        return np.fromiter(map(at.__getitem__, units), np.int64, len(units))

    def forget(self, units: np.ndarray, often: np.ndarray) -> None:
        """After a block of these units, `often` times each."""
        if len(self.known.at) > REMEMBERED:
            order = np.argsort(-often, kind="stable")[:REMEMBERED]
            self.known = self.known.kept(units[order[often[order] > 1]])


@lru_cache(maxsize=2)
def pair(a_path: str, b_path: str) -> Pair:
    """One a worker."""
    return Pair(a_path, b_path)


DOC = "doc_id {ident}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string"
BLOCKS = "block string, docs array<struct<{doc}>>, words binary, offsets binary, links binary, bounds binary, pairs array<bigint>, counts array<int>"


def _block(of: Pair, doc_id: pa.Array, texts: pa.Array) -> pa.RecordBatch:
    """The documents as one row: what is told of each, its units by index, the units' links by index of the pair, and the block's pairs in order with the numbers of its documents that have them."""
    names, index, offsets = of.units(texts)
    units, known = of.numbered(names), of.known
    wrong = ~known.right[units]
    if wrong.any():
        bad = _sums(wrong[index], offsets) > 0
        counts = np.diff(offsets)
        index, offsets = index[np.repeat(~bad, counts)], _offsets(np.where(bad, 0, counts))
    numbers = known.numbers[units]
    bounds = _offsets(numbers[:, 3])
    pairs, links = np.unique(known.pairs[_taken(known.bounds, units)[0]], return_inverse=True)
    links = links.astype(np.int32)
    counts, slot, place = (np.zeros(n, np.int32) for n in (len(pairs), len(pairs), len(names)))
    text = [known.text[i] for i in units.tolist()]
    digests = []
    for i, j in zip(offsets.tolist(), offsets[1:].tolist()):
        if i == j:
            digests.append("")
            continue
        words = index[i:j]
        digests.append(hashlib.sha256(b";".join([text[k] for k in words.tolist()])).hexdigest())
        # each once: of the places that name the same entry only the last written is found again
        turn = np.arange(j - i, dtype=np.int32)
        place[words] = turn
        words = words[place[words] == turn]
        p = links[_taken(bounds, words)[0]]
        turn = np.arange(len(p), dtype=np.int32)
        slot[p] = turn
        counts[p[slot[p] == turn]] += 1
    of.forget(units, np.bincount(index, minlength=len(names)))
    of_doc = [_sums(numbers[index, k], offsets) for k in range(4)]
    used = counts > 0
    # pairs of units that only documents of unequal bytes have are left out
    renamed = np.cumsum(used) - 1
    links = np.where(used[links], renamed[links], -1).astype(np.int32)
    docs = pa.StructArray.from_arrays([doc_id, *(pa.array(x) for x in of_doc), pa.array(digests, pa.string())], names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
    one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
    blobs = [pa.array([x.tobytes()], pa.binary()) for x in (index.astype(np.int32), offsets, links, bounds)]
    return pa.RecordBatch.from_arrays(
        [pa.array([uuid.uuid4().hex]), one(docs), *blobs, one(pa.array(pairs[used])), one(pa.array(counts[used]))], names=["block", "docs", "words", "offsets", "links", "bounds", "pairs", "counts"]
    )


def _blocks(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pair(a_path, b_path)
        for batch in batches:
            for b in slices(batch, "text", BLOCK):
                yield _block(of, b.column("doc_id"), b.column("text"))
                pa.default_memory_pool().release_unused()

    return run


def _scored(key: tuple, sums: pa.Table, block: pa.Table) -> pa.Table:
    """A block's documents with the sums of its pairs."""
    sums = sums.sort_by("pair")
    row = {c: np.frombuffer(block.column(c)[0].as_py(), t) for c, t in (("words", np.int32), ("offsets", np.int64), ("links", np.int32), ("bounds", np.int64))}
    n, best = (np.append(np.asarray(sums.column(c), np.int64), 0) for c in ("n", "best"))
    of_unit = [_sums(x[row["links"]], row["bounds"]) for x in (n, best)]
    total, most = (_sums(x[row["words"]], row["offsets"]) if len(x) else np.zeros(len(row["offsets"]) - 1, np.int64) for x in of_unit)
    docs = block.column("docs").combine_chunks().flatten()
    return pa.Table.from_arrays([*docs.flatten(), pa.array(most), pa.array(total)], names=[*(f.name for f in docs.type), "n_best", "count_sum"])


def blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """The written blocks of documents, for pair_counts() and aligned()."""
    doc = DOC.format(ident=docs.schema[id_col].dataType.simpleString())
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = BLOCKS.format(doc=re.sub(r"(\w+) (\S+?)(,|$)", r"\1: \2\3", doc))
    made = rows.mapInArrow(_blocks(a_path or tokenizer_path(BYTE_BPE), b_path or tokenizer_path(PIECE_BPE)), kind)
    # a row has some megabytes, and a row group is read as a whole
    return staged(made, "alignment-blocks", **{"parquet.block.row.count.limit": "1"})


def pair_counts(written: DataFrame) -> DataFrame:
    """pair, n, best: each id pair (A's id times 2^32 plus B's) that some document has linked, the number of those documents, and whether that is the highest of its A id."""
    each = written.select(F.explode(F.arrays_zip("pairs", "counts")).alias("x"))
    counts = staged(each.groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.counts").alias("n")), "pair-counts")
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    return staged(counts.withColumn("a", a).join(top, "a").select("pair", "n", (F.col("n") == F.col("top")).cast("int").alias("best")), "pair-best")


def aligned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """One row per document row: doc_id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum.

    A takes a space and the text, B the text, to which it adds a space itself.
    Null and empty texts, and those that A's or B's tokens don't spell byte for
    byte, have no tokens: zeros, and '' as the digest. Equal rows count as
    documents of their own. An empty table gives no rows. Other columns play
    no part. groups() has the groups themselves, pair_counts() the counts.
    """
    written = blocks(docs, id_col, text_col, a_path, b_path)
    counts = pair_counts(written)
    asked = written.select("block", F.explode("pairs").alias("pair"))
    sums = asked.join(counts, "pair").select("block", "pair", "n", "best")
    doc = DOC.format(ident=docs.schema[id_col].dataType.simpleString())
    rows = written.select(F.col("block").alias("of"), "docs", "words", "offsets", "links", "bounds")
    return sums.groupBy("block").cogroup(rows.groupBy("of")).applyInArrow(_scored, f"{doc}, n_best bigint, count_sum bigint")


def _groups(a_path: str, b_path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = pair(a_path, b_path)
        for batch in batches:
            for b in slices(batch, "text", 1 << 20):
                names, index, offsets = of.units(b.column("text"))
                units, known = of.numbered(names), of.known
                found = []
                for i, j in zip(offsets.tolist(), offsets[1:].tolist()):
                    own = units[index[i:j]]
                    text = b";".join([known.text[k] for k in own.tolist()]).decode() if known.right[own].all() else ""
                    found.append([dict(zip(("a_ids", "b_ids"), ([int(x) for x in side.split(",")] for side in g.split("|")))) for g in text.split(";") if g])
                of.forget(units, np.bincount(index, minlength=len(names)))
                kind = pa.list_(pa.struct([("a_ids", pa.list_(pa.int32())), ("b_ids", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found, kind)], names=["doc_id", "groups"])

    return run


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id and the groups of A's and B's token ids of each document row, in order; none where aligned() has zeros."""
    ident = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_groups(a_path or tokenizer_path(BYTE_BPE), b_path or tokenizer_path(PIECE_BPE)), f"doc_id {ident}, groups array<struct<a_ids: array<int>, b_ids: array<int>>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
