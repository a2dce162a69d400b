"""BPE encoding and decoding of whole texts, long ones in parallel by tree concatenation.

Texts up to LEAF code points are encoded where they are read. Longer ones are
cut into leaves of LEAF code points, wherever the cuts fall, and the leaves are
dealt out over the cluster. A leaf's words are final except the
fragments before its first and after its last white space; fragments that meet
at a cut are joined, pairwise in a tree, by encoding windows around each join
that grow until both sides agree (`Words.join`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import slices, table
from ._tokenizer import Piece, Words, tokenizer_path, words

LEAF = 32768
OUT = "doc_id {id}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def _digests(ids: np.ndarray, offsets: np.ndarray, decoded: pa.Array) -> tuple[list[str], list[str]]:
    raw = memoryview(ids.astype("<u4").tobytes())
    a = [hashlib.sha256(raw[4 * s : 4 * e]).hexdigest() for s, e in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
    return a, [hashlib.sha256(x).hexdigest() for x in decoded.cast(pa.large_binary()).to_pylist()]


def _short(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(path)
        for b in batches:
            for part in slices(b, "text"):
                ids, offsets, decoder = w.encode(part.column("text"))
                shas = _digests(ids, offsets, decoder.texts())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(offsets)), *[pa.array(x, pa.string()) for x in shas]], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


SPACES = " \t\n\x0b\x0c\r"


def split_ends(text: str) -> tuple[str, str, str] | None:
    """(fragment before the first white space, the middle, fragment after the last); None if there is none."""
    head = len(text)
    for c in SPACES:
        if 0 <= (at := text.find(c)) < head:
            head = at
    if head == len(text):
        return None
    tail = max(text.rfind(c) for c in SPACES)
    return text[:head], text[head : tail + 1], text[tail + 1 :]


def _ends(w: Words, text: str) -> dict:
    """A leaf or part of one as a row: `whole` without white space, else ids of the middle; fragments with ids and spans."""
    def packed(p: Piece) -> bytes:
        return np.array([p.ids, p.starts, p.ends], "<u4").tobytes()

    cut = split_ends(text)
    if cut is None:
        return {"whole": True, "head": text, "head_ids": packed(w.encode_unsplit(text)), "ids": b"", "tail": "", "tail_ids": b""}
    head, middle, tail = cut
    ids, _, _ = w.encode(pa.array([middle]))
    return {"whole": False, "head": head, "head_ids": packed(w.encode_unsplit(head)), "ids": ids.astype("<u4").tobytes(), "tail": tail, "tail_ids": packed(w.encode_unsplit(tail))}


LEAVES = "doc_id {id}, h bigint, n bigint, i bigint, copies bigint, whole boolean, head string, head_ids binary, ids binary, tail string, tail_ids binary"


def _leaves(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = words(path)
        for b in batches:
            for k in range(b.num_rows):
                one = b.slice(k, 1)
                row = _ends(w, one.column("text")[0].as_py())
                kinds = {"whole": pa.bool_(), "head": pa.string(), "head_ids": pa.binary(), "ids": pa.binary(), "tail": pa.string(), "tail_ids": pa.binary()}
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in ("doc_id", "h", "n", "i", "copies")], *[pa.array([row[c]], t) for c, t in kinds.items()]], names=["doc_id", "h", "n", "i", "copies", *kinds])

    return run


def _piece(text: str, packed: bytes) -> Piece:
    a = np.frombuffer(packed, "<u4").reshape(3, -1).tolist()
    return Piece(text, *a)


def _tree(w: Words, pieces: list[Piece]) -> Piece:
    while len(pieces) > 1:
        pieces = [w.join(*pieces[k : k + 2]) if k + 1 < len(pieces) else pieces[k] for k in range(0, len(pieces), 2)]
    return pieces[0]


def assemble(w: Words, leaves: list[dict]) -> np.ndarray:
    """The ids of a text from its leaves in order."""
    out: list[bytes] = []
    run: list[Piece] = []
    for x in leaves:
        run.append(_piece(x["head"], x["head_ids"]))
        if not x["whole"]:
            out.append(np.array(_tree(w, run).ids, "<u4").tobytes())
            out.append(x["ids"])
            run = [_piece(x["tail"], x["tail_ids"])]
    out.append(np.array(_tree(w, run).ids, "<u4").tobytes() if run else b"")
    return np.frombuffer(b"".join(out), "<u4")


def _joined(path: str):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        """The leaves of one text."""
        w = words(path)
        rows = rows.sort_by("i")
        ids = assemble(w, rows.select(["whole", "head", "head_ids", "ids", "tail", "tail_ids"]).to_pylist())
        decoded = " ".join([w.names[k] for k in ids.tolist()])
        doc_id = rows.column("doc_id").combine_chunks().slice(0, 1)
        return pa.Table.from_arrays([doc_id, pa.array([len(ids)], pa.int64()), pa.array([hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest()]), pa.array([hashlib.sha256(decoded.encode()).hexdigest()]), rows.column("copies").slice(0, 1)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "copies"])

    return run


def encoded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """One row per document row: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts have no tokens. Repeated rows give repeated rows;
    equal doc_ids with different texts stay apart; other columns are ignored.
    Special tokens written out in a text are encoded as the library does.
    """
    path = path or tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()
    df = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    long = F.coalesce(F.length("text") > leaf, F.lit(False))
    short = df.where(~long).mapInArrow(_short(path), OUT.format(id=kind))
    cut = df.where(long).select("doc_id", F.xxhash64("text").alias("h"), F.length("text").cast("bigint").alias("n"), F.posexplode(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{leaf}}}"), 0)).alias("i", "text"))
    # a leaf of a repeated row is encoded once, and its row given out again at the end
    cut = cut.groupBy("doc_id", "h", "n", F.col("i").cast("bigint").alias("i")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    parts = cut.mapInArrow(_leaves(path), LEAVES.format(id=kind))
    joined = parts.groupBy("doc_id", "h", "n").applyInArrow(_joined(path), OUT.format(id=kind) + ", copies bigint")
    again = joined.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")).alias("copy")).drop("copies", "copy")
    return short.unionByName(again)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
