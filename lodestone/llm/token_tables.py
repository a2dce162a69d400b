"""Token ids as sorted string tables.

Documents are sorted by identifier and dealt out by range; each task writes one
shard, a sorted string table: data blocks whose keys share prefixes, a sparse
index with the first key of each block, a Bloom filter over the keys and a
footer. A reader finds one document with a binary search and one block read.

Shard layout, integers little-endian unless stated:

    block   entries, then the CRC-32 of them. An entry is three varints (key
            bytes shared with the entry before, further key bytes, value
            bytes), the key bytes and the value. A block starts unshared.
    index   per block: u16 key length, first key, u64 offset, u32 length, u32 entries
    bloom   the bits
    footer  u64 index offset, u32 index length, u64 bloom offset, u32 bloom
            length, u8 hashes, u8 id width, u64 entries, u64 ids, magic

A key is the identifier plus 2**63 in eight big-endian bytes, so that keys sort
as identifiers do; a null identifier's key is empty and sorts first. A value is
the document's ids, of 2 bytes each if the vocabulary allows, else 4.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ._common import new_folder, slices, staged, table
from ._tokenizer import tokenizer_path, words

END_ID = 2
BLOCK = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
MAGIC = b"LSTTAB01"
FOOTER = struct.Struct("<QIQIBBQQ8s")
SPOT = struct.Struct("<QII")
MANIFEST = "shard int, path string, n_docs bigint, n_ids bigint, first_key binary, last_key binary"


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", doc_id + 2**63)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - 2**63 if key else None


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bloom_places(key: bytes, bits: int, hashes: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), (h >> 64) | 1
    return [(a + i * b) % bits for i in range(hashes)]


class Writer:
    """Writes one shard to an open binary stream; keys come in order."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.entries = self.ids = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self.start()

    def start(self) -> None:
        self.block, self.first, self.last, self.count = bytearray(), b"", b"", 0

    def add(self, key: bytes, value: bytes) -> None:
        if not self.count:
            self.first, shared = key, 0
        else:
            shared = next((i for i, (a, b) in enumerate(zip(key, self.last)) if a != b), min(len(key), len(self.last)))
        self.block += varint(shared) + varint(len(key) - shared) + varint(len(value)) + key[shared:] + value
        self.last, self.count = key, self.count + 1
        self.entries, self.ids = self.entries + 1, self.ids + len(value) // self.width
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if len(self.block) >= BLOCK:
            self.flush()

    def flush(self) -> None:
        if self.count:
            data = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append(struct.pack("<H", len(self.first)) + self.first + SPOT.pack(self.at, len(data), self.count))
            self.put(data)
        self.start()

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self.flush()
        bits = max(64, BLOOM_BITS * len(self.keys))
        bloom = np.zeros(bits, np.uint8)
        for k in self.keys:
            bloom[_bloom_places(k, bits, BLOOM_HASHES)] = 1
        index, bloom = b"".join(self.index), struct.pack("<Q", bits) + np.packbits(bloom).tobytes()
        at = self.at
        self.put(index)
        self.put(bloom)
        self.put(FOOTER.pack(at, len(index), at + len(index), len(bloom), BLOOM_HASHES, self.width, self.entries, self.ids, MAGIC))


class Reader:
    """One shard by its URI: footer, index and Bloom filter are read at once, blocks when needed."""

    def __init__(self, uri: str):
        system, path = fs.FileSystem.from_uri(uri)
        self.file = system.open_input_file(path)
        size = self.file.size()
        at, n, bloom_at, bloom_n, self.hashes, self.width, self.entries, self.ids, magic = FOOTER.unpack(self.read(size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token table")
        index = self.read(at, n)
        self.firsts, self.spots, k = [], [], 0
        while k < len(index):
            (length,) = struct.unpack_from("<H", index, k)
            self.firsts.append(index[k + 2 : k + 2 + length])
            self.spots.append(SPOT.unpack_from(index, k + 2 + length))
            k += 2 + length + SPOT.size
        bloom = self.read(bloom_at, bloom_n)
        (self.bits,), self.bloom = struct.unpack_from("<Q", bloom), bloom[8:]

    def read(self, at: int, n: int) -> bytes:
        return self.file.read_at(n, at)

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, n, count = self.spots[i]
        data = self.read(at, n)
        if zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("a damaged block")
        k, key = 0, b""
        for _ in range(count):
            three = []
            for _ in range(3):
                n = shift = 0
                while True:
                    c = data[k]
                    k += 1
                    n |= (c & 127) << shift
                    shift += 7
                    if c < 128:
                        break
                three.append(n)
            shared, more, size = three
            key = key[:shared] + data[k : k + more]
            k += more
            yield key, data[k : k + size]
            k += size

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.spots)):
            yield from self.block(i)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of each document of that identifier: none if the Bloom filter or the search says so, several if it is repeated."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (7 - (p & 7)) & 1 for p in _bloom_places(key, self.bits, self.hashes)):
            return []
        found = []
        i = bisect_right(self.firsts, key) - 1
        while i > 0 and self.firsts[i] == key:  # a repeated identifier may start in the block before
            i -= 1
        for i in range(max(0, i), len(self.spots)):
            if self.firsts[i] > key:
                break
            found += [self.decode(v) for k, v in self.block(i) if k == key]
        return found

    def decode(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}").astype("<u4")


def _write(folder: str, path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId()
        system, base = fs.FileSystem.from_uri(folder)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.sst"  # an attempt's own; the manifest names those of the attempts that count
        w = out = None
        first = last = b""
        for b in batches:
            for part in slices(b, "text"):
                if out is None:
                    encoder = words(path)
                    width = 2 if len(encoder.names) <= 1 << 16 else 4
                    system.create_dir(base, recursive=True)
                    out = system.open_output_stream(f"{base}/{name}")
                    w = Writer(out, width)
                    first = key_of(part.column("doc_id")[0].as_py())
                ids, offsets, _ = encoder.encode(part.column("text"))
                raw, end = memoryview(ids.astype(f"<u{width}").tobytes()), end_id.to_bytes(width, "little")
                for doc_id, s, e in zip(part.column("doc_id").to_pylist(), (offsets[:-1] * width).tolist(), (offsets[1:] * width).tolist()):
                    last = key_of(doc_id)
                    w.add(last, bytes(raw[s:e]) + end)
        if w is None:
            return
        w.close()
        out.close()
        pa.default_memory_pool().release_unused()  # many short tasks may leave idle workers behind; they should be small
        yield pa.RecordBatch.from_pydict(
            {"shard": pa.array([shard], pa.int32()), "path": [f"{folder}/{name}"], "n_docs": [w.entries], "n_ids": [w.ids], "first_key": pa.array([first], pa.binary()), "last_key": pa.array([last], pa.binary())}
        )

    return run


def write(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the shards and returns their manifest, a row a shard.

    Integer identifiers, nulls first; repeated identifiers and rows all stay,
    ordered by a hash of their texts. A null text is its end id alone. An empty
    table writes no shard. The folder is any URI that Arrow opens everywhere.
    Nothing is renamed: a task that runs again or twice writes a file of its
    own, and only files that the manifest names are part of the table.
    """
    path = path or tokenizer_path()
    df = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).repartitionByRange(F.col("doc_id").asc_nulls_first())
    df = df.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return staged(df.mapInArrow(_write(folder, path, end_id), MANIFEST), "token-tables")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for b in batches:
        for row in b.to_pylist():
            reader, start, rows = Reader(row["path"]), row["start"], []
            for i in range(len(reader.spots)):
                for key, value in reader.block(i):
                    ids = reader.decode(value)
                    rows.append((id_of(key), start, len(ids), zlib.crc32(ids.tobytes())))
                    start += len(ids)
                if len(rows) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def read(manifest: DataFrame) -> DataFrame:
    """One row per stored document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32; a task a shard or so."""
    w = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)  # a row a shard
    starts = manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(w), F.lit(0)).cast("bigint"))
    return starts.select("shard", "path", "start").repartition("shard").mapInArrow(_read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return read(write(docs, new_folder(spark, "token-tables")))
