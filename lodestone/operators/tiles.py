"""The best rows of every query, tile by tile inside the tasks.

Queries lie in blocks of a bounded size, written where all tasks can read them.
A task meets its own rows, some hundred at a time, with a block's queries, some
hundred at a time, and keeps the best k of each query. So every query meets
every row, no row is shuffled, and a task hands on k rows a query.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs

ROWS = 512
"""Rows of a tile."""
QUERIES = 512
"""Queries of a tile."""
PIECE = 1 << 20
"""Products that are added one by one, so many at a time."""
DENSE = 0.001
"""A term whose rows and queries pair up in so much of a tile's pairs is multiplied as a matrix."""
LEADS = 256
"""Terms, those that pair up most, that tell which queries and rows are alike."""
GROUPS = 4
"""Groups of alike queries and rows, so many at most."""
TALL, WIDE = 1024, 2048
"""Alike rows that meet alike queries at a time, so many of each at most."""
CLOSE = 256
"""Pairs that are summed again at a time."""


def _read(uri: str) -> pa.Table:
    system, path = fs.FileSystem.from_uri(uri)
    names = sorted(f.path for f in system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True)) if f.path.endswith(".parquet"))
    return pa.concat_tables([pq.ParquetFile(system.open_input_file(n)).read() for n in names]).combine_chunks() if names else None


def _words(keys: pa.Array) -> np.ndarray:
    """Keys as rows of unsigned words that sort as they do."""
    if pa.types.is_integer(keys.type):
        return (np.asarray(keys.cast(pa.int64())).view(np.uint64) ^ np.uint64(1 << 63))[:, None]
    raw = [x.encode() for x in keys.cast(pa.string()).to_pylist()]
    width = 8 * (max(map(len, raw), default=0) // 8 + 1)
    words = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in raw), ">u8").reshape(len(raw), width // 8)
    return np.column_stack([words.astype(np.uint64), np.array([len(x) for x in raw], np.uint64)])


def _wider(words: np.ndarray, n: int) -> np.ndarray:
    more = n - words.shape[1]
    return np.column_stack([words[:, :-1], np.zeros((len(words), more), np.uint64), words[:, -1:]]) if more else words


class Best:
    """The best k so far of each of n queries, ties by key. What is below `least` isn't among them."""

    def __init__(self, n: int, k: int) -> None:
        self.k, self.least = k, np.full(n, -np.inf)
        self.emptied()

    def emptied(self) -> None:
        """Nothing is found yet; `least` stays, as other rows have shown it."""
        self.at, self.score, self.name, self.words = np.zeros(0, np.int64), np.zeros(0), np.zeros(0, object), None

    def add(self, at: np.ndarray, score: np.ndarray, name: np.ndarray, words: np.ndarray) -> None:
        old = words[:0] if self.words is None else self.words
        n = max(old.shape[1], words.shape[1])
        words = np.concatenate([_wider(old, n), _wider(words, n)])
        at, score, name = np.concatenate([self.at, at]), np.concatenate([self.score, score]), np.concatenate([self.name, name])
        order = np.lexsort((*words.T[::-1], -score, at))
        at = at[order]
        no = np.arange(len(at)) - np.searchsorted(at, at)
        full = no == self.k - 1
        self.least[at[full]] = np.maximum(self.least[at[full]], score[order[full]])
        keep = no < self.k
        order = order[keep]
        self.at, self.score, self.name, self.words = at[keep], score[order], name[order], words[order]

    def bound(self, tile: np.ndarray) -> np.ndarray:
        """What a row of this tile (rows by queries) must reach at least to be among the best."""
        new = np.isinf(self.least)
        if not new.any() or len(tile) <= self.k:
            return self.least
        bound = self.least.copy()
        bound[new] = np.partition(tile[:, new], len(tile) - self.k, axis=0)[-self.k]
        return bound


class Vectors:
    """Queries by inner product. Products of whole tiles tell what may be among the best; that is summed again component by component, in order."""

    rows = ROWS

    def __init__(self, queries: pa.Table, k: int) -> None:
        self.ids = queries.column("query_id").combine_chunks()
        self.q = _matrix(queries.column("vector").combine_chunks())
        self.size = np.sqrt((self.q**2).sum(1))
        self.tiles = [(i, Best(min(QUERIES, len(self.q) - i), k)) for i in range(0, len(self.q), QUERIES)]

    def meet(self, rows: pa.RecordBatch, words: np.ndarray, names: np.ndarray) -> None:
        v = _matrix(rows.column(1))
        longest = np.sqrt((v**2).sum(1).max())
        for i, best in self.tiles:
            q = self.q[i : i + QUERIES]
            s = v @ q.T
            slack = 4e-16 * (v.shape[1] + 2) * longest * self.size[i : i + QUERIES]
            r, c = np.nonzero(s >= best.bound(s) - slack)
            for j in range(0, len(r), PIECE // 32):
                a, b = r[j : j + PIECE // 32], c[j : j + PIECE // 32]
                sums = np.zeros(len(a))
                for d in range(v.shape[1]):
                    sums += v[a, d] * q[b, d]
                best.add(b, sums, names[a], words[a])


def _matrix(lists: pa.Array) -> np.ndarray:
    flat = np.asarray(lists.flatten().cast(pa.float64()))
    return flat.reshape(len(lists), -1)


def _spans(ends: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the entries of each of these terms in turn, how many each has)."""
    n = (ends[of + 1] - ends[of]).astype(np.int64)
    return np.arange(int(n.sum())) + np.repeat(ends[of] - (np.cumsum(n) - n), n), n


def _centres(m: np.ndarray) -> np.ndarray:
    """A few directions that rows lie along; what is said of them decides how rows are dealt out, never what is found."""
    some = m[:: max(1, len(m) // 2048)]
    size = np.sqrt((some**2).sum(1))
    some = some[size > 0] / size[size > 0, None]
    if not len(some):
        return np.zeros((1, m.shape[1]), np.float32)
    rng, picked = np.random.default_rng(0), [0]
    for _ in range(GROUPS - 1):
        away = np.clip(1 - (some @ some[picked].T).max(1), 0, None)
        picked.append(int(np.searchsorted(np.cumsum(away), rng.random() * away.sum())) if away.sum() > 0 else 0)
    centres = some[picked]
    for _ in range(4):
        near = (some @ centres.T).argmax(1)
        sums = np.stack([some[near == i].sum(0) for i in np.unique(near)])
        centres = sums / np.sqrt((sums**2).sum(1))[:, None]
    return centres.astype(np.float32)


class Terms:
    """Queries by BM25. Queries and rows that use the same common words, as those of one language do, are met together: of a tile the terms of
    many of its rows and queries are multiplied as matrices, the others posting by posting. Products in single precision tell what may be among
    the best within a bound of their error; that is summed again in double precision. Scores are rounded to six places."""

    rows = 4096

    def __init__(self, queries: pa.Table, k: int, n: int, average: float, k1: float, b: float) -> None:
        self.average, self.k1, self.b = average, k1, b
        asked = queries.column("asked").combine_chunks()
        at = np.repeat(np.arange(len(asked)), np.asarray(pc.list_value_length(asked)))
        flat = asked.flatten()
        coded = flat.field("term").dictionary_encode()
        term, weight = np.asarray(coded.indices).astype(np.int64), np.asarray(flat.field("weight"))
        self.vocabulary = coded.dictionary
        size = len(self.vocabulary)
        df = np.zeros(size)
        df[term] = np.asarray(flat.field("df"))
        # sums of terms of both signs may be small beside their errors
        self.kind = np.float32 if (weight >= 0).all() else np.float64
        lead = np.argsort(-df * np.bincount(term, minlength=size), kind="stable")[:LEADS]
        self.lead = np.full(size, -1)
        self.lead[lead] = np.arange(len(lead))
        told = np.zeros((len(asked), len(lead)), np.float32)
        own = self.lead[term] >= 0
        told[at[own], self.lead[term[own]]] = weight[own]
        self.centres = _centres(told)
        group = (told @ self.centres.T).argmax(1)
        order = np.argsort(group, kind="stable")
        self.ids = queries.column("query_id").combine_chunks().take(pa.array(order))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        at = rank[at]
        stops = np.cumsum(np.bincount(group, minlength=len(self.centres)))
        self.tiles = []
        for start, stop in zip([0, *stops], stops):
            for i in range(int(start), int(stop), WIDE):
                wide = min(WIDE, int(stop) - i)
                mine = (at >= i) & (at < i + wide)
                by = np.argsort(term[mine], kind="stable")
                ends = np.concatenate([[0], np.cumsum(np.bincount(term[mine], minlength=size))]).astype(np.int32)
                self.tiles.append((i, Best(wide, k), ends, (at[mine] - i)[by], weight[mine][by]))

    def meet(self, rows: pa.RecordBatch, words: np.ndarray, names: np.ndarray) -> None:
        n, terms = rows.num_rows, rows.column(2)
        flat = terms.flatten()
        at = np.repeat(np.arange(n), np.asarray(pc.list_value_length(terms)))
        no = np.asarray(pc.fill_null(pc.index_in(flat.field("term"), self.vocabulary), -1)).astype(np.int64)
        hit = no >= 0
        at, no, tf = at[hit], no[hit], np.asarray(flat.field("tf"))[hit].astype(float)
        length = np.asarray(rows.column(1)).astype(float)[at]
        u = tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.average))
        told = np.zeros((n, self.centres.shape[1]), np.float32)
        own = self.lead[no] >= 0
        told[at[own], self.lead[no[own]]] = u[own]
        group = (told @ self.centres.T).argmax(1)
        for g in np.unique(group):
            all_of = np.flatnonzero(group == g)
            for i in range(0, len(all_of), TALL):
                mine = all_of[i : i + TALL]
                place = np.full(n, -1)
                place[mine] = np.arange(len(mine))
                own = place[at] >= 0
                found = place[at[own]], no[own], u[own]
                held = np.bincount(found[1], minlength=len(self.vocabulary))
                for tile in self.tiles:
                    self._tile(tile, len(mine), *found, held, words[mine], names[mine])

    def _tile(self, tile: tuple, n: int, at: np.ndarray, no: np.ndarray, u: np.ndarray, held: np.ndarray, words: np.ndarray, names: np.ndarray) -> None:
        _, best, ends, asking, weight = tile
        wide, asks = len(best.least), np.diff(ends)
        dense = np.flatnonzero(held * asks > DENSE * n * wide)
        column = np.full(len(asks), -1)
        column[asks > 0] = len(dense)
        column[dense] = np.arange(len(dense))
        column = column[no]
        own = (column >= 0) & (column < len(dense))
        impacts = np.zeros((n, len(dense)))
        impacts[at[own], column[own]] = u[own]
        place, each = _spans(ends, dense)
        asked = np.zeros((wide, len(dense)))
        asked[asking[place], np.repeat(np.arange(len(dense)), each)] = weight[place]
        own = column == len(dense)
        at, no, u = at[own], no[own], u[own]
        rest = np.zeros((n, wide))
        upto = np.cumsum(asks[no], dtype=np.int64)
        start = 0
        while start < len(no):
            done = upto[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(upto, done + PIECE, "right")))
            place, m = _spans(ends, no[start:stop])
            cell = np.repeat(at[start:stop] * wide, m) + asking[place]
            rest += np.bincount(cell, np.repeat(u[start:stop], m) * weight[place], minlength=n * wide).reshape(n, wide)
            start = stop
        left, right = impacts.astype(self.kind), asked.astype(self.kind)
        s = left @ right.T
        s += rest
        # products of whole rows add up to the rows' lengths at most
        error = (len(dense) + 8) * float(np.finfo(self.kind).eps)
        slack = error * (1e-9 + np.sqrt(np.einsum("ij,ij->i", left, left).max(initial=0)) * np.sqrt(np.einsum("ij,ij->i", right, right)))
        bound = best.bound(s)
        bound = (bound - 2 * slack - error * np.abs(bound, where=np.isfinite(bound), out=np.zeros(wide)) - 2e-6).astype(self.kind)
        r, c = np.nonzero((s >= bound) & (s != 0))
        for j in range(0, len(r), PIECE // 32):
            a, b = r[j : j + PIECE // 32], c[j : j + PIECE // 32]
            score = rest[a, b]
            for i in range(0, len(a), CLOSE):
                score[i : i + CLOSE] += np.einsum("ij,ij->i", impacts[a[i : i + CLOSE]], asked[b[i : i + CLOSE]])
            score = np.floor(score * 1e6 + 0.5) / 1e6
            some = (score > 0) & (score >= best.least[b])
            if some.any():
                best.add(b[some], score[some], names[a[some]], words[a[some]])


_HELD: list[tuple] = []


def held(folder: str, of: type, *settings: float) -> Vectors | Terms | None:
    """A folder's queries, read by a worker's first task that needs them. The next ones go on with the least scores that it found: all are of the same rows, so what is below them is nowhere among the best."""
    key = (folder, of.__name__, settings)
    if not _HELD or _HELD[0][0] != key:
        _HELD.clear()
        queries = _read(folder)
        _HELD.append((key, of(queries, *settings) if queries is not None else None))
    block = _HELD[0][1]
    for _, found, *_ in block.tiles if block else ():
        found.emptied()
    return block


def best(folder: str, of: type, *settings: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over rows whose first column is their key: (query_id, key, score) of a task's best rows for the queries in a folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kind = None, None
        for b in batches:
            if block is None:
                block, kind = held(folder, of, *settings), b.schema.field(0)
                if block is None:
                    return
            for i in range(0, b.num_rows, of.rows):
                rows = b.slice(i, of.rows)
                keys = rows.column(0)
                block.meet(rows, _words(keys), np.array(keys.to_pylist(), object))
        for i, found, *_ in block.tiles if block else ():
            yield pa.RecordBatch.from_arrays([block.ids.take(pa.array(found.at + i)), pa.array(found.name, kind.type), pa.array(found.score)], names=["query_id", kind.name, "score"])

    return run


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, tokens) to (key, length, terms): the different tokens of a row and how often each occurs."""
    for b in batches:
        lists = b.column(1)
        coded = lists.flatten().dictionary_encode()
        of = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
        names = max(1, len(coded.dictionary))
        pair, tf = np.unique(of * names + np.asarray(coded.indices), return_counts=True)
        ends = np.concatenate([[0], np.cumsum(np.bincount(pair // names, minlength=len(lists)))])
        entries = pa.StructArray.from_arrays([coded.dictionary.take(pa.array(pair % names)), pa.array(tf, pa.int64())], names=["term", "tf"])
        yield pa.RecordBatch.from_arrays([b.column(0), pc.list_value_length(lists).cast(pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), entries)], names=[b.schema.names[0], "length", "terms"])
