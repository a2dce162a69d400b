"""Batches of texts to token ids with a public tokenizer file.

The tokenizer drops white space and never looks across it, so a text's ids are
those of its words in turn. Each distinct word is taken apart once a batch, its
parts are remembered; Arrow and numpy put the texts' ids together. Words with
no split point for thousands of characters go
through `encode_unsplit`, the tree concatenation.
"""

from __future__ import annotations

import os
from array import array
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = "word_bpe_49k.json"
PLAIN = r"^(?P<head>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<tail>[!-&(-/:-@\[-`{-~]*)$"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + n for n, b in enumerate(sorted(set(range(256)) - set(PRINTED)))}
"""Fixed values: the byte-level alphabet shows these bytes as themselves and the rest, in order, from 256 on."""
REMEMBERED = 120_000
"""Units a worker remembers before it starts afresh; a bound on memory only, results never depend on it."""
UNSPLIT = 2048
"""An unsplit run of more code points is encoded by halves."""
AGREE = 8
"""Tokens in a row that must be equal on both sides of a splice inside an unsplit run."""
LEAST_WINDOW = 64


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass
class Piece:
    """Token ids of an unsplit text, with the span of code points of each."""

    text: str
    ids: list[int]
    starts: list[int]
    ends: list[int]


class Words:
    """Encoder of whole texts that remembers the parts of words."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.names = [self.tok.id_to_token(i) for i in range(self.tok.get_vocab_size(with_added_tokens=True))]
        self.known: dict[str, bytes] = {}

    # -- unsplit runs -------------------------------------------------

    def piece(self, text: str) -> Piece:
        e = self.tok.encode(text, add_special_tokens=False)
        return Piece(text, e.ids, [a for a, _ in e.offsets], [b for _, b in e.offsets])

    def encode_unsplit(self, text: str, leaf: int = UNSPLIT) -> Piece:
        """Halves are encoded apart, down to the leaf size, and joined pairwise."""
        if len(text) <= leaf:
            return self.piece(text)
        half = len(text) // 2
        return self.join(self.encode_unsplit(text[:half], leaf), self.encode_unsplit(text[half:], leaf))

    def join(self, left: Piece, right: Piece) -> Piece:
        """The encoding of left.text + right.text.

        A window around the join is encoded anew and grows, doubling, until it
        starts with the very tokens that the left side has there and, short of
        its own end, runs into tokens that the right side has at the same
        place. Adjacent pairs on either side of the splices then all come from
        one encoding, which makes the whole a valid, and so the only, encoding.
        """
        text, cut = left.text + right.text, len(left.text)
        size = LEAST_WINDOW
        while True:
            a, b = max(0, cut - size), min(len(text), cut + size)
            i = 0
            if a:
                i = next((k for k in range(len(left.ids) - 1, 0, -1) if left.starts[k] <= a and left.ends[k - 1] <= left.starts[k]), 0)
                a = left.starts[i] if i else 0
            w = self.piece(text[a:b])
            ws, we = [x + a for x in w.starts], [x + a for x in w.ends]
            same_left = not i or (
                w.ids[:AGREE] == left.ids[i : i + AGREE] and we[:AGREE] == left.ends[i : i + AGREE] and len(w.ids) >= AGREE and we[AGREE - 1] <= cut - 16
            )
            at = self._agreement(w.ids, ws, we, right, cut, b, len(text)) if same_left else None
            if at is not None:
                k, j = at
                return Piece(
                    text,
                    left.ids[:i] + w.ids[:k] + right.ids[j:],
                    left.starts[:i] + ws[:k] + [x + cut for x in right.starts[j:]],
                    left.ends[:i] + we[:k] + [x + cut for x in right.ends[j:]],
                )
            size *= 2

    @staticmethod
    def _agreement(ids: list[int], starts: list[int], ends: list[int], right: Piece, cut: int, b: int, total: int) -> tuple[int, int] | None:
        """Where the window's tokens can give way to the right side's: counts of tokens taken and skipped."""
        if b == total:
            return len(ids), len(right.ids)
        at = {(s + cut, e + cut): j for j, (s, e) in enumerate(zip(right.starts, right.ends)) if s + cut < b}
        for k in range(len(ids) - 2 * AGREE):
            j = at.get((starts[k], ends[k]))
            if j is None or starts[k] < cut + 16 or starts[k + 1] < ends[k]:
                continue
            n = slice(j, j + AGREE)
            if ids[k : k + AGREE] == right.ids[n] and [x - cut for x in ends[k : k + AGREE]] == right.ends[n] and ends[k + AGREE - 1] <= b - 16:
                return k + 1, j + 1
        return None

    # -- batches ------------------------------------------------------

    def units(self, letters: list[str], others: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each unit: text without white space that the tokenizer splits from its neighbours.

        Letters are in lower case and composed already, so the library's model
        is asked without its normaliser and splitter.
        """
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        fresh = {}
        model = self.tok.model
        for w in letters:
            if w not in known:
                ids = [t.id for t in model.tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(BYTES))]
                (known if len(w) <= 48 else fresh)[w] = array("I", ids).tobytes()
        new = [w for w in others if w not in known]
        fresh |= {w: array("I", self.encode_unsplit(w).ids).tobytes() for w in new if len(w) > UNSPLIT}
        short = [w for w in new if len(w) <= UNSPLIT]
        for at in range(0, len(short), 4096):
            part = short[at : at + 4096]
            for w, e in zip(part, self.tok.encode_batch_fast(part, add_special_tokens=False)):
                (known if len(w) <= 48 else fresh)[w] = array("I", e.ids).tobytes()
        if fresh:
            return [known[w] if w in known else fresh[w] for w in chain(letters, others)]
        return [known[w] for w in chain(letters, others)]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, Decoder]:
        """(ids of all texts in turn, offsets of each text, what decodes them). Null texts are empty.

        A word of Latin letters and then punctuation is two units, its letters
        in lower case and the rest, since the tokenizer splits there too.
        """
        lists = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        offsets = np.asarray(lists.offsets, dtype=np.int64)
        coded = lists.flatten().dictionary_encode()
        plain = pc.extract_regex(coded.dictionary, PLAIN)
        simple = pc.is_valid(plain)
        head = pc.utf8_lower(pc.if_else(simple, pc.struct_field(plain, "head"), pa.scalar("", pa.large_string())))
        head = head.dictionary_encode()
        tail = pc.if_else(simple, pc.struct_field(plain, "tail"), coded.dictionary).dictionary_encode()
        got = self.units(head.dictionary.to_pylist(), tail.dictionary.to_pylist())
        size = np.fromiter(map(len, got), np.int64, len(got)) // 4
        word = np.stack([np.asarray(head.indices, dtype=np.int64), np.asarray(tail.indices, dtype=np.int64) + len(head.dictionary)], axis=1)
        index = word[np.asarray(coded.indices)].reshape(-1)
        offsets = 2 * (offsets - offsets[0])
        some = size[index] > 0
        offsets = np.concatenate([[0], np.cumsum(some)])[offsets]
        index = index[some]
        first = np.cumsum(size) - size
        n = size[index]
        ends = np.cumsum(n)
        take = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first[index] - (ends - n), n)
        pool = np.frombuffer(b"".join(got), "<u4")
        return pool[take], np.concatenate([[0], ends])[offsets], Decoder(self.names, got, index, offsets)


@dataclass
class Decoder:
    """Decodes the ids of a batch as the tokenizer does: it has no decoder of its own, so tokens are joined by one space."""

    names: list[str]
    ids: list[bytes]
    index: np.ndarray
    offsets: np.ndarray

    def texts(self) -> pa.Array:
        names = self.names
        pool = pa.array([" ".join([names[i] for i in np.frombuffer(x, "<u4").tolist()]) for x in self.ids], pa.large_string())
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(self.offsets, pa.int64()), pool.take(pa.array(self.index))), pa.scalar(" ", pa.large_string()))


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    """One encoder a worker."""
    return Words(path)
