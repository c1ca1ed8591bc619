"""Sum-of-squares online packing of documents into sequences.

Each Spark partition packs its own documents as they come, without a shuffle. A document's full windows are sequences of
their own; what is left of it goes to the open window level (or to a new window) for which the sum of the squared counts
of open windows by fill level is smallest afterwards. The counts are an array over the levels. When a partition ends, the
few windows still open are joined, cutting freely, so that at most one sequence of a partition is padded.
"""

from __future__ import annotations

import os
import re
import sys
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import read
from quire.llm.pretokens import SPACE, pieces, vocabulary
from quire.llm.token_counts import byte_characters

FILE = "byte_bpe_50k.json"
WINDOW = 1024
END = 0
#: Pieces in one generation of a process's memory, and characters of the longest piece that is remembered.
MEMORY, LONG = 300_000, 64
#: Bytes of the texts that are encoded together, and words of them in one step.
SLICE, BLOCK = 1 << 23, 1 << 14

#: (doc_id, start, ids as bytes, tokens of the document)
Piece = tuple[int | None, int, bytes, int]


class Memory(dict):
    """Ids of pieces by piece, four bytes each, from the library's model when they are first asked for; what is in use stays."""

    def __init__(self, model):
        super().__init__()
        self.tokenize = model.tokenize
        self.shown = {b: c for c, b in byte_characters().items()}
        self.space = self.shown[32]
        # two generations: when the young one, this dictionary, is full it becomes the old one
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            # the model takes each byte as the character that shows it; printable ASCII but the space shows itself
            if piece.isascii() and piece.isprintable():
                shown = piece.replace(" ", self.space)
            else:
                shown = piece.encode().decode("latin-1").translate(self.shown)
            ids = _bytes([t.id for t in self.tokenize(shown)])
        if len(piece) <= LONG:
            if len(self) >= MEMORY:
                self.old = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """Ids of texts, four bytes each.

    A space before anything but white space always begins a piece. So texts are cut there, each distinct word of many
    texts is cut into pieces once, and the library's model encodes each distinct piece once. Texts with special tokens
    go to the library; those with a space before white space or at their end are cut into pieces by themselves.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        special = [re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)).search if special else lambda _: None
        self.alone = "|".join([rf" (?:[{SPACE}]|\z)", *special])
        self.memory = Memory(self.library.model)

    def encode(self, texts: pa.Array) -> Iterator[bytes]:
        texts = pc.fill_null(texts, "")
        alone = pc.match_substring_regex(texts, self.alone)
        parts = pc.split_pattern(pc.if_else(alone, "", texts), " ")
        begins, parts = parts.offsets.to_numpy(), parts.flatten()
        first = np.zeros(len(parts), dtype=bool)  # a text's first part has no space before it
        first[begins[:-1]] = True
        words = parts.filter(pa.array(~first)).dictionary_encode()
        ids, ends = self._words(words.dictionary, words.indices.to_numpy())
        bounds = np.concatenate([[0], ends])[begins - np.arange(len(begins))].tolist()
        for k, (apart, part) in enumerate(zip(alone.to_pylist(), parts.filter(pa.array(first)).to_pylist())):
            if apart:
                yield self._alone(texts[k].as_py())
            else:
                yield b"".join((self._pieces(part), ids[4 * bounds[k] : 4 * bounds[k + 1]]))

    def _words(self, distinct: pa.Array, index: np.ndarray) -> tuple[memoryview, np.ndarray]:
        """The ids of words one after another, a space before each, and how many there are up to each word's end."""
        pool, lengths = [], [np.zeros(0, dtype=np.int64)]
        for k in range(0, len(distinct), BLOCK):
            some = distinct.slice(k, BLOCK)
            cut = pieces(" " + pc.binary_join(pa.ListArray.from_arrays([0, len(some)], some), pa.scalar(" ", some.type))[0].as_py())
            found = [self.memory[p] for p in cut]
            upto = np.cumsum(list(map(len, found))) // 4
            last = np.searchsorted(np.cumsum(list(map(len, cut))), np.cumsum(pc.utf8_length(some).to_numpy() + 1))
            lengths.append(np.diff(upto[last], prepend=0))
            pool.append(b"".join(found))
        ids, length = np.frombuffer(b"".join(pool), dtype="<u4"), np.concatenate(lengths)
        at, out = np.cumsum(length) - length, []
        for k in range(0, len(index), BLOCK):
            some = index[k : k + BLOCK]
            n = length[some]
            out.append(ids[np.repeat(at[some] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes())
        return memoryview(b"".join(out)), np.cumsum(length[index])

    def _alone(self, text: str) -> bytes:
        return _bytes(self.library.encode(text, add_special_tokens=False).ids) if self.special(text) else self._pieces(text)

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.memory.__getitem__, pieces(text)))


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One for each Python process, so that tasks which follow one another in it share what is remembered."""
    return Encoder(path)


def _bytes(ids: list[int]) -> bytes:
    found = array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


class Packer:
    """Open windows by fill level; yields a sequence, a list of pieces, when it is full."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        # what the sum of squares changes by when a window comes to a level, and when one leaves it
        self.coming = np.ones(window + 1, dtype=np.int64)
        self.leaving = np.full(window + 1, np.iinfo(np.int64).max // 2)
        self.coming[window] = self.leaving[0] = 0  # neither full nor new windows are counted
        self.open: list[list[list[Piece]]] = [[] for _ in range(window)]

    def level(self, size: int) -> int:
        """The fill level to put a piece of this size into; 0 for a new window. Of equals the fullest."""
        cost = self.leaving[: self.window - size + 1] + self.coming[size:]
        return int(len(cost) - 1 - np.argmin(cost[::-1]))

    def count(self, level: int, more: int) -> None:
        n = self.counts[level] = self.counts[level] + more
        self.coming[level] = 2 * n + 1
        self.leaving[level] = 1 - 2 * n if n else np.iinfo(np.int64).max // 2

    def put(self, piece: Piece, size: int) -> list[Piece] | None:
        at = self.level(size)
        held = []
        if at:
            held = self.open[at].pop()
            self.count(at, -1)
        held.append(piece)
        if at + size == self.window:
            return held
        self.count(at + size, 1)
        self.open[at + size].append(held)
        return None

    def document(self, doc_id: int | None, ids: bytes) -> Iterator[list[Piece]]:
        n = len(ids) // 4
        for a in range(0, n - self.window + 1, self.window):
            yield [(doc_id, a, ids[4 * a : 4 * (a + self.window)], n)]
        if rest := n % self.window:
            if full := self.put((doc_id, n - rest, ids[4 * (n - rest) :], n), rest):
                yield full

    def close(self) -> Iterator[list[Piece]]:
        """The open windows, fullest first, joined and cut at the window's end."""
        held, free = [], self.window
        for level in reversed(range(self.window)):
            for doc_id, start, ids, n in (p for pieces_ in self.open[level] for p in pieces_):
                while ids:
                    part, ids = ids[: 4 * free], ids[4 * free :]
                    held.append((doc_id, start, part, n))
                    start += len(part) // 4
                    free -= len(part) // 4
                    if not free:
                        yield held
                        held, free = [], self.window
        if held:
            yield held


def slices(batch: pa.RecordBatch, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Rows whose texts, the second column, have so many bytes together, or a single row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + size, side="right")))
        yield batch.slice(a, b - a)
        a = b


def pack(docs: DataFrame, path: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for.

    A document is its ids and one END; null and empty texts are an END alone. Repeated rows are packed each. A document
    longer than a window is cut. An empty table gives no rows. Sequence ids hold the partition's number above 40 bits.
    """
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of, packer, end = encoder(path).encode, Packer(window), _bytes([END])
        sequence = TaskContext.get().partitionId() << 40
        held: list[Piece] = []
        places: list[tuple[int, int]] = []

        def take(full: list[Piece]) -> None:
            nonlocal sequence
            offset = 0
            for piece in full:
                places.append((sequence, offset))
                offset += len(piece[2]) // 4
            held.extend(full)
            sequence += 1

        def batch() -> pa.RecordBatch:
            ids, n = [p[2] for p in held], np.array(places, dtype=np.int64).reshape(-1, 2)
            crc, length = (np.array(list(map(f, ids)), dtype=np.int64) for f in (zlib.crc32, len))
            columns = [pa.array([p[0] for p in held], pa.int64()), [p[1] for p in held], length // 4, crc, [p[3] for p in held], n[:, 0], n[:, 1]]
            out = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns] + [pa.array(ids, pa.binary())] * with_ids, names)
            held.clear()
            places.clear()
            return out

        for whole in batches:
            for b in slices(whole):
                for d, ids in zip(b.column(0).to_pylist(), ids_of(b.column(1))):
                    for full in packer.document(d, ids + end):
                        take(full)
                yield batch()
        for full in packer.close():
            take(full)
        yield batch()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(FILE))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of docs, as ``pack`` makes them: null texts are empty ones, repeated rows are packed each, no rows give none; other columns don't matter."""
    return pack(docs, vocabulary(FILE))
