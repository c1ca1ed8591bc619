"""Language-model scores from an Elias-Fano n-gram trie of order three.

Training counts words, pairs and triples over all training documents. Pairs and triples get an interpolated, absolutely
discounted probability, quantised to eight bits; all of them are kept unless a cut-off is asked for.

The trie is cut into shards, each built by a task of its own and published as array files in the shared folder, which
tasks map into memory. Levels are Elias-Fano sequences: words by hash; pairs by (place of the first word, number of the
second); contexts by (place of the last word, number of the word before it); triples by (place of the context, place of
the third word among the successors of the second), the context-relative form in which numbers stay small. Pointers to
each word's successors are a monotone sequence too. A search is a successor search in one of these sequences.

A word's pairs lie in its own shard, and so do the triples with this word in the middle, so that a triple is answered
where its context, its pair and its probabilities are. A word that is too frequent for a shard is given shards of its
own: its pairs are dealt over them by their second word and built first, its contexts by their first word.

Texts are cut into tokens once, in slices that are stored in the shared folder too. A slice sends each of its distinct triples, with its training
count, to the triple's shard, and gets one number back for it; no task needs more of the trie than the words and the
shards it answers for. Counting and scoring of the same documents share that exchange.

Words are known by their 64-bit hash.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import held_out, read, shared_path, stored
from quire.llm.elias_fano import Sequence, encode

DISCOUNT = 0.75
MIN_COUNT = 1
#: Training tokens for each shard of the trie, about.
SHARD_TOKENS = 1 << 20
#: Shards' files that a task keeps mapped.
OPEN = 512
#: The end of a text; no word holds white space.
END = xxhash.xxh64_intdigest(b"\n", 42)
#: One step of a quantised log10.
STEP = 0.05
#: Texts' bytes taken at once, and distinct n-grams that a task holds before it sends them.
BYTES, HELD = 8 << 20, 3_000_000


def quantise(log10: np.ndarray) -> np.ndarray:
    """Eight bits, rounded down, so that no context's probabilities add up to more than 1."""
    return np.clip(np.ceil(-log10 / STEP - 1e-9), 0, 255).astype(np.uint8)


def value(q: np.ndarray) -> np.ndarray:
    return q * -STEP


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of the distinct tokens, each token's place among them, tokens of each text), every text with its end."""
    flat_of = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    if isinstance(flat_of, pa.ChunkedArray):
        flat_of = flat_of.combine_chunks()
    flat, ends = flat_of.flatten(), flat_of.offsets.to_numpy()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(real)])[ends - ends[0]]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w, 42) for w in coded.dictionary.cast(pa.binary()).to_pylist()] + [END], dtype=np.uint64)
    index = coded.indices.to_numpy(zero_copy_only=False)
    n = np.diff(upto)
    out = np.full(len(index) + len(n), len(hashes) - 1, dtype=np.int64)
    out[np.arange(len(index)) + np.repeat(np.arange(len(n)), n)] = index
    return hashes, out, n + 1


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about equal size, of at most about BYTES of text; a text is never cut."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) if len(batch) else np.zeros(1)
    share = max(1, size[-1] // max(1, -(-size[-1] // BYTES)))
    at = 0
    while at < len(batch):
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + share, side="right")))
        yield batch.slice(at, end - at)
        at = end


class Tally:
    """Counts of 64-bit keys; sends what it holds, sorted, when it holds too much."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None) -> None:
        found, n = np.unique(keys, return_counts=True) if counts is None else (keys, counts)
        self.parts.append((found, n))
        self.held += len(found)
        if self.held > HELD and len(self.parts) > 1:
            self.parts = [self.merged()]
            self.held = len(self.parts[0][0])

    def merged(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        keys, n = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
        return keys[first], np.add.reduceat(n, first) if len(first) else n

    def full(self) -> bool:
        return self.held > HELD

    def clear(self) -> tuple[np.ndarray, np.ndarray]:
        out = self.merged()
        self.parts, self.held = [], 0
        return out


LOW = np.uint64(0xFFFFFFFF)


def shrink(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays as bytes: all first bytes, all second ones and so on, compressed."""
    little = [np.ascontiguousarray(a).astype(f"<u{a.dtype.itemsize}", copy=False) for a in arrays]
    shape = np.array([(a.dtype.itemsize, len(a)) for a in little], dtype="<u4").tobytes()
    planes = b"".join(a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in little)
    return bytes([len(arrays)]) + shape + zstandard.compress(planes, 1)


def grow(raw: bytes) -> list[np.ndarray]:
    """The arrays that ``shrink`` was given."""
    shape = np.frombuffer(raw, dtype="<u4", count=2 * raw[0], offset=1).reshape(-1, 2).tolist()
    body, at, out = np.frombuffer(zstandard.decompress(raw[1 + 8 * raw[0] :]), dtype=np.uint8), 0, []
    for size, n in shape:
        out.append(np.ascontiguousarray(body[at : at + size * n].reshape(size, n).T).view(f"<u{size}").reshape(-1))
        at += size * n
    return out


def _gaps(keys: np.ndarray) -> np.ndarray:
    return np.diff(keys, prepend=np.uint64(0))


def _sums(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps, dtype=np.uint64)


class Slice:
    """Some documents: ids, which are null, which are training ones, and their tokens."""

    def __init__(self, root: str, number: int):
        ids, null, train, lengths, self.hashes, index = grow(Files(root).load(f"slice-{number}", "blob")["blob"].tobytes())
        self.doc_ids, self.null, self.train = ids.view(np.int64), null.astype(bool), train.astype(bool)
        self.lengths, self.index = lengths.astype(np.int64), index.astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.inner = np.ones(len(self.index), dtype=bool)
        self.inner[self.starts] = False
        self.training = np.repeat(self.train, self.lengths)

    def numbers(self, trie: "Trie") -> np.ndarray:
        """The number of each token; the count of words for unknown ones."""
        ids = trie.ids(self.hashes)
        return np.where(ids < 0, trie.words, ids).astype(np.uint64)[self.index]


class Queries:
    """A slice's distinct triples in the order in which they are sent: by shard, then by context, then by third word.

    A text's second token has no word before its context's; an unknown word there is the same. Tokens after an unknown
    word have no query.
    """

    def __init__(self, s: Slice, ids: np.ndarray, trie: "Trie"):
        at = np.flatnonzero(s.inner)
        self.at = at = at[ids[at - 1] < trie.words]
        before = np.where(s.inner[at - 1], ids[at - 2], np.uint64(trie.words))
        contexts, inverse = np.unique(ids[at - 1] << np.uint64(32) | before, return_inverse=True)
        keys, self.inverse = np.unique(inverse.astype(np.uint64) << np.uint64(32) | ids[at], return_inverse=True)
        n = np.bincount(self.inverse, weights=s.training[at], minlength=len(keys)).astype(np.uint32)
        shard = trie.shard_of(contexts >> np.uint64(32), contexts & LOW)[(keys >> np.uint64(32)).astype(np.int64)]
        self.order = np.argsort(shard, kind="stable")
        keys = keys[self.order]
        self.shard, self.third, self.n = shard[self.order], (keys & LOW).astype(np.uint32), n[self.order]
        self.context = contexts[(keys >> np.uint64(32)).astype(np.int64)]

    def parts(self) -> Iterator[tuple[int, int, int]]:
        """(shard, begin, end)."""
        if len(self.shard):
            cuts = np.flatnonzero(np.concatenate([[True], self.shard[1:] != self.shard[:-1], [True]])).tolist()
            for a, b in zip(cuts, cuts[1:]):
                yield int(self.shard[a]), a, b

    def by_token(self, answers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.order), dtype=answers.dtype)
        out[self.order] = answers
        return out[self.inverse]


class Files:
    """Named arrays, published whole or not at all; a task that runs again writes the same files."""

    def __init__(self, root: str):
        self.root = root

    def save(self, name: str, arrays: dict[str, np.ndarray]) -> None:
        os.makedirs(self.root, exist_ok=True)
        for k, a in arrays.items():
            part = f"{self.root}/.{name}.{k}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
            with open(part, "wb") as f:
                np.save(f, a)
            os.replace(part, f"{self.root}/{name}.{k}.npy")

    def load(self, name: str, *keys: str) -> dict[str, np.ndarray]:
        return {k: np.asarray(np.load(f"{self.root}/{name}.{k}.npy", mmap_mode="r")) for k in keys}

    def sequence(self, name: str) -> Sequence:
        return Sequence(self.load(name, "meta", "low", "high", "zeros"))


class Trie:
    """The published trie. Shards are mapped when they are first asked for.

    Shards from 0 on belong to hash ranges of words; those after them to frequent words, 2 ** bits to each.
    """

    def __init__(self, root: str, bits: int, offsets: np.ndarray, total: int):
        self.root, self.bits, self.offsets, self.total = root, bits, offsets, total
        self.words, self.shards = int(offsets[-1]), len(offsets) - 1
        #: frequent words in order: number, first shard, bits, mass given to shorter contexts
        self.hot, self.hot_first, self.hot_bits, self.hot_back = (np.zeros(0, dtype=t) for t in (np.int64, np.int64, np.int64, np.uint8))
        self.all = self.shards
        #: shards that hold pairs and triples, and a bound of the places among successors
        self.with_pairs, self.with_triples, self.widest = frozenset(), frozenset(), 1
        self.files, self.open = Files(root), {}

    def __getstate__(self):
        return {**self.__dict__, "open": {}}

    def part(self, kind: str, shard: int):
        if (found := self.open.get((kind, shard))) is None:
            if len(self.open) >= OPEN:
                self.open.pop(next(iter(self.open)))
            keys = {"counts1": ("small", "at", "large"), "prob2": ("q",), "prob3": ("q",), "back1": ("q",), "back2": ("q",), "n2": ("n",), "wide2": ("n",)}
            name = f"{kind}-{shard}"
            found = self.files.load(name, *keys[kind]) if kind in keys else self.files.sequence(name)
            self.open[kind, shard] = found
        return found

    def heat(self, counts: dict[int, int], limit: int) -> None:
        """Gives shards of their own to these words, which occur more than limit times."""
        self.hot = np.array(sorted(counts), dtype=np.int64)
        self.hot_bits = np.ceil(np.log2([counts[w] / limit for w in self.hot.tolist()])).astype(np.int64)
        size = 1 << self.hot_bits
        self.hot_first, self.all = self.shards + np.cumsum(size) - size, self.shards + int(size.sum())
        self.hot_back = np.zeros(len(self.hot), dtype=np.uint8)

    def owner(self, shard: int) -> tuple[int, int]:
        """(first word, words) of a shard."""
        if shard < self.shards:
            return int(self.offsets[shard]), int(self.offsets[shard + 1] - self.offsets[shard])
        return int(self.hot[np.searchsorted(self.hot_first, shard, side="right") - 1]), 1

    def home(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, ids.astype(np.int64), side="right") - 1

    def _hot(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of frequent words in the array, their places in the list)."""
        if not len(self.hot):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        k = np.minimum(np.searchsorted(self.hot, words.astype(np.int64)), len(self.hot) - 1)
        at = np.flatnonzero(self.hot[k] == words.astype(np.int64))
        return at, k[at]

    def shard_of(self, words: np.ndarray, others: np.ndarray) -> np.ndarray:
        """The shard of pairs of these words and others that follow, or of contexts of others and these words after them."""
        out = self.home(words)
        at, k = self._hot(words)
        mixed = ((others[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64)
        out[at] = self.hot_first[k] + (mixed & ((1 << self.hot_bits[k]) - 1))
        return out

    def _by_shard(self, shard: np.ndarray, work: Callable[[int, np.ndarray], None]) -> None:
        order = np.argsort(shard, kind="stable")
        found, begin = np.unique(shard[order], return_index=True)
        for s, a, b in zip(found.tolist(), begin.tolist(), [*begin[1:].tolist(), len(order)]):
            work(s, order[a:b])

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words; -1 for unknown ones."""
        out = np.full(len(hashes), -1, dtype=np.int64)

        def work(s: int, at: np.ndarray) -> None:
            if self.offsets[s] < self.offsets[s + 1]:
                found = self.part("words1", s).find(hashes[at])
                out[at] = np.where(found >= 0, found + self.offsets[s], -1)

        self._by_shard((hashes >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(hashes), dtype=np.int64), work)
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of words by number; 0 for unknown ones."""
        out = np.zeros(len(ids), dtype=np.int64)
        known = np.flatnonzero((ids >= 0) & (ids < self.words))

        def work(s: int, at: np.ndarray) -> None:
            c, place = self.part("counts1", s), ids[known[at]].astype(np.int64) - self.offsets[s]
            n = c["small"][place].astype(np.int64)
            large = np.flatnonzero(n == 255)
            if len(large):
                n[large] = c["large"][np.searchsorted(c["at"], place[large])]
            out[known[at]] = n

        self._by_shard(self.home(ids[known]), work)
        return out

    def unigram(self, ids: np.ndarray) -> np.ndarray:
        found, back = np.unique(ids, return_inverse=True)
        return ((self.counts(found) + 1) / (self.total + self.words + 1))[back]

    def back(self, words: np.ndarray, shard: int) -> np.ndarray:
        """Quantised mass that words of this shard give to single words."""
        if shard >= self.shards:
            return np.full(len(words), self.hot_back[self._hot(words[:1])[1][0]] if len(words) else 0, dtype=np.int64)
        base, size = self.owner(shard)
        own = self.part("back1", shard)["q"] if shard in self.with_pairs else np.zeros(size, dtype=np.uint8)
        return own[words.astype(np.int64) - base].astype(np.int64)

    def pairs(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the first word's successors, quantised probability) of pairs; -1 for those not kept."""
        relative, q = np.full(len(first), -1, dtype=np.int64), np.full(len(first), -1, dtype=np.int64)
        known = np.flatnonzero(second < self.words)

        def work(s: int, some: np.ndarray) -> None:
            if s not in self.with_pairs:
                return
            at, (base, _) = known[some], self.owner(s)
            local = first[at].astype(np.int64) - base
            place = self.part("pairs2", s).find(local.astype(np.uint64) * np.uint64(self.words) + second[at].astype(np.uint64))
            hit = np.flatnonzero(place >= 0)
            words, back = np.unique(local[hit], return_inverse=True)
            away = place[hit] - self.part("pointers2", s).get(words).astype(np.int64)[back]
            if s >= self.shards:  # a place is unique over the word's shards
                k = np.searchsorted(self.hot_first, s, side="right") - 1
                away = (away << self.hot_bits[k]) + (s - self.hot_first[k])
            relative[at[hit]], q[at[hit]] = away, self.part("prob2", s)["q"][place[hit]]

        self._by_shard(self.shard_of(first[known], second[known]), work)
        return relative, q

    def publish(self, shard: int, keys: np.ndarray, n: np.ndarray, min_count: int) -> tuple[int, float]:
        """Publishes a shard's pairs, of sorted keys; returns (successors of one word at most, mass of the pairs)."""
        keys, n = keys[n >= min_count], n[n >= min_count]
        base, size = self.owner(shard)
        first, second = (keys >> np.uint64(32)).astype(np.int64) - base, (keys & LOW).astype(np.int64)
        begin = np.searchsorted(first, np.arange(size + 1))
        most = int(np.diff(begin).max()) if size else 0
        self.files.save(f"pairs2-{shard}", encode(first.astype(np.uint64) * np.uint64(self.words) + second.astype(np.uint64)))
        self.files.save(f"pointers2-{shard}", encode(begin.astype(np.uint64)))
        share = (n - DISCOUNT) / self.counts(np.arange(base, base + size))[first]
        if shard < self.shards:
            back = 1 - np.bincount(first, weights=share, minlength=size)
            self.files.save(f"back1-{shard}", {"q": quantise(np.log10(np.maximum(back, 1e-12)))})
            self.files.save(f"prob2-{shard}", {"q": quantise(np.log10(share + back[first] * self.unigram(second)))})
            self.files.save(f"wide2-{shard}", {"n": np.array([max(most, 1)])})
        else:  # the word's other shards hold the rest of its mass
            self.files.save(f"n2-{shard}", {"n": n.astype(np.uint32)})
        return most, float(share.sum())

    def wide(self, shard: int) -> np.uint64:
        """A bound of the places among successors."""
        return np.uint64(self.widest if shard >= self.shards else int(self.part("wide2", shard)["n"][0]))

    def build(self, shard: int, contexts: np.ndarray, context: np.ndarray, n: np.ndarray, relative: np.ndarray, lower: np.ndarray, min_count: int) -> None:
        """Publishes the contexts and triples of a shard: sorted contexts, and for each triple its context's place, counts and pair."""
        base, _ = self.owner(shard)
        total = np.bincount(context, weights=n, minlength=len(contexts))
        kept = ((contexts & LOW) < self.words) & (total >= max(min_count, 1))
        place = np.cumsum(kept) - 1
        keys = ((contexts >> np.uint64(32)) - np.uint64(base)) * np.uint64(self.words + 1) + (contexts & LOW)
        self.files.save(f"contexts2-{shard}", encode(keys[kept]))
        mine = np.flatnonzero(kept[context] & (n >= max(min_count, 1)))
        spot = place[context[mine]]
        share = (n[mine] - DISCOUNT) / total[context[mine]]
        back = 1 - np.bincount(spot, weights=share, minlength=int(kept.sum()))
        self.files.save(f"back2-{shard}", {"q": quantise(np.log10(np.maximum(back, 1e-12)))})
        prob = quantise(np.log10(share + back[spot] * 10 ** value(lower[mine].astype(float))))
        keys = spot.astype(np.uint64) * self.wide(shard) + relative[mine].astype(np.uint64)
        order = np.argsort(keys)
        self.files.save(f"triples3-{shard}", encode(keys[order]))
        self.files.save(f"prob3-{shard}", {"q": prob[order]})

    def answer(self, shard: int, contexts: np.ndarray, context: np.ndarray, relative: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """For each triple its quantised log10; with ANEW, that of the way to the single word, whose own is still to be added."""
        base, _ = self.owner(shard)
        words = contexts >> np.uint64(32)
        keys = (words - np.uint64(base)) * np.uint64(self.words + 1) + (contexts & LOW)
        held = shard in self.with_triples
        place = self.part("contexts2", shard).find(keys) if held else np.full(len(keys), -1, dtype=np.int64)
        found = np.flatnonzero(place >= 0)
        fall = np.zeros(len(keys), dtype=np.int64)
        fall[found] = self.part("back2", shard)["q"][place[found]] if held else 0
        out = np.where(lower >= 0, lower + fall[context], ANEW + self.back(words, shard)[context] + fall[context])
        able = np.flatnonzero((place[context] >= 0) & (relative >= 0))
        at = self.part("triples3", shard).find(place[context[able]].astype(np.uint64) * self.wide(shard) + relative[able].astype(np.uint64)) if held else np.zeros(0, dtype=np.int64)
        hit = np.flatnonzero(at >= 0)
        out[able[hit]] = self.part("prob3", shard)["q"][at[hit]] if held else 0
        return out.astype(np.uint16)


#: Marks an answer to which the third word's own probability is to be added.
ANEW = 1 << 15


def _local(path: str) -> str:
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"the trie's files are mapped into memory; {path} isn't a mounted folder. Pass one that all executors share as `folder`")
    return unquote(parsed.path)


def _frame(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}
    columns = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(columns)], [name for name, _ in columns])


class Cut:
    """Documents cut into tokens: slices published as files in the shared folder, and a table (slice, training) of their numbers and training tokens."""

    def __init__(self, docs: DataFrame, doc_id: str, text: str, training: Column):
        root = _local(shared_path(docs.sparkSession, "slices"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            number = TaskContext.get().partitionId() << 32
            for batch in batches:
                for b in _slices(batch, 2):
                    hashes, index, lengths = tokens(b.column(2))
                    ids = pc.fill_null(b.column(0), 0).to_numpy(zero_copy_only=False).view(np.uint64)
                    null, train = (x.to_numpy(zero_copy_only=False).astype(np.uint8) for x in (b.column(0).is_null(), b.column(1)))
                    blob = shrink(ids, null, train, lengths.astype(np.uint64), hashes, index.astype(np.uint32))
                    Files(root).save(f"slice-{number}", {"blob": np.frombuffer(blob, dtype=np.uint8)})
                    yield _frame([(number, int(lengths[train > 0].sum()))], "slice long, training long")
                    number += 1

        rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(training, F.lit(False)).alias("training"), F.col(text).alias("text"))
        self.root, self.table = root, stored(rows.mapInArrow(run, "slice long, training long"), "slices")
        size = self.table.agg(F.count("*").alias("n"), F.coalesce(F.sum("training"), F.lit(0)).alias("training")).first()
        self.total = int(size["training"])
        #: tasks of a pass over the slices: one for each, or for eight of them where they are many
        self.tasks = max(1, min(size["n"], 1024), size["n"] // 8)

    def each(self, work: Callable[[Iterator[tuple[int, Slice]]], Iterator[tuple]], schema: str) -> DataFrame:
        """work over (number, slice), the numbers dealt evenly."""
        root = self.root
        return _each(self.table.select("slice").repartition(self.tasks), lambda rows: work((n, Slice(root, n)) for (n,) in rows), schema)


BLOBS = "shard long, slice long, blob binary"


def _each(frame: DataFrame, work: Callable[[Iterator[tuple]], Iterator[tuple]], schema: str, some: int = 64) -> DataFrame:
    """work over the rows of each partition, whose results go out in small batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in work(row for b in batches for row in zip(*(c.to_pylist() for c in b.columns))):
            held.append(row)
            if len(held) >= some:
                yield _frame(held, schema)
                held = []
        yield _frame(held, schema)

    return frame.mapInArrow(run, schema)


def _level1(cut: Cut, root: str) -> Trie:
    """Words in order of their hash, with their counts."""
    bits = max(0, math.ceil(math.log2(max(cut.total, 1) / SHARD_TOKENS)))
    shards, limit = 1 << bits, SHARD_TOKENS // 4

    def send(rows: Iterator[tuple]) -> Iterator[tuple]:
        tally = Tally()

        def out() -> Iterator[tuple]:
            keys, n = tally.clear()
            cuts = np.searchsorted(keys >> np.uint64(64 - bits), np.arange(shards + 1)).tolist() if bits else [0, len(keys)]
            return ((m, 0, shrink(_gaps(keys[a:b]), n[a:b].astype(np.uint32))) for m, (a, b) in enumerate(zip(cuts, cuts[1:])) if a < b)

        for _, s in rows:
            n = np.bincount(s.index[s.training], minlength=len(s.hashes))
            order = np.argsort(s.hashes)
            order = order[n[order] > 0]
            tally.add(s.hashes[order], n[order])
            if tally.full():
                yield from out()
        yield from out()

    def publish(m: int, keys: np.ndarray, n: np.ndarray) -> Iterator[tuple]:
        """A row for the shard, and one for each word that is too frequent for it: at most total / limit of them."""
        files, large = Files(root), np.flatnonzero(n >= 255)
        files.save(f"words1-{m}", encode(keys))
        files.save(f"counts1-{m}", {"small": np.minimum(n, 255).astype(np.uint8), "at": large, "large": n[large]})
        yield m, len(keys), -1, 0
        for place in np.flatnonzero(n > limit).tolist():
            yield m, len(keys), place, int(n[place])

    def gather(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, tally = None, Tally()
        for m, _, raw in rows:
            if m != held:
                if held is not None:
                    yield from publish(held, *tally.clear())
                held = m
            gaps, n = grow(raw)
            tally.add(_sums(gaps), n.astype(np.int64))
        if held is not None:
            yield from publish(held, *tally.clear())

    dealt = cut.each(send, BLOBS).repartition(shards, "shard").sortWithinPartitions("shard")
    rows = _each(dealt, gather, "shard long, size long, place long, n long").collect()
    sizes = {r["shard"]: r["size"] for r in rows}
    trie = Trie(root, bits, np.concatenate([[0], np.cumsum([sizes.get(s, 0) for s in range(shards)])]).astype(np.int64), cut.total)
    trie.heat({int(trie.offsets[r["shard"]]) + r["place"]: r["n"] for r in rows if r["place"] >= 0}, limit)
    return trie


def _hot_pairs(cut: Cut, trie: Trie, min_count: int) -> None:
    """The pairs of frequent words, which their triples' shards have to know: each of a word's shards holds a part of them."""
    if not len(trie.hot):
        return

    def send(rows: Iterator[tuple]) -> Iterator[tuple]:
        tallies: dict[int, Tally] = {}
        out = lambda: [(s, 0, shrink(_gaps(k), n.astype(np.uint32))) for s, t in tallies.items() if t.held for k, n in [t.clear()]]
        for _, s in rows:
            ids = s.numbers(trie)
            at = np.flatnonzero(s.inner & s.training)
            at = at[trie._hot(ids[at - 1])[0]]
            keys, n = np.unique(ids[at - 1] << np.uint64(32) | ids[at], return_counts=True)
            trie._by_shard(trie.shard_of(keys >> np.uint64(32), keys & LOW), lambda m, some: tallies.setdefault(m, Tally()).add(keys[some], n[some]))
            if sum(t.held for t in tallies.values()) > HELD:
                yield from out()
        yield from out()

    def gather(rows: Iterator[tuple]) -> Iterator[tuple]:
        held, tally = None, Tally()
        for m, _, raw in rows:
            if m != held:
                if held is not None:
                    yield (held, *trie.publish(held, *tally.clear(), min_count))
                held = m
            gaps, n = grow(raw)
            tally.add(_sums(gaps), n.astype(np.int64))
        if held is not None:
            yield (held, *trie.publish(held, *tally.clear(), min_count))

    dealt = cut.each(send, BLOBS).repartition(trie.all - trie.shards, "shard").sortWithinPartitions("shard")
    rows = _each(dealt, gather, "shard long, most long, mass double").collect()  # a row for each of these shards
    trie.with_pairs = frozenset(r["shard"] for r in rows)
    place = lambda m: int(np.searchsorted(trie.hot_first, m, side="right")) - 1
    back = np.ones(len(trie.hot))
    for r in rows:
        back[place(r["shard"])] -= r["mass"]
        trie.widest = max(trie.widest, r["most"] << int(trie.hot_bits[place(r["shard"])]))
    trie.hot_back = quantise(np.log10(np.maximum(back, 1e-12)))
    counts = trie.counts(trie.hot)

    def finish(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (m,) in rows:
            if m in trie.with_pairs:
                second = (trie.part("pairs2", m).values() % np.uint64(trie.words)).astype(np.int64)
                prob = (trie.part("n2", m)["n"] - DISCOUNT) / counts[place(m)] + back[place(m)] * trie.unigram(second)
                trie.files.save(f"prob2-{m}", {"q": quantise(np.log10(prob))})
            yield (m,)

    own = cut.table.sparkSession.range(trie.shards, trie.all, 1, max(1, (trie.all - trie.shards) // 4)).select(F.col("id").alias("shard"))
    _each(own, finish, "shard long").count()


def _exchange(cut: Cut, trie: Trie, build: bool, answer: bool, min_count: int = MIN_COUNT) -> DataFrame:
    """(shard, slice, blob): answers to the slices' triples, from shards that are built of these first if so asked.

    A row of slice -1 stands for each shard that holds triples.
    """

    def send(rows: Iterator[tuple]) -> Iterator[tuple]:
        for number, s in rows:
            if not answer:
                s.inner &= s.training
            q = Queries(s, s.numbers(trie), trie)
            for m, a, b in q.parts():
                yield m, number, shrink(_gaps(q.context[a:b]), q.third[a:b], q.n[a:b])

    def shard(m: int, held: list[tuple]) -> Iterator[tuple]:
        """A frequent word's pairs are published before; any other word's are the sums of its triples."""
        contexts, context = np.unique(np.concatenate([h[1] for h in held]), return_inverse=True)
        keys, inverse = np.unique(context.astype(np.uint64) << np.uint64(32) | np.concatenate([h[2] for h in held]).astype(np.uint64), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([h[3] for h in held]), minlength=len(keys))
        sizes = [(h[0], len(h[1])) for h in held]
        held.clear()
        context, third = (keys >> np.uint64(32)).astype(np.int64), keys & LOW
        pairs, back = np.unique(contexts[context] & ~LOW | third, return_inverse=True)
        del keys, third
        if build and m < trie.shards:
            seen = np.bincount(back, weights=n, minlength=len(pairs))
            trie.publish(m, pairs[seen > 0], seen[seen > 0], min_count)
            trie.with_pairs |= {m}
        relative, lower = (x[back] for x in trie.pairs(pairs >> np.uint64(32), pairs & LOW))
        del pairs, back
        if build:
            trie.build(m, contexts, context, n, relative, lower, min_count)
            trie.with_triples |= {m}
            yield m, -1, None
        if answer:
            found, at = trie.answer(m, contexts, context, relative, lower)[inverse], 0
            for number, size in sizes:
                yield m, number, shrink(found[at : at + size])
                at += size

    def gather(rows: Iterator[tuple]) -> Iterator[tuple]:
        at, held = None, []
        for m, number, raw in rows:
            if m != at and held:
                yield from shard(at, held)
            at = m
            gaps, third, n = grow(raw)
            held.append((number, _sums(gaps), third, n))
        if held:
            yield from shard(at, held)

    dealt = cut.each(send, BLOBS).repartition(trie.all, "shard").sortWithinPartitions("shard")
    return _each(dealt, gather, BLOBS)


def _scored(cut: Cut, answers: DataFrame, trie: Trie) -> DataFrame:
    """Each slice's tokens with the answers to its triples: a row for each document."""

    def texts(s: Slice, found: list[np.ndarray]) -> Iterator[tuple]:
        ids = s.numbers(trie)
        distinct, back = np.unique(ids, return_inverse=True)
        base = np.log10(trie.unigram(distinct))[back]
        logs, q = base.copy(), Queries(s, ids, trie)
        if len(q.at):
            mine = q.by_token(np.concatenate(found))
            logs[q.at] = value((mine & (ANEW - 1)).astype(float)) + np.where(mine & ANEW, base[q.at], 0.0)
        sums = lambda x: np.add.reduceat(x, s.starts).tolist()
        known = sums((ids < trie.words).astype(np.int64))
        for d, null, n, k, b, x in zip(s.doc_ids.tolist(), s.null.tolist(), s.lengths.tolist(), known, sums(base), sums(logs)):
            yield None if null else d, n, k, trie.total, b, x

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: int | None = None
        found: list[np.ndarray] = []
        for shard, number, raw in rows:
            if shard == -1:
                if held is not None:
                    yield from texts(Slice(root, held), found)
                held, found = number, []
            else:
                found.append(grow(raw)[0])
        if held is not None:
            yield from texts(Slice(root, held), found)

    root = cut.root
    both = cut.table.select(F.lit(-1).cast("long").alias("shard"), "slice", F.lit(None).cast("binary").alias("blob")).union(answers.where("slice >= 0").select("shard", "slice", "blob"))
    return _each(both.repartition(cut.tasks, "slice").sortWithinPartitions("slice", "shard"), run, SCORED, 10_000)


SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _trained(cut: Cut, folder: str | None, min_count: int) -> Trie:
    trie = _level1(cut, _local(folder or shared_path(cut.table.sparkSession, "trie")))
    _hot_pairs(cut, trie, min_count)
    return trie


def train(docs: DataFrame, text: str = "text", folder: str | None = None, min_count: int = MIN_COUNT) -> Trie:
    """The trie over all texts of docs (null: empty), published in folder or else in the shared folder.

    Pairs and triples seen less than min_count times give their mass to their shorter context; by default none does.

    The driver sees a row of sizes for each shard, and the words that are too frequent for one. Every stage's task can
    run again: files are replaced whole.
    """
    cut = Cut(docs.select(F.lit(None).alias("doc_id"), text), "doc_id", text, F.lit(True))
    trie = _trained(cut, folder, min_count)
    built = _exchange(cut, trie, build=True, answer=False, min_count=min_count).select("shard").collect()
    trie.with_triples = frozenset(r["shard"] for r in built)
    trie.with_pairs |= {m for m in trie.with_triples if m < trie.shards}
    return trie


def score(docs: DataFrame, trie: Trie, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score), log10 of each text's probability with its end.

    Null and empty texts are an end alone. Repeated rows are scored each; texts of any length are scored whole. An
    untrained model gives every token the share of an unknown one. An empty table gives no rows. Columns of docs other
    than the two named don't matter.
    """
    cut = Cut(docs, doc_id, text, F.lit(False))
    return _scored(cut, _exchange(cut, trie, build=False, answer=True), trie)


def train_and_score(docs: DataFrame, training: Column, doc_id: str = "doc_id", text: str = "text", folder: str | None = None, min_count: int = MIN_COUNT) -> DataFrame:
    """As ``train`` on the rows where training holds and ``score`` on all rows, with one exchange of triples for both."""
    cut = Cut(docs, doc_id, text, training)
    trie = _trained(cut, folder, min_count)
    return _scored(cut, _exchange(cut, trie, build=True, answer=True, min_count=min_count), trie)


def op9_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = train_and_score(read(spark, sf_dir, "documents", "doc_id", "text"), ~held_out("doc_id", 7))
    return scored.select("doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
