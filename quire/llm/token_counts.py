"""Exact token counts at every prefix of a text, by dynamic programming.

In a piece that merges never leave, the encoding of a prefix ends in exactly one token: the one that is compatible with
the last token of the prefix before it. So one pass over a piece gives the last token and the count of each of its
prefixes, without encoding any of them; a document's counts are those of its pieces added up. Truncation to a budget and
counting a prefix are then lookups.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import read
from quire.llm.pretokens import SPACE, pieces, vocabulary

FILE = "byte_bpe_50k.json"
LIMIT = 512
#: Pieces in one generation of a task's memory; four times as many pairs.
MEMORY = 300_000
#: A run of white space before other text: its last character belongs to what follows, unless the text ends there.
_RUN = re.compile(f"[{SPACE}]{{2,}}(?=[^{SPACE}])")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class Counter:
    """Prefix counts under one vocabulary file; remembers pieces and pairs up to a bound."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = byte_characters()
        raw = lambda t: bytes(back[c] for c in t)
        self.special = [t["content"] for t in spec["added_tokens"] if t["special"]]
        pairs = [tuple(map(raw, m.split(" ") if isinstance(m, str) else m)) for m in spec["model"]["merges"]]
        # tokens by the rank of their merge: single bytes first
        self.raw = [bytes([b]) for b in range(256)] + [a + b for a, b in pairs]
        self.tokens = {t: k for k, t in enumerate(self.raw)}
        self.parts = [(k, k) for k in range(256)] + [(self.tokens[a], self.tokens[b]) for a, b in pairs]
        self.joined = {x << 32 | y: 256 + k for k, (x, y) in enumerate(self.parts[256:])}
        self.longest = max(map(len, self.tokens))
        self.cutter = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.valid: dict[int, bool] = {}
        # two generations: when the young one is full it becomes the old one, so that what is in use stays
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        #: the last piece, the last token and the count at each of its prefixes
        self.state: tuple[bytes, list[int], list[int]] = (b"", [-1], [0])

    def follows(self, a: int, b: int) -> bool:
        """Whether token b may stand after token a (after nothing, if a is -1): whether no merge across their border comes first.

        The border's two sides are undone, the later merge first; a merge across it that ranks before the one last undone
        would have happened instead.
        """
        if len(self.valid) >= 4 * MEMORY:
            self.valid.clear()
        key = a << 32 | b
        limit = len(self.raw)
        while a >= 0:
            if self.joined.get(a << 32 | b, limit) < limit:
                self.valid[key] = False
                return False
            if max(a, b) < 256:
                break
            if a > b:
                limit, a = a, self.parts[a][1]
            else:
                limit, b = b + 1, self.parts[b][0]
        self.valid[key] = True
        return True

    def prefixes(self, raw: bytes) -> list[int]:
        """Counts at each byte of a piece. What it shares with the piece before is taken over, as it holds at every prefix."""
        before, last, counts = self.state
        shared = 0
        for x, y in zip(before, raw):
            if x != y:
                break
            shared += 1
        del last[shared + 1 :], counts[shared + 1 :]
        find, valid, longest = self.tokens.get, self.valid.get, self.longest
        for i in range(shared + 1, len(raw) + 1):
            for j in range(max(0, i - longest), i):
                if (t := find(raw[j:i])) is not None:
                    a = last[j]
                    if (ok := valid(a << 32 | t)) is None:
                        ok = self.follows(a, t)
                    if ok:
                        last.append(t)
                        counts.append(counts[j] + 1)
                        break
            else:
                self.state = (b"", [-1], [0])
                raise ValueError(f"no token ends at byte {i} of {raw!r}")
        self.state = (raw, last, counts)
        return counts[1:]

    def learn(self, cut: list[list[str]]) -> None:
        """Counts of the pieces of many texts, those that begin alike one after another."""
        missing = {p for ps in cut for p in ps}.difference(self.young)
        for p in sorted(missing):
            self.piece(p)

    def piece(self, piece: str) -> bytes:
        """Counts at each character of a piece, as unsigned 32-bit integers."""
        if (found := self.young.get(piece)) is not None:
            return found
        if (found := self.old.get(piece)) is None:
            raw = piece.encode()
            counts = self.prefixes(raw)
            if len(raw) != len(piece):
                counts = [n for n, following in zip(counts, raw[1:] + b"a") if following & 0xC0 != 0x80]
            if piece in ("'re", "'ve", "'ll"):
                counts[1] = 2  # half a contraction is an apostrophe and a letter
            found = array("I", counts).tobytes()
        if len(self.young) >= MEMORY:
            self.old, self.young = self.young, {}
        self.young[piece] = found
        return found

    def _ordinary(self, text: str, cut: list[str] | None = None) -> np.ndarray:
        cut = pieces(text) if cut is None else cut
        if not cut:
            return np.zeros(0, dtype=np.int64)
        raw = list(map(self.young.get, cut))
        if None in raw:
            raw = [self.piece(p) if r is None else r for r, p in zip(raw, cut)]
        counts = np.frombuffer(b"".join(raw), dtype=np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, cut), dtype=np.int64, count=len(cut))
        ends = np.cumsum(lengths)
        upto = np.cumsum(counts[ends - 1])
        counts += np.repeat(upto - counts[ends - 1], lengths)
        for m in _RUN.finditer(text):
            a, b = m.span()
            counts[b - 1] = (counts[a - 1] if a else 0) + int(np.frombuffer(self.piece(m[0])[-4:], dtype=np.uint32)[0])
        return counts

    def many(self, texts: list[str]) -> list[np.ndarray]:
        """counts of each text."""
        cut = [pieces(t) for t in texts]
        self.learn(cut)
        special = self.cutter.search if self.cutter else lambda _: None
        return [self.counts(t) if special(t) else self._ordinary(t, ps) for t, ps in zip(texts, cut)]

    def counts(self, text: str) -> np.ndarray:
        """The number of tokens of text[: k + 1], for each k. A special token's string is one token once it is whole."""
        if not self.cutter or not self.cutter.search(text):
            return self._ordinary(text)
        parts, base, before, at = [], 0, "", 0
        for k, part in enumerate(self.cutter.split(text)):
            if k % 2 == 0:
                own = self._ordinary(part)
                parts.append(base + own)
                before, at = part, base
                base += int(own[-1]) if len(own) else 0
            else:  # begun, its characters are ordinary text after what stands before
                parts.append(np.append(at + self._ordinary(before + part[:-1])[len(before) :], base + 1))
                base += 1
        return np.concatenate(parts)


def fitting(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix of at most budget tokens."""
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def prefix_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, counts): the number of tokens at each character of the text. Null and empty texts have no counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([counter.counts(t or "").astype(np.int32) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "counts"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, counts array<int>")


def token_counts(docs: DataFrame, path: str, limit: int = LIMIT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars), answered from each row's prefix counts.

    fit_chars is the length of the longest prefix within the limit. A null text counts as empty: no bytes, no tokens,
    not over. Repeated rows are counted each; texts of any length are counted whole; an empty table gives no rows.
    Columns of docs other than the two named don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(path)
        for whole in batches:
            for at in range(0, len(whole), 1000):
                b = whole.slice(at, 1000)
                texts = [t or "" for t in b.column(1).to_pylist()]
                found = [(len(t.encode()), int(c[-1]) if len(c) else 0, fitting(c, limit)) for t, c in zip(texts, counter.many(texts))]
                size, n, fit = (pa.array([x[k] for x in found], pa.int64()) for k in range(3))
                yield pa.RecordBatch.from_arrays([b.column(0), size, n, pa.array([x[1] > limit for x in found], pa.bool_()), fit], ["doc_id", "n_bytes", "n_tokens", "over_limit", "fit_chars"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean, fit_chars long"
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(FILE))
