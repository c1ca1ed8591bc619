"""Byte-level BPE in DuckDB, in each Spark task over its own documents.

Encoding: the distinct pieces of a batch become rows (word, position, token), starting from single bytes. A recursive
query joins each neighbouring pair with the merge table and contracts the leftmost pair of the smallest rank in every
word, until no word has a pair left; in long pieces the pair's other copies go in the same round where that is the same. Decoding joins token rows with the vocabulary and aggregates them in order.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import read
from quire.llm.pretokens import pieces, vocabulary

FILE = "byte_bpe_multi_50k.tiktoken"
#: Pieces in one recursive query, pieces in one generation of a task's memory, and tokens in one decoding query.
CHUNK, MEMORY, DECODED = 50_000, 300_000, 2_000_000
#: Bytes of a piece from which it counts as long and as very long, and bytes of long pieces in one query.
LONG, HUGE, LONG_BYTES = 256, 16_384, 200_000

#: Positions stay without gaps, so the contracted pair's second token is the one after its place.
MERGE = """
WITH RECURSIVE state(round, word, pos, tok) AS (
  SELECT 0, word, pos, tok FROM start
  UNION ALL
  (WITH found AS (
    SELECT s.word, min(merged << 32 | s.pos) AS best
    FROM state s JOIN state n ON n.word = s.word AND n.pos = s.pos + 1 JOIN merges ON pair = s.tok << 16 | n.tok GROUP BY s.word
  ), spot AS (SELECT word, best >> 32 AS merged, best & 4294967295 AS place FROM found)
  SELECT round + 1, s.word, CASE WHEN pos > place THEN pos - 1 ELSE pos END, CASE WHEN pos = place THEN merged ELSE tok END
  FROM state s JOIN spot ON spot.word = s.word WHERE pos <> place + 1)
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM state JOIN (SELECT word AS w, max(round) AS last FROM state GROUP BY word) ON word = w AND round = last
GROUP BY word ORDER BY word
"""
#: The same for long pieces, which would need a round for each contraction. A round contracts the copies of the pair from
#: the left, as they would follow each other, up to the first that makes a pair of a smaller rank with a neighbour; that
#: pair comes first in the next round. Positions are byte offsets here, and the next token stands a token's length
#: further on. A run of one token is contracted at every other place.
MERGE_LONG = """
WITH RECURSIVE state(round, word, pos, len, tok) AS (
  SELECT 0, word, pos, 1::BIGINT, tok FROM start
  UNION ALL
  (WITH pairs AS MATERIALIZED (
    SELECT s.word, s.pos, s.len, n.pos AS after, n.len AS more, merged, s.tok = n.tok AS twin
    FROM state s JOIN state n ON n.word = s.word AND n.pos = s.pos + s.len JOIN merges ON pair = s.tok << 16 | n.tok
  ), best AS MATERIALIZED (SELECT word, min(merged) AS best FROM pairs GROUP BY word
  ), copies AS MATERIALIZED (SELECT p.* FROM pairs p JOIN best ON best.word = p.word AND merged = best
  ), apart AS (
    SELECT word, pos, after, more, merged FROM copies WHERE NOT twin
    UNION ALL
    SELECT word, pos, after, more, merged
    FROM (SELECT *, pos - len * row_number() OVER (PARTITION BY word ORDER BY pos) AS run FROM copies WHERE twin)
    QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1
  ), beside AS (
    SELECT c.*, least(l.merged, r.merged, d.merged) < c.merged AS lower
    FROM apart c LEFT JOIN state x ON x.word = c.word AND x.pos + x.len = c.pos LEFT JOIN state y ON y.word = c.word AND y.pos = c.after + c.more
    LEFT JOIN merges l ON l.pair = x.tok << 16 | c.merged LEFT JOIN merges r ON r.pair = c.merged << 16 | y.tok
    LEFT JOIN merges d ON d.pair = c.merged << 16 | c.merged
  ), taken AS MATERIALIZED (
    SELECT word, pos, after, more, merged FROM beside
    QUALIFY coalesce(sum(lower::INT) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
  ), changed AS (SELECT word, pos, more, merged FROM taken UNION ALL SELECT word, after, NULL, -1 FROM taken)
  SELECT round + 1, s.word, s.pos, s.len + coalesce(more, 0), coalesce(merged, s.tok)
  FROM state s SEMI JOIN best ON best.word = s.word LEFT JOIN changed e ON e.word = s.word AND e.pos = s.pos WHERE coalesce(merged, 0) >= 0)
)
SELECT word, list(tok ORDER BY pos) AS ids
FROM state JOIN (SELECT word AS w, max(round) AS last FROM state GROUP BY word) ON word = w AND round = last
GROUP BY word ORDER BY word
"""
#: The same for very long pieces, of which no round but the last one is held: a round gives only the rows that change, by
#: their key, and a token that was contracted into the one before it stays as -1.
MERGE_HUGE = """
WITH RECURSIVE state(word, pos, len, tok) USING KEY (word, pos) AS (
  SELECT word, pos, 1::BIGINT, tok FROM start
  UNION
  (WITH live AS MATERIALIZED (SELECT * FROM recurring.state WHERE tok >= 0
  ), pairs AS MATERIALIZED (
    SELECT s.word, s.pos, s.len, n.pos AS after, n.len AS more, merged, s.tok = n.tok AS twin
    FROM live s JOIN live n ON n.word = s.word AND n.pos = s.pos + s.len JOIN merges ON pair = s.tok << 16 | n.tok
  ), best AS MATERIALIZED (SELECT word, min(merged) AS best FROM pairs GROUP BY word
  ), copies AS MATERIALIZED (SELECT p.* FROM pairs p JOIN best ON best.word = p.word AND merged = best
  ), apart AS (
    SELECT word, pos, len, after, more, merged FROM copies WHERE NOT twin
    UNION ALL
    SELECT word, pos, len, after, more, merged
    FROM (SELECT *, pos - len * row_number() OVER (PARTITION BY word ORDER BY pos) AS run FROM copies WHERE twin)
    QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1
  ), beside AS (
    SELECT c.*, least(l.merged, r.merged, d.merged) < c.merged AS lower
    FROM apart c LEFT JOIN live x ON x.word = c.word AND x.pos + x.len = c.pos LEFT JOIN live y ON y.word = c.word AND y.pos = c.after + c.more
    LEFT JOIN merges l ON l.pair = x.tok << 16 | c.merged LEFT JOIN merges r ON r.pair = c.merged << 16 | y.tok
    LEFT JOIN merges d ON d.pair = c.merged << 16 | c.merged
  ), taken AS MATERIALIZED (
    SELECT word, pos, len, after, more, merged FROM beside
    QUALIFY coalesce(sum(lower::INT) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0
  )
  SELECT word, pos, len + more, merged FROM taken UNION ALL SELECT word, after, 0::BIGINT, -1::BIGINT FROM taken)
)
SELECT word, list(tok ORDER BY pos) AS ids FROM state WHERE tok >= 0 GROUP BY word ORDER BY word
"""
DECODE = "SELECT doc, string_agg(bytes, '' ORDER BY pos) AS bytes FROM tokens JOIN vocabulary USING (id) GROUP BY doc ORDER BY doc"


class Codec:
    """One task's connection, with the merge table and the vocabulary."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "max_temp_directory_size": "0KB"})
        rows = [(ranks[a] << 16 | ranks[b], r) for t, r in ranks.items() for k in range(1, len(t)) if (a := t[:k]) in ranks and (b := t[k:]) in ranks]
        table = pa.table({"pair": pa.array([x[0] for x in rows], pa.int64()), "merged": pa.array([x[1] for x in rows], pa.int64())})
        self._create("merges", table)
        # a byte is held as the character of the same number, as ordered aggregation takes strings
        self._create("vocabulary", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "bytes": [t.decode("latin-1") for t in ranks]}))
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        # two generations: when the young one is full it becomes the old one, so that what is in use stays
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _create(self, name: str, table: pa.Table) -> None:
        self.con.register("_given", table)
        self.con.execute(f"CREATE TABLE {name} AS SELECT * FROM _given")
        self.con.unregister("_given")

    def _learn(self, words: list[str]) -> None:
        short, long = [], []
        for w in words:
            (long if len(w) >= LONG // 4 and len(w.encode()) >= LONG else short).append(w)
        for k in range(0, len(short), CHUNK):
            self._merge(MERGE, short[k : k + CHUNK])
        size, some = 0, []
        for w in sorted(long, key=len):
            if len(w) >= HUGE // 4 and len(w.encode()) >= HUGE:
                self._merge(MERGE_HUGE, [w])
                continue
            if some and size + len(w) > LONG_BYTES:
                self._merge(MERGE_LONG, some)
                size, some = 0, []
            some.append(w)
            size += len(w)
        if some:
            self._merge(MERGE_LONG, some)

    def _merge(self, query: str, chunk: list[str]) -> None:
        raw = [w.encode() for w in chunk]
        lengths = np.array([len(r) for r in raw])
        tok = self.single[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        word = np.repeat(np.arange(len(raw), dtype=np.int32), lengths)
        pos = np.arange(len(tok)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.con.register("start", pa.table({"word": word, "pos": pos, "tok": tok.astype(np.int64)}))
        ids = self.con.sql(query).to_arrow_table().column("ids").combine_chunks()
        flat, ends = ids.flatten().to_numpy().astype("<u4").tobytes(), ids.offsets.to_numpy() * 4
        self.young.update((w, flat[a:b]) for w, a, b in zip(chunk, ends.tolist(), ends[1:].tolist()))
        self.con.unregister("start")

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        cut = [pieces(t) for t in texts]
        if len(self.young) >= MEMORY:
            self.old, self.young = self.young, {}
        missing = {w for ws in cut for w in ws}.difference(self.young)
        self.young.update((w, self.old[w]) for w in missing & self.old.keys())
        self._learn(list(missing.difference(self.old)))
        return [b"".join(map(self.young.__getitem__, ws)) for ws in cut]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        out, k = [b""] * len(ids), 0
        while k < len(ids):
            some, n = [], 0
            while k < len(ids) and (not some or n + len(ids[k]) // 4 <= DECODED):
                some.append(k)
                n += len(ids[k]) // 4
                k += 1
            lengths = np.array([len(ids[i]) // 4 for i in some])
            flat = np.frombuffer(b"".join(ids[i] for i in some), dtype="<u4").astype(np.int32)
            pos = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            self.con.register("tokens", pa.table({"doc": np.repeat(np.array(some, dtype=np.int32), lengths), "pos": pos.astype(np.int32), "id": flat}))
            for doc, text in self.con.execute(DECODE).fetchall():
                out[doc] = text.encode("latin-1")
            self.con.unregister("tokens")
        return out


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", digests: bool = False) -> DataFrame:
    """(doc_id, ids binary, decoded binary) for each row, or their digests (doc_id, n_tokens, ids_sha256, decoded_sha256).

    A null text counts as empty and has no ids; each row stands for itself, repeated or not; a text of any length is
    encoded whole. Special tokens are ordinary text. Texts are cut by piece, so memory follows the batch and its pieces.
    An empty table gives no rows; columns of docs other than the two named don't matter.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digests else "doc_id long, ids binary, decoded binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(path)
        for whole in batches:
            for k in range(0, len(whole), 500):
                b = whole.slice(k, 500)
                ids = codec.encode([t or "" for t in b.column(1).to_pylist()])
                back = codec.decode(ids)
                if digests:
                    sha = lambda xs: pa.array([hashlib.sha256(x).hexdigest() for x in xs], pa.string())
                    columns = [pa.array([len(x) // 4 for x in ids], pa.int64()), sha(ids), sha(back)]
                else:
                    columns = [pa.array(ids, pa.binary()), pa.array(back, pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents", "doc_id", "text"), vocabulary(FILE), digests=True)
