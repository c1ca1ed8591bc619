"""SimHash near-dedup with bit-sliced comparison.

Documents become 64-bit fingerprints, equal fingerprints one class, and classes are compared only where they share two
of four 16-bit blocks: at a radius of 2 every linked pair shares two blocks, so nothing is lost. Within such a bucket the
fingerprints are stored as vertical bit planes; one fingerprint is compared with all others at once, plane by plane,
with the distances kept in carry-save counters, and the comparison ends when every distance has passed the radius.
A large bucket is cut into blocks, and every pair of blocks is compared in a task of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import read, stored
from quire.llm.graph import components

RADIUS = 2
SEED = 42
SHINGLE = 3
#: Fingerprints in one block of a bucket.
BLOCK = 2048
#: Bit planes between two looks at whether all distances have passed the radius.
LOOK = 8


def simhash(text: bytes) -> int:
    """Bit k is 1 if it is 1 in over half of the shingles' hashes; 0 without words. Words split at ASCII white space."""
    words = text.lower().split()
    if not words:
        return 0
    line = b" ".join(words)
    if len(words) < SHINGLE:
        return xxhash.xxh64_intdigest(line, SEED)
    ends = list(accumulate((len(w) + 1 for w in words)))
    starts = [0, *ends]
    digest = xxhash.xxh64_intdigest
    return majority(np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :])], dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    """Bit k is 1 if it is 1 in over half of the hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) for each row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [simhash(x.as_buffer().to_pybytes() if x.is_valid else b"") for x in b.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def planes_of(values: list[int]) -> list[int]:
    """64 planes: bit j of plane k is bit k of value j."""
    bits = np.unpackbits(np.array(values, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits, axis=0, bitorder="little")
    return [int.from_bytes(packed[:, k].tobytes(), "little") for k in range(64)]


def near(value: int, planes: list[int], everything: int, radius: int = RADIUS) -> int:
    """The bits of those stored values that differ from value in at most radius places."""
    width = (radius + 1).bit_length()
    counters = [0] * width
    over = 0
    for k in range(64):
        carry = planes[k] ^ (everything if value >> k & 1 else 0)
        for b in range(width):
            counters[b], carry = counters[b] ^ carry, counters[b] & carry
        over |= carry
        if k % LOOK == LOOK - 1 and (over | _above(counters, radius, everything)) == everything:
            return 0
    return everything & ~(over | _above(counters, radius, everything))


def _above(counters: list[int], radius: int, everything: int) -> int:
    """Where the counter exceeds the radius."""
    more, equal = 0, everything
    for b in reversed(range(len(counters))):
        if radius >> b & 1:
            equal &= counters[b]
        else:
            more |= equal & counters[b]
            equal &= ~counters[b]
    return more


def linked(values: list[int], names: list[int], radius: int = RADIUS, direct: bool = False) -> list[tuple[int, int]]:
    """Links (name, smallest name of its local component), for values that differ in at most radius bits. direct: of two such values each, as few as join the same."""
    planes, everything = planes_of(values), (1 << len(values)) - 1
    parent = list(range(len(values)))
    pairs = []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, v in enumerate(values):
        hits = near(v, planes, everything, radius) >> (i + 1)
        while hits:
            low = hits & -hits
            j = i + low.bit_length()
            hits ^= low
            a, b = root(i), root(j)
            if a != b:
                parent[max(a, b, key=names.__getitem__)] = min(a, b, key=names.__getitem__)
                pairs.append((names[i], names[j]))
    return pairs if direct else [(names[i], names[r]) for i in range(len(values)) if (r := root(i)) != i]


def links(classes: DataFrame, direct: bool = False) -> DataFrame:
    """Links (a, b) that connect all near classes (fp, rep): for each bucket at most one for each of its members. direct: a and b are near each other themselves."""
    blocks = [F.shiftrightunsigned("fp", 16 * k).bitwiseAND(F.lit(0xFFFF).cast("long")) for k in range(4)]
    keys = F.array(*(F.shiftleft(blocks[i], 16).bitwiseOR(blocks[j]).bitwiseOR(F.lit(t << 32).cast("long")) for t, (i, j) in enumerate(combinations(range(4), 2))))
    keyed = classes.select("fp", "rep", F.explode(keys).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = (
        keyed.join(sizes, "key")
        .withColumn("parts", parts)
        .withColumn("own", own)
        .select("key", "fp", "rep", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("key", "fp", "rep", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(fps: list[int], reps: list[int]) -> pa.RecordBatch:
            found = linked([x & 0xFFFFFFFFFFFFFFFF for x in fps], reps, direct=direct) if len(fps) > 1 else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], type=pa.int64()) for k in (0, 1)], ["a", "b"])

        held, fps, reps = None, [], []
        for b in batches:
            for key, p, q, fp, rep in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (key, p, q) != held:
                    yield flush(fps, reps)
                    held, fps, reps = (key, p, q), [], []
                fps.append(fp)
                reps.append(rep)
        yield flush(fps, reps)

    dealt = met.select("key", "p", "q", "fp", "rep").repartition("key", "p", "q").sortWithinPartitions("key", "p", "q")
    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row of docs.

    Null and empty texts and texts without words have fingerprint zero and are linked like any other. Repeated rows
    share a fingerprint and so a component. A null doc_id never names a component. An empty table gives no rows, and
    other columns of docs don't matter.
    """
    prints = stored(fingerprints(docs, doc_id, text), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "classes")
    joined = components(links(classes.where("rep is not null"))).select(F.col("node").alias("rep"), "component")
    named = classes.join(joined, "rep", "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents", "doc_id", "text"))


