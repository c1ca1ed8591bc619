"""Near copies by word shingles: all texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

SimHash comes first: sets have fingerprints of 64 bits, and those that differ in two bits at most are found by bit planes
in buckets of shared blocks (``simhash.links``) and joined where the whole sets are similar enough. At a similarity of 0.8
two fingerprints differ in about ten bits, and blocks that fit such a radius are too short to tell texts apart, so that
what is left goes by classes of equal sets that agree in a band of MinHash values; every candidate pair that could join
two groups is checked on the whole sets.

Members of a bucket are first checked against one of them, chosen anew in each of STARS rounds; after that, a bucket
that still holds several groups is compared whole, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import simhash
from quire.llm.common import fresh, stored
from quire.llm.graph import components

SHINGLE, SIMILARITY = 5, 0.8
#: A pair at 0.8 agrees in one of BANDS bands of ROWS values with a probability of 1 - (1 - 0.8 ** 6) ** 24 = 0.9993.
BANDS, ROWS = 24, 6
STARS = 2
#: Sets in one block of a bucket.
BLOCK = 1024
SEED = 42
#: Shingles taken at once.
PART = 1 << 12
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes, size: int = SHINGLE) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words is one shingle, one without words has none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, dtype="<u8")
    line = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts, starts[min(size, len(words)) :])], dtype="<u8"))


def bands(found: np.ndarray) -> np.ndarray:
    """One value for each band of MinHash values; none for an empty set."""
    if not len(found):
        return np.zeros(0, dtype=np.int64)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for k in range(0, len(found), PART):
        low = np.minimum(low, (found[k : k + PART, None] * MULTIPLIERS).min(axis=0))
    each = low.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(each[k].tobytes(), k) for k in range(BANDS)], dtype=np.uint64).view(np.int64)


def _key(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _signed(values: list[int]) -> pa.Array:
    return pa.array(np.array(values, dtype=np.uint64).view(np.int64))


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.binary()):
        yield x.as_buffer().to_pybytes() if x.is_valid else b""


def sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, key, fp, bands) for each row; mark stands for the text, key for the set of shingles, fp is its fingerprint, null for an empty set. A null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, prints, made = [], [], []
            for t in _bytes(b.column(2)):
                found = shingles(t)
                keys.append(_key(found))
                prints.append(np.uint64(simhash.majority(found)).view(np.int64) if len(found) else None)
                made.append(bands(found))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _signed(keys), pa.array(prints, pa.int64()), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "mark", "key", "fp", "bands"])

    own = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), mark(text).alias("mark"), F.col(f"`{text}`").alias("text"))
    return own.mapInArrow(run, "doc_id long, mark long, key long, fp long, bands array<long>")


def mark(text: str) -> Column:
    """What tells the texts of one document's rows apart."""
    return F.xxhash64(F.coalesce(F.col(f"`{text}`"), F.lit("")))


def _whole(docs: DataFrame, wanted: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(key, whole): the sets of the classes wanted (key, rep)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, made = [], []
            for key, t in zip(b.column(0).to_pylist(), _bytes(b.column(1))):
                found = shingles(t)
                if _key(found) == key & 0xFFFFFFFFFFFFFFFF:  # else another row of the same doc_id
                    keys.append(key)
                    made.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(made, pa.binary())], ["key", "whole"])

    texts = docs.select(F.col(doc_id).cast("long").alias("rep"), F.col(text).alias("text"))
    return texts.join(wanted.hint("merge"), "rep").select("key", "text").mapInArrow(run, "key long, whole binary").dropDuplicates(["key"])


def by_fingerprint(classes: DataFrame) -> DataFrame:
    """Candidate pairs (a, b) of the classes (key, fp): those of equal fingerprints, and of fingerprints that differ in ``simhash.RADIUS`` bits at most, as few as join them all."""
    prints = stored(classes.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "prints")
    equal = classes.join(prints.where("n > 1").hint("merge"), "fp").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    return equal.union(simhash.links(prints.select("fp", "rep"), direct=True)).distinct()


def _checked(pairs: DataFrame, whole: DataFrame) -> DataFrame:
    """Those pairs (a, b) that are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column(2), b.column(3)):
                p, q = (np.frombuffer(v.as_buffer(), dtype="<u8") for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both >= SIMILARITY * (len(p) + len(q) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda c: whole.select(F.col("key").alias(c), F.col("whole").alias(f"w{c}")).hint("merge")
    return pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "wa", "wb").mapInArrow(run, "a long, b long")


def similar(found: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """All pairs i < j of sets that are similar enough, by counts over the sets of each shingle."""
    n = np.array([len(x) for x in found])
    _, number = np.unique(np.concatenate(found), return_inverse=True)
    owner = np.repeat(np.arange(len(found)), n)[np.argsort(number, kind="stable")]
    size = np.bincount(number)
    begin, at = np.cumsum(size) - size, np.cumsum(n) - n
    for i in range(len(found)):
        mine = number[at[i] : at[i] + n[i]]
        mine = mine[size[mine] > 1]
        upto = np.cumsum(size[mine])
        each = np.arange(upto[-1] if len(mine) else 0) + np.repeat(begin[mine] - (upto - size[mine]), size[mine])
        both = np.bincount(owner[each], minlength=len(found))
        for j in np.flatnonzero((both > 0) & (both >= SIMILARITY * (n[i] + n - both) - 1e-9)):
            if j > i:
                yield i, int(j)


def _rest(label: DataFrame, whole: DataFrame) -> DataFrame:
    """Similar pairs (a, b) of the buckets (band, key, label) that hold several groups: enough to join all that are to be joined.

    No pair is a row before it is found; a large bucket is cut into blocks, and each pair of blocks is a task's work.
    """
    sizes = label.groupBy("band").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    own = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")
    met = (
        label.join(sizes.select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")).hint("merge"), "band")
        .withColumn("own", own)
        .select("band", "key", "label", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
        .select("key", "band", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "label")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            parent = {h[1]: h[1] for h in held}
            links = []

            def root(x: int) -> int:
                while parent[x] != x:
                    parent[x] = x = parent[parent[x]]
                return x

            if len(parent) > 1:
                for i, j in similar([h[2] for h in held]):
                    x, y = root(held[i][1]), root(held[j][1])
                    if x != y:
                        parent[x] = y
                        links.append((held[i][0], held[j][0]))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

        held: list[tuple] = []
        at = None
        for b in batches:
            for band, p, q, key, mine, raw in zip(*(b.column(k).to_pylist() for k in range(5)), _bytes(b.column(5))):
                if (band, p, q) != at:
                    yield flush()
                    held, at = [], (band, p, q)
                held.append((key, mine, np.frombuffer(raw, dtype="<u8")))
        yield flush()

    dealt = met.join(whole.hint("merge"), "key").select("band", "p", "q", "key", "label", "whole")
    return stored(dealt.repartition("band", "p", "q").sortWithinPartitions("band", "p", "q").mapInArrow(run, "a long, b long"), "rest")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, mark, key, component, component_id) for each row of docs: near fingerprints first, then what MinHash bands find besides.

    ``component`` names the group of near copies, ``component_id`` is the smallest doc_id in it, which two groups share if
    an id stands on rows of different texts. Texts without words, null ones among them, are copies of each other; texts of
    any length are compared whole. A null doc_id names no component and links nothing. No rows give no rows. Other columns
    of docs, whatever their names, don't matter.
    """
    rows = stored(sets(docs, doc_id, text), "sets")
    classes = stored(rows.groupBy("key").agg(F.min("doc_id").alias("rep"), F.min("fp").alias("fp")), "classes")
    close = stored(by_fingerprint(classes.where("rep is not null and fp is not null").select("key", "fp")), "close")
    met = rows.where("doc_id is not null").select("key", F.explode("bands").alias("band")).distinct()
    shared = met.groupBy("band").agg(F.count("*").alias("n")).where("n > 1").select("band")
    met = stored(met.join(shared.hint("merge"), "band"), "met")
    wanted = met.select("key").union(close.select("a")).union(close.select("b")).distinct()
    whole = stored(_whole(docs, wanted.join(classes.select("key", "rep").hint("merge"), "key"), doc_id, text), "whole")

    def labelled(links: DataFrame) -> DataFrame:
        joined = components(links).withColumnRenamed("node", "key")
        return met.join(joined.hint("merge"), "key", "left").select("key", "band", F.coalesce("component", "key").alias("label"))

    links = stored(_checked(close, whole), "similar")
    label = labelled(links)
    for k in range(STARS):
        one = label.groupBy("band").agg(F.min(F.struct(F.xxhash64("key", F.lit(k)).alias("h"), F.col("key").alias("other"), F.col("label").alias("theirs"))).alias("o")).select("band", "o.*")
        some = label.join(one.hint("merge"), "band").where("label <> theirs")
        pairs = stored(some.select(F.least("key", "other").alias("a"), F.greatest("key", "other").alias("b")).distinct(), "pairs")
        links = links.union(stored(_checked(pairs, whole), "similar"))
        label = labelled(links)
    joined = components(links.union(_rest(label, whole))).withColumnRenamed("node", "key")
    named = classes.join(joined.hint("merge"), "key", "left").select("key", "rep", F.coalesce("component", "key").alias("component"))
    smallest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(smallest.hint("merge"), "component").select("key", "component", "component_id")
    return rows.select("doc_id", "mark", "key").join(named.hint("merge"), "key").select("doc_id", "mark", "key", "component", "component_id")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one row of each group of near copies: that of the smallest doc_id, and of several texts of this id one.

    Rows are told apart by id and text, so an id that stands on rows of different texts loses only those that are near
    copies of another row; of rows that are equal in both, one stays. Rows without an id all stay, whatever their text.
    Texts without words are one group. No rows give no rows, and the columns stay as they are, whatever their names.
    """
    found = stored(near_duplicates(docs).where("doc_id is not null"), "near")
    each = found.groupBy("component", "doc_id", "mark").agg(F.count("*").alias("n"))
    # a table of its own, so that Spark may split what a large group meets
    first = stored(found.groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("stays")), "first")
    told = each.join(first.hint("merge"), "component").withColumn("stays", F.col("stays") == F.struct("doc_id", "mark"))
    told = stored(told.where("not stays or n > 1").select("doc_id", "mark", "stays"), "told")
    own, same = fresh(docs.columns, "own"), fresh(docs.columns, "mark")
    keyed = docs.withColumn(own, F.col("doc_id").cast("long")).withColumn(same, mark("text"))
    # the list of rows grows with the documents, so it is never broadcast, however short it is on a small input
    names = lambda t: t.select(F.col("doc_id").alias(own), F.col("mark").alias(same))
    rest = keyed.join(names(told).hint("merge"), [own, same], "left_anti")
    again = told.where("stays")
    if not again.isEmpty():
        rest = rest.unionByName(keyed.join(names(again).hint("merge"), [own, same], "left_semi").dropDuplicates([own, same]))
    return rest.select(*(F.col(f"`{c}`") for c in docs.columns))
