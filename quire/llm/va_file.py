"""Centroid clustering over a vector-approximation file.

1. Vectors become integers and are written once, in slices, as files in the shared folder. Beside each slice stands its
   approximation: eight bits for each component, the number of a cell between two of that component's marks.
2. In each round a table per component and cell tells between which bounds the squared distance to every centroid lies.
   What all these distances share, the distance to a point amid the centroids, is left out of them, so that the bounds are as
   narrow as the centroids are near. Where one centroid's greatest lies below every other's least, the approximation
   alone decides. Only where these intervals overlap is the vector itself fetched, by its position.
3. A cluster's sums change by the vectors that enter or leave it, so a round fetches these and no others. Only sums meet:
   a row for each cluster and component goes to the driver, however many vectors there are.

Slices are written under names of their own and taken up by the rows of the task that succeeded; a round writes each
slice's clusters under the round's name, whole or not at all, so a task that runs again writes the same files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import mounted, read, shared_path, stored
from quire.llm.ngram_trie import Files

SIZE, CLUSTERS, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Integers beyond this in either direction are left out: squared distances of 64 of them wouldn't fit 64 bits.
LIMIT = 1 << 27
#: Cells of a component, those of them beyond each of its outer quantiles, vectors of a slice, and vectors looked up at once.
CELLS, OUTER, SLICE, BATCH = 256, 8, 1 << 16, 1 << 10
#: Quantiles that tell how a component is spread.
QUANTILES = np.array([0, 1 / 256, 1 / 64, *(k / 32 for k in range(1, 32)), 63 / 64, 255 / 256, 1])

#: What a slice's row tells: its name, rows, the quantiles of each component, and the vectors whose hashes come first.
SLICES = "slice string, n long, quantiles array<double>, first array<struct<hash: string, v: array<long>>>"
CHANGES = "cluster int, n long, total array<long>, fetched long, seen long"


def integers(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, values): the places of the vectors that are kept, and floor(SCALE * x) of their components."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    whole = np.asarray(pc.fill_null(pc.list_value_length(column), -1)) == size
    rows = np.flatnonzero(whole)
    flat = column.take(pa.array(rows)).flatten()
    x = np.asarray(flat.fill_null(float("nan")), dtype=float).reshape(len(rows), size)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(SCALE * x)
        good = (np.abs(scaled) <= LIMIT).all(axis=1)
    return rows[good], scaled[good].astype(np.int64)


def _slices(table: DataFrame, files: Files, vec_id: str, embedding: str, size: int, clusters: int) -> DataFrame:
    """The vectors' files and a row for each slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            ids, v = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            known = np.concatenate([h[2] for h in held])
            name = uuid.uuid4().hex
            files.save(name, {"v": v.astype("<i4"), "ids": ids, "known": known})
            hashes = sorted((hashlib.sha256(f"{SEED}:{d}".encode()).hexdigest(), v[k].tolist()) for k, (d, known) in enumerate(zip(ids.tolist(), known.tolist())) if known)
            row = {"slice": name, "n": len(ids), "quantiles": np.quantile(v, QUANTILES, axis=0).T.ravel().tolist(), "first": [{"hash": h, "v": x} for h, x in hashes[:clusters]]}
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema=kinds)

        held: list[tuple] = []
        for b in batches:
            rows, v = integers(b.column(1), size)
            ids = b.column(0).take(pa.array(rows))
            for k in range(0, len(rows), SLICE):
                part = ids.slice(k, SLICE)
                held.append((np.asarray(part.fill_null(0), dtype=np.int64), v[k : k + SLICE], np.asarray(part.is_valid())))
                if sum(len(h[0]) for h in held) >= SLICE:
                    yield flush()
        if held:
            yield flush()

    kinds = pa.schema([("slice", pa.string()), ("n", pa.int64()), ("quantiles", pa.list_(pa.float64())), ("first", pa.list_(pa.struct([("hash", pa.string()), ("v", pa.list_(pa.int64()))])))])
    chosen = table.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{embedding}`").cast("array<double>").alias("v"))
    return chosen.mapInArrow(run, SLICES)


def marks(slices: DataFrame, size: int) -> np.ndarray:
    """(components, CELLS + 1) edges: cell c holds the integers from edge c to below edge c + 1.

    The outermost edges are a component's least and greatest value, so that every vector lies in a cell. The inner ones
    follow the mean of the slices' quantiles; beyond the outer quantiles cells grow fourfold, however far values lie apart.
    Where edges lie decides how many vectors are fetched, never a result.
    """
    each = slices.select("n", F.posexplode("quantiles").alias("k", "x"))
    found = each.groupBy("k").agg(F.min("x").alias("low"), F.max("x").alias("high"), (F.sum(F.col("x") * F.col("n")) / F.sum("n")).alias("mean"))
    rows = sorted(found.collect(), key=lambda r: r["k"])  # a row for each component and quantile
    least, greatest, mean = (np.array([r[c] for r in rows]).reshape(size, len(QUANTILES)) for c in ("low", "high", "mean"))
    wanted = np.linspace(QUANTILES[1], QUANTILES[-2], CELLS - 2 * OUTER + 1)
    grow = (4.0 ** np.arange(1, OUTER + 1) - 1) / (4.0**OUTER - 1)
    edges = np.empty((size, CELLS + 1))
    for d in range(size):
        low, high = least[d, 0], greatest[d, -1] + 1
        inner = np.clip(np.interp(wanted, QUANTILES[1:-1], mean[d, 1:-1]), low, high)
        edges[d] = [*(inner[0] - (inner[0] - low) * grow)[::-1], *inner, *(inner[-1] + (high - inner[-1]) * grow)]
        edges[d, [0, -1]] = low, high
    return np.floor(edges).astype(np.int64)


def cells(v: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The number of each component's cell, a byte each."""
    out = np.empty(v.shape, dtype=np.uint8)
    for d in range(v.shape[1]):
        out[:, d] = np.searchsorted(edges[d, 1:-1], v[:, d], side="right")
    return out


def tables(centroids: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """(components * CELLS, 2 * centroids): bounds of (x - centroid)^2 - (x - middle)^2 for x in the cell; a cell without integers is never looked up."""
    middle = np.sort(centroids, axis=0)[len(centroids) // 2]
    slope, rest = -2 * (centroids - middle)[:, :, None], (centroids * centroids - middle * middle)[:, :, None]
    a, b = edges[None, :, :-1] * slope + rest, (edges[None, :, 1:] - 1) * slope + rest
    both = np.concatenate([np.minimum(a, b), np.maximum(a, b)])
    return np.ascontiguousarray(both.transpose(1, 2, 0).reshape(-1, len(both)))


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty((len(v), len(centroids)), dtype=np.int64)
    for k, c in enumerate(centroids):
        gap = v.astype(np.int64) - c
        out[:, k] = (gap * gap).sum(axis=1)
    return out


def assign(approximate: np.ndarray, v: np.ndarray, lookup: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, int]:
    """(cluster of each vector, vectors fetched): v is read only where the intervals of two centroids overlap."""
    k = len(centroids)
    again = [b for b in range(k) if any((centroids[a] == centroids[b]).all() for a in range(b))]  # nothing is nearest to these
    out, fetched = np.empty(len(approximate), dtype=np.uint8 if k <= 256 else np.int32), 0
    base = CELLS * np.arange(approximate.shape[1])
    for at in range(0, len(approximate), BATCH):
        sums = lookup[approximate[at : at + BATCH] + base].sum(axis=1)
        may = sums[:, :k] <= sums[:, k:].min(axis=1, keepdims=True)
        may[:, again] = False
        best = may.argmax(axis=1)
        open_ = np.flatnonzero(may.sum(axis=1) > 1)
        if len(open_):
            exact = np.where(may[open_], squared(v[at + open_], centroids), np.iinfo(np.int64).max)
            best[open_] = exact.argmin(axis=1)  # the first of equals: the smaller number
            fetched += len(open_)
        out[at : at + BATCH] = best
    return out, fetched


def _each(slices: DataFrame, run, schema: str, parts: int) -> DataFrame:
    """run(name) over the slices' names, a batch for each."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                yield run(name)

    return slices.select("slice").repartition(parts).mapInArrow(over, schema)


def clusters(
    table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS, folder: str | None = None
) -> tuple[DataFrame, list[dict]]:
    """((vec_id, cluster, distance) for each kept vector, a report of the centroids and rounds).

    Kept are vectors of ``size`` components, none of them null, not finite or beyond LIMIT when scaled; all other rows
    give no row. Repeated rows are vectors of their own. A vector without an id is clustered but starts no centroid;
    of equal hashes the smaller vector starts first. Fewer vectors than ``clusters`` make as many centroids as there are;
    where none has an id, or no vector is kept, there are no rows. Other columns don't matter. Texts don't occur.
    """
    spark = table.sparkSession
    files = Files(mounted(folder or shared_path(spark, "vectors")))
    slices = stored(_slices(table, files, vec_id, embedding, size, clusters), "slices")
    starts = slices.select(F.explode("first").alias("f")).select("f.hash", "f.v").orderBy("hash", "v").limit(clusters).collect()
    if not starts:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long"), []
    centroids, edges = np.array([r["v"] for r in starts], dtype=np.int64), marks(slices, size)
    k = len(centroids)
    parts = max(1, min(slices.count(), 4 * spark.sparkContext.defaultParallelism))
    count, total = [0] * k, [[0] * size for _ in range(k)]
    report = []
    for number in range(rounds):
        lookup = tables(centroids, edges)

        def step(name: str, number=number, lookup=lookup, centroids=centroids) -> pa.RecordBatch:
            v = files.load(name, "v")["v"]
            if number == 0:
                files.save(name, {"cells": cells(v, edges)})
            now, fetched = assign(files.load(name, "cells")["cells"], v, lookup, centroids)
            before = files.load(name, f"round{number - 1}")[f"round{number - 1}"] if number else None
            files.save(name, {f"round{number}": now})
            moved = np.flatnonzero(now != before) if number else np.arange(len(now))
            rows = []
            n, sums = np.zeros(k, dtype=np.int64), np.zeros((k, size), dtype=np.int64)
            for at in range(0, len(moved), BATCH):
                part = moved[at : at + BATCH]
                x = v[part].astype(np.int64)
                for sign, where in ((1, now), *(((-1, before),) if number else ())):
                    np.add.at(n, where[part], sign)
                    np.add.at(sums, where[part], sign * x)
            for c in range(k):
                rows.append({"cluster": c, "n": int(n[c]), "total": sums[c].tolist(), "fetched": fetched if c == 0 else 0, "seen": len(now) if c == 0 else 0})
            return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("cluster", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64())), ("fetched", pa.int64()), ("seen", pa.int64())]))

        each = _each(slices, step, CHANGES, parts).select("cluster", "n", "fetched", "seen", F.posexplode("total").alias("d", "x"))
        exact = lambda c: F.sum(F.col(c).cast("decimal(20,0)"))
        found = each.groupBy("cluster", "d").agg(exact("x").alias("x"), exact("n").alias("n"), F.sum("fetched").alias("fetched"), F.sum("seen").alias("seen")).collect()  # clusters x components
        for r in found:
            total[r["cluster"]][r["d"]] += int(r["x"])
            if r["d"] == 0:
                count[r["cluster"]] += int(r["n"])
        report.append({"round": number, "fetched": sum(r["fetched"] for r in found if r["d"] == 0), "vectors": sum(r["seen"] for r in found if r["d"] == 0)})
        centroids = np.array([[x // count[c] for x in total[c]] if count[c] else centroids[c].tolist() for c in range(k)], dtype=np.int64)
    lookup = tables(centroids, edges)

    def last(name: str) -> pa.RecordBatch:
        found = files.load(name, "v", "ids", "known")
        if rounds:
            near, _ = assign(files.load(name, "cells")["cells"], found["v"], lookup, centroids)
        else:
            near, _ = assign(cells(found["v"], edges), found["v"], lookup, centroids)
        far = np.empty(len(near), dtype=np.int64)
        for at in range(0, len(near), BATCH):
            gap = found["v"][at : at + BATCH].astype(np.int64) - centroids[near[at : at + BATCH]]
            far[at : at + BATCH] = (gap * gap).sum(axis=1)
        ids = pa.array(found["ids"], pa.int64(), mask=~found["known"])
        return pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(far)], ["vec_id", "cluster", "distance"])

    out = stored(_each(slices, last, "vec_id long, cluster int, distance long", parts), "clusters")
    return out, [*({"centroid": c, "components": centroids[c].tolist()} for c in range(k)), *report]


def op12_va_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, report = clusters(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    digest = {r["centroid"]: hashlib.sha256(",".join(map(str, r["components"])).encode()).hexdigest() for r in report if "centroid" in r}
    inertia = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).cast("long").alias("inertia")).collect()  # a row for each cluster
    rows = [(r["cluster"], r["inertia"], sum(x["inertia"] for x in inertia), digest[r["cluster"]]) for r in inertia]
    by = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(by), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql(size: int = SIZE, clusters: int = CLUSTERS, rounds: int = ROUNDS) -> str:
    """The same in DuckDB: each round is two tables, all the way to the last assignment."""
    made = f"""
WITH e AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id::VARCHAR), v) - 1 AS cluster, v AS c FROM e
  QUALIFY cluster < {clusters}
)"""
    gap = "list_sum(list_transform(range(1, {0} + 1), lambda i: (v[i] - c[i]) * (v[i] - c[i])))".format(size)
    for k in range(rounds + 1):
        made += f""", a{k} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, arg_min(cluster, (distance, cluster)) AS cluster, min(distance) AS distance
  FROM (SELECT n, vec_id, v, cluster, {gap}::BIGINT AS distance FROM (SELECT row_number() OVER () AS n, * FROM e), c{k}) GROUP BY n, vec_id
)"""
        if k < rounds:
            made += f""", s{k} AS MATERIALIZED (
  SELECT cluster, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{k}, range(1, {size} + 1) t(i) GROUP BY ALL
), c{k + 1} AS MATERIALIZED (
  SELECT cluster, coalesce(m, c) AS c FROM c{k}
  LEFT JOIN (SELECT cluster, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{k} GROUP BY cluster) USING (cluster)
)"""
    return f"""{made}
SELECT vec_id, cluster::INTEGER AS cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
  (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)
"""


OP12_SQL = _sql()
