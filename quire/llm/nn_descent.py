"""Embedding near-dedup by NN-descent over balls of near copies.

1. Equal vectors of a label become one point with a weight.
2. Points in a ball of half the linking angle are all linked, by the triangle inequality, so a dense group of copies is
   carried as one node: its centre, its radius and its members. A group of any size costs its size, not its square.
3. NN-descent over the nodes: neighbours of neighbours meet at the node between them, and each node keeps its K nearest.
   A list is saturated when all of it could be linked; every neighbour that could be linked is kept whatever their number,
   so saturated lists grow. The graph starts from a few orders along random hyperplanes. After each round a sample of
   nodes is compared with all nodes; the sample grows until it holds enough pairs to tell the recall.
4. The descent ends when the sample misses nothing, when a round no longer helps, or after ROUNDS. If the sample missed a
   pair, or held too few to tell, the labels are finished exactly, a block of nodes with each other block; links aren't
   given up for a share of them that was reached. That costs a label's square, and only where the descent falls short.
5. Node pairs that could be linked are decided by their members' cosines in double precision.
"""

from __future__ import annotations

import logging
import math
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import mounted, read, shared_path, stored
from quire.llm.graph import components
from quire.llm.ngram_trie import Files

LOG = logging.getLogger(__name__)

COSINE = 0.93
K = 8
#: Nodes compared at once in the starting graph, starting orders, rounds at most, and what a round must add to the recall.
BLOCK, ORDERS, ROUNDS, GAIN = 256, 3, 12, 0.005
#: Nodes audited at first and at most, and linkable pairs among them that tell a recall: none missed of 300 is 0.99 at least, 19 times of 20.
AUDITED, AUDITED_MOST, TOLD = 400, 6400, 300
#: Nodes of a block where labels are finished exactly.
PACK = 1024
#: Neighbours that meet at once, and members of one packed part of a ball.
MEET, PART = 128, 512
BITS = 48
#: Angles are compared with this much to spare, where the exact cosines come later.
SPARE = 1e-6


def _unit(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype="<f8")


def _matrix(rows: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(rows), dtype="<f8").reshape(len(rows), -1)


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def vectors(table: DataFrame) -> DataFrame:
    """(vec_id, grp, unit): vectors scaled to length 1, as bytes of doubles; grp is label and dimension, null for those that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            grp, unit = [], []
            for label, v in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                x = None if label is None or not v or None in v else np.array(v, dtype=float)
                if x is not None and np.isfinite(x).all() and x.any():
                    x = x / np.abs(x).max()
                    grp.append(f"{label}/{len(x)}")
                    unit.append((x / np.linalg.norm(x) + 0.0).astype("<f8").tobytes())
                else:
                    grp.append(None)
                    unit.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(grp, pa.string()), pa.array(unit, pa.binary())], ["vec_id", "grp", "unit"])

    return table.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), "embedding").mapInArrow(run, "vec_id long, grp string, unit binary")


def _blocks(nodes: DataFrame, seed: int, each: Callable[[list[int], np.ndarray, list[float]], list[tuple]], schema: str, size: int = BLOCK) -> DataFrame:
    """each(ids, units, radii) over blocks of nodes of one group that are neighbours in the order of random hyperplanes."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.float64() if c.endswith("double") else pa.int64() for c in schema.split(", ")]

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            found = []
            for raw in b.column(1).to_pylist():
                x = _unit(raw)
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng([seed, len(x)]).normal(size=(len(x), BITS))
                found.append(int.from_bytes(np.packbits(x @ planes[len(x)] > 0).tobytes(), "big"))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.int64())], [*b.schema.names, "sig"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            rows = each([h[0] for h in held], _matrix([h[1] for h in held]), [h[2] for h in held]) if held else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

        held: list[tuple] = []
        group = None
        for b in batches:
            for node, unit, grp, radius in zip(*(b.column(k).to_pylist() for k in range(4))):
                if grp != group or len(held) == size:
                    yield flush()
                    held, group = [], grp
                held.append((node, unit, radius))
        yield flush()

    signed = nodes.select("id", "unit", "grp", "radius").mapInArrow(sign, "id long, unit binary, grp string, radius double, sig long")
    # a partition holds several blocks, so that few neighbours in the order are parted by its ends
    n = nodes.count()
    parts = max(1, min(max(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // (256 * size)), n // (4 * size)))
    return signed.repartitionByRange(parts, "grp", "sig", "id").sortWithinPartitions("grp", "sig", "id").mapInArrow(run, schema)


def balls(points: DataFrame, cosine: float) -> DataFrame:
    """points (id, grp, unit, weight) with ``ball`` and its ``centre``: every member lies within half the linking angle of it."""
    half = math.acos(cosine) / 2 - SPARE

    def lead(ids: list[int], units: np.ndarray, _: list[float]) -> list[tuple]:
        near = _angles(units, units) <= half
        free, found = np.ones(len(ids), dtype=bool), []
        for k in np.argsort(-near.sum(axis=1), kind="stable"):
            mine = np.flatnonzero(near[k] & free) if free[k] else ()
            if len(mine) > 1:
                found += [(ids[j], ids[k]) for j in mine if j != k]
                free[mine] = False
        return found

    table = stored(points.select("*", F.col("id").alias("ball"), F.col("unit").alias("centre")), "balls")
    for seed in (101, 102, 103):
        centres = table.groupBy(F.col("ball").alias("id")).agg(F.first("centre").alias("unit"), F.first("grp").alias("grp")).withColumn("radius", F.lit(0.0))
        centres = stored(centres, "centres")
        moves = _blocks(centres, seed, lead, "ball long, to long", PART)
        moves = moves.join(centres.select(F.col("id").alias("to"), F.col("unit").alias("target")), "to")

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                unit, ball, centre, to, target = (b.column(b.schema.names.index(c)).to_pylist() for c in ("unit", "ball", "centre", "to", "target"))
                for k in range(len(unit)):
                    if to[k] is not None and _angles(_matrix([unit[k]]), _matrix([target[k]]))[0, 0] <= half:
                        ball[k], centre[k] = to[k], target[k]
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(c)) for c in ("id", "grp", "unit", "weight")), pa.array(ball, pa.int64()), pa.array(centre, pa.binary())], ["id", "grp", "unit", "weight", "ball", "centre"])

        table = stored(table.join(moves, "ball", "left").mapInArrow(choose, "id long, grp string, unit binary, weight long, ball long, centre binary"), "balls")
    return table


def _nearest(ids: list[int], units: np.ndarray, radii: list[float], theta: float) -> list[tuple]:
    """(a, b, angle, could) for the K nearest of each, and for all that could be linked."""
    if len(ids) < 2:
        return []
    angle, r = _angles(units, units), np.array(radii)
    np.fill_diagonal(angle, np.inf)
    could = angle <= theta + r[:, None] + r[None, :] + SPARE
    keep = could.copy()
    top = np.argpartition(angle, min(K, len(ids) - 1) - 1, axis=1)[:, :K]
    np.put_along_axis(keep, top, True, axis=1)
    np.fill_diagonal(keep, False)
    a, b = np.nonzero(keep)
    return [(ids[i], ids[j], float(angle[i, j]), int(could[i, j])) for i, j in zip(a, b)]


GRAPH = "a long, b long, angle double, could long"


def _kept(graph: DataFrame) -> DataFrame:
    """The K nearest of each node, and all that could be linked."""
    once = graph.groupBy("a", "b").agg(F.min("angle").alias("angle"), F.max("could").alias("could"))
    place = F.row_number().over(Window.partitionBy("a").orderBy("angle", "b"))
    return once.withColumn("place", place).where((F.col("place") <= K) | (F.col("could") == 1)).drop("place")


def _round(graph: DataFrame, nodes: DataFrame, theta: float, number: int = 0) -> DataFrame:
    """Candidates from neighbours that meet at the node between them. Large meetings are held in parts, dealt anew in each round."""
    meet = graph.select(F.col("a").alias("at"), F.col("b").alias("id")).union(graph.select(F.col("b").alias("at"), F.col("a").alias("id"))).distinct()
    place = F.row_number().over(Window.partitionBy("at").orderBy(F.xxhash64("id", "at", F.lit(number))))
    invited = meet.withColumn("part", F.floor((place - 1) / MEET)).join(nodes.select("id", "unit", "radius"), "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64()]

        def flush() -> pa.RecordBatch:
            rows = _nearest([h[0] for h in held], _matrix([h[1] for h in held]), [h[2] for h in held], theta) if held else []
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["a", "b", "angle", "could"])

        held: list[tuple] = []
        key = None
        for b in batches:
            for at, part, node, unit, radius in zip(*(b.column(k).to_pylist() for k in range(5))):
                if (at, part) != key:
                    yield flush()
                    held, key = [], (at, part)
                held.append((node, unit, radius))
        yield flush()

    dealt = invited.select("at", "part", "id", "unit", "radius").repartition("at", "part").sortWithinPartitions("at", "part")
    return dealt.mapInArrow(run, GRAPH)


def _audit(graph: DataFrame, nodes: DataFrame, theta: float) -> tuple[int, int]:
    """(linkable pairs found by comparing a sample with all nodes, those of them that the graph holds)."""
    n, audited = nodes.count(), AUDITED
    while True:
        pairs, held = _compared(graph, nodes, theta, min(1.0, audited / max(n, 1)))
        if pairs >= TOLD or audited >= min(n, AUDITED_MOST):
            return pairs, held
        audited *= 4


def _compared(graph: DataFrame, nodes: DataFrame, theta: float, part: float) -> tuple[int, int]:
    """(linkable pairs of a part of the nodes with all nodes, those of them that the graph holds)."""
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    sample = nodes.where(place < part).select("id", "grp", "unit", "radius").collect()
    by: dict[str, tuple] = {}
    for g in {r["grp"] for r in sample}:
        mine = [r for r in sample if r["grp"] == g]
        by[g] = ([r["id"] for r in mine], _matrix([bytes(r["unit"]) for r in mine]), np.array([r["radius"] for r in mine]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for node, grp, unit, radius in zip(*(b.column(k).to_pylist() for k in range(4))):
                if grp in by:
                    ids, units, radii = by[grp]
                    hits = np.flatnonzero(_angles(units, _matrix([unit]))[:, 0] <= theta + radii + radius)
                    found += [(ids[k], node) for k in hits if ids[k] != node]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    true = nodes.select("id", "grp", "unit", "radius").mapInArrow(run, "a long, b long")
    got = true.join(graph.select("a", "b", F.lit(1).alias("hit")), ["a", "b"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("hit")).first()
    return got["n"], got["hit"]


def neighbour_graph(nodes: DataFrame, theta: float) -> tuple[DataFrame, list[dict]]:
    """(directed edges (a, b, angle, could) over nodes (id, grp, unit, radius), the audit of each round)."""
    each = lambda ids, units, radii: _nearest(ids, units, radii, theta)
    start = None
    for seed in range(ORDERS):
        made = _blocks(nodes, seed + 1, each, GRAPH)
        start = made if start is None else start.union(made)
    graph, report = stored(_kept(start), "graph"), []
    for k in range(ROUNDS):
        fresh = _round(graph, nodes, theta, k)
        if k:  # what the descent alone doesn't reach, another starting order may
            fresh = fresh.union(_blocks(nodes, 1000 + k, each, GRAPH))
        both = graph.select("a", "b", "angle", "could").union(fresh)
        graph = stored(_kept(both.union(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "angle", "could"))), "graph")
        pairs, held = _audit(graph, nodes, theta)
        report.append({"round": k, "audited": pairs, "held": held, "recall": held / pairs if pairs else None})
        LOG.info("round %d: %d of %d audited pairs", k, held, pairs)
        gained = held / pairs - (report[-2]["recall"] or 0.0) if k and pairs else 1.0
        if held == pairs or gained < GAIN:
            break
    return graph, report


def linkable(nodes: DataFrame, theta: float, folder: str | None = None) -> DataFrame:
    """All pairs (a, b) of nodes of a label that could be linked, of labels that are more than one starting block: every block with every other.

    Blocks are files in the shared folder, so no vector is shuffled; a row of work is one block and half of the others.
    """
    spark = nodes.sparkSession
    files = Files(mounted(folder or shared_path(spark, "blocks")))
    sizes = nodes.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).withColumn("packs", F.ceil(F.col("n") / PACK).cast("long"))
    dealt = nodes.join(sizes, "grp").withColumn("pack", F.pmod(F.xxhash64("id", F.lit(11)), F.col("packs")))
    name = lambda grp, pack: f"{xxhash.xxh64_hexdigest(grp)}-{pack}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            if held:
                files.save(name(*key[:2]), {"ids": np.array([h[0] for h in held]), "unit": _matrix([h[1] for h in held]), "radius": np.array([h[2] for h in held])})
            return pa.RecordBatch.from_arrays([pa.array([key[0]] if held else [], pa.string()), *(pa.array([key[j]] if held else [], pa.int64()) for j in (1, 2))], ["grp", "pack", "packs"])

        held: list[tuple] = []
        key: tuple = (None, None, None)
        for b in batches:
            for grp, pack, packs, node, unit, radius in zip(*(b.column(j).to_pylist() for j in range(6))):
                if (grp, pack, packs) != key:
                    yield flush()
                    held, key = [], (grp, pack, packs)
                held.append((node, unit, radius))
        yield flush()

    packed = dealt.select("grp", "pack", "packs", "id", "unit", "radius").repartition("grp", "pack").sortWithinPartitions("grp", "pack", "id")
    packs = stored(packed.mapInArrow(write, "grp string, pack long, packs long"), "packs")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for grp, pack, packs in zip(*(b.column(j).to_pylist() for j in range(3))):
                x = files.load(name(grp, pack), "ids", "unit", "radius")
                for step in range(packs // 2 + 1):  # round the circle: each pair of blocks once, the opposite one from both sides
                    other = name(grp, (pack + step) % packs)
                    if not os.path.exists(f"{files.root}/{other}.ids.npy"):  # no node fell into it
                        continue
                    y = files.load(other, "ids", "unit", "radius")
                    dots = x["unit"] @ y["unit"].T
                    i, j = np.nonzero(dots >= math.cos(min(math.pi, theta + x["radius"].max() + y["radius"].max() + SPARE)))
                    near = np.arccos(np.clip(dots[i, j], -1.0, 1.0)) <= theta + x["radius"][i] + y["radius"][j] + SPARE
                    p, q = x["ids"][i[near]], y["ids"][j[near]]
                    kept = p != q
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(p, q)[kept]), pa.array(np.maximum(p, q)[kept])], ["a", "b"])

    parts = max(1, min(packs.count(), 4 * spark.sparkContext.defaultParallelism))
    return packs.repartition(parts).mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(table: DataFrame, cosine: float = COSINE, report: list[dict] | None = None) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row (vec_id, embedding, label). report: a list that gets the audit of each round.

    Vectors that are null, empty, zero or hold null or non-finite components, and vectors without a label, have no links
    and are kept. Vectors are compared with those of the same length only. Repeated rows are equal vectors and count as
    each other's links; rows without vec_id count as links and name no component. No rows give no rows. Other columns,
    whatever their names, don't matter.
    """
    theta = math.acos(cosine)
    rows = stored(vectors(table), "vectors")
    points = rows.where("grp is not null").groupBy("grp", "unit").agg(F.min("vec_id").alias("vec"), F.count("*").alias("weight"))
    points = stored(points.select(F.xxhash64("grp", "unit", F.lit("id")).alias("id"), "grp", "unit", "weight", "vec"), "points")
    members = balls(points.drop("vec"), cosine)

    def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit, centre = _matrix(b.column(1).to_pylist()) if len({len(x) for x in b.column(1).to_pylist()}) == 1 else None, None
            if unit is not None:
                centre = _matrix(b.column(2).to_pylist())
                far = np.arccos(np.clip((unit * centre).sum(axis=1), -1, 1))
            else:
                far = np.array([_angles(_matrix([u]), _matrix([c]))[0, 0] for u, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())])
            same = [u == c for u, c in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.where(same, 0.0, far), pa.float64()), *b.columns[3:]], ["ball", "far", "id", "weight"])

    far = members.select("ball", "unit", "centre", "id", "weight").mapInArrow(reach, "ball long, far double, id long, weight long")
    measured = stored(far, "far")
    shape = measured.groupBy("ball").agg(F.max("far").alias("radius"), F.sum("weight").alias("total"), F.count("*").alias("size"))
    centres = members.groupBy("ball").agg(F.first("centre").alias("unit"), F.first("grp").alias("grp"))
    nodes = stored(centres.join(shape, "ball").withColumnRenamed("ball", "id"), "nodes")
    graph, told = neighbour_graph(nodes, theta)
    found = graph.where("could = 1").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    certain = told[-1]["audited"] == told[-1]["held"] >= TOLD
    if not certain:
        found = found.union(linkable(nodes, theta))
    if report is not None:
        report += [*told, {"finished exactly": not certain}]
    pairs = stored(found.distinct(), "pairs")
    decided = stored(_decide(pairs, members, nodes, cosine), "decided")

    names = measured.join(points.select("id", "vec"), "id").groupBy("ball").agg(F.min("vec").alias("name"))
    name = lambda c: names.select(F.col("ball").alias(c), F.col("name").alias(f"{c}_name"))
    edges = decided.where("point is null").select(F.col("ball").alias("p"), F.col("other").alias("q")).distinct()
    edges = edges.join(name("p"), "p").join(name("q"), "q").select(F.col("p_name").alias("a"), F.col("q_name").alias("b"))
    joined = components(edges).withColumnRenamed("node", "name")
    whole = names.join(joined, "name", "left").select("ball", F.coalesce("component", "name").alias("component"))
    outside = decided.where("point is not null").groupBy(F.col("point").alias("id")).agg(F.sum("n").alias("outside"))
    each = (
        measured.select("ball", "id")
        .join(shape.select("ball", "total"), "ball")
        .join(whole, "ball")
        .join(outside, "id", "left")
        .join(points.select("id", "grp", "unit"), "id")
        .select("grp", "unit", (F.col("total") - 1 + F.coalesce("outside", F.lit(0))).alias("links"), "component")
    )
    out = rows.join(each, ["grp", "unit"], "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def _decide(pairs: DataFrame, members: DataFrame, nodes: DataFrame, cosine: float) -> DataFrame:
    """For pairs of balls: (point, n) weight of the other ball's linked members, and (ball, other) where any are linked.

    Members are packed in parts of at most PART, and each pair of parts is compared at once; no pair of members is a row.
    """
    part = F.floor((F.row_number().over(Window.partitionBy("ball", "slice").orderBy("id")) - 1) / PART)
    parts = F.ceil(F.col("size") / PART).cast("int")
    sliced = members.join(nodes.select(F.col("id").alias("ball"), "size"), "ball").withColumn("slice", F.pmod(F.xxhash64("id"), parts))
    sliced = sliced.repartition("ball", "slice")  # dealt by both: a large ball is many slices in many tasks
    packed = sliced.withColumn("part", part).groupBy("ball", "slice", "part").agg(F.collect_list(F.struct("id", "weight", "unit")).alias("m"))
    packed = stored(packed.select("ball", "m"), "packed")
    left = packed.select(F.col("ball").alias("a"), F.col("m").alias("ma"))
    right = packed.select(F.col("ball").alias("b"), F.col("m").alias("mb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 64):
                rows: list[tuple] = []
                for r in whole.slice(at, 64).to_pylist():
                    ua, ub = (_matrix([x["unit"] for x in r[k]]) for k in ("ma", "mb"))
                    hit = ua @ ub.T >= cosine
                    if hit.any():
                        rows.append((None, None, r["a"], r["b"]))
                        for mine, n in ((r["ma"], hit @ np.array([x["weight"] for x in r["mb"]])), (r["mb"], np.array([x["weight"] for x in r["ma"]]) @ hit)):
                            rows += [(x["id"], int(k), None, None) for x, k in zip(mine, n) if k]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], pa.int64()) for k in range(4)], ["point", "n", "ball", "other"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ma", "mb").mapInArrow(run, "point long, n long, ball long, other long")


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93
), c(node, comp) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT p.a, c.comp FROM c JOIN p ON p.b = c.node),
m AS (SELECT node, min(comp) AS component_id FROM c GROUP BY 1), n AS (SELECT a, count(*) AS n FROM p GROUP BY 1)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM embeddings JOIN m ON node = vec_id LEFT JOIN n ON a = vec_id
"""


def op8_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))
