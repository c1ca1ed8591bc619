"""K-d tree sharding in DataFrame functions only.

The tree splits the documents recursively along their widest metadata dimension, at the weighted median of bytes (or
the weighted quantile that fits an odd number of shards), until a leaf holds the target: total bytes over the shards.
A quantile is found by distributed histograms that narrow in on it; the driver sees one row for each tree node and
round, however large the table is. Along a dimension rows are ordered by value, then by their text's checksum, so that
equal texts, which share their coordinates whatever their sources, go to one shard unless their group is too heavy; such
a group is cut by a hash of the row's number. A dimension's width in a node is taken relative to its width in the table.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.llm.common import fresh, read, stored

SHARDS = 24
#: A cut may miss its target by this part of a leaf's bytes.
TOLERANCE = 0.001
#: Bins of a histogram, for each node of the tree.
BINS = 1 << 14
#: Rows that one window of the slot numbering holds, about.
SLOT_ROWS = 4096
#: Tasks that the copies of one text are dealt over.
SALTS = 16
DIM_BITS = 20
HASH_BITS = 40
#: What counts as digits and symbols.
SYMBOLS = "0123456789#*$%&|<>@^_=+~/\\{}[]"


@dataclass
class Node:
    """Shards first to first + count - 1; left and right once it is split."""

    id: int
    first: int
    count: int
    dim: int = 0
    cut: int = 0
    cut_hash: int = 0
    left: "Node | None" = None
    right: "Node | None" = None


#: Dimensions of ``dimensions``; those from DOCUMENT on are the document's, not its text's.
DIMS, DOCUMENT = 5, 3


def dimensions(docs: DataFrame, text: str = "text") -> list[Column]:
    """Length, lines, share of digits and symbols, source and language, as integers of DIM_BITS bits.

    Lengths and lines count by their logarithm; sources and languages are places on a line, by their checksum. Null and
    absent columns are 0.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    top = (1 << DIM_BITS) - 1
    log = lambda c: F.least(F.lit(top), F.floor(F.log2(c.cast("double")) * (top / 40)).cast("int")).cast("long")
    lines = F.length(t) - F.length(F.translate(t, "\n", "")) + 1
    marks = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    share = F.floor(F.lit(top) * marks.cast("long") / F.greatest(F.length(t), F.lit(1))).cast("long")
    code = lambda c: F.shiftright(F.crc32(F.col(c).cast("string")), 32 - DIM_BITS).cast("long") if c in docs.columns else F.lit(0).cast("long")
    return [log(F.octet_length(t) + 8), log(lines), share] + [F.coalesce(code(c), F.lit(0).cast("long")) for c in ("source", "lang")]


def compact(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row for each document: what the tree needs, and the carried columns as a struct ``_row``. Stored, so that row numbers stay.

    All copies of a text get the smallest source and language among them, so that no cut along these parts them.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    dims = dimensions(docs, text)
    own = range(DOCUMENT, DIMS)
    rows = stored(
        docs.select(
            F.struct(*(F.col(f"`{c}`") for c in carry)).alias("_row"),
            (F.octet_length(t) + 8).cast("long").alias("_size"),
            F.crc32(t).alias("_crc"),
            *(d.alias(f"_d{k}") for k, d in enumerate(dims)),
            F.monotonically_increasing_id().alias("_uid"),
            F.xxhash64(t).alias("_text"),
        ),
        "kd",
    )
    groups = rows.groupBy("_text", "_size").agg(*(f(f"_d{k}").alias(f"_{f.__name__}{k}") for k in own for f in (F.min, F.max)))
    mixed = groups.where(" OR ".join(f"_min{k} < _max{k}" for k in own))
    mixed = stored(mixed.select("_text", "_size", *(f"_min{k}" for k in own)), "mixed")
    if mixed.isEmpty():
        return rows.drop("_text")
    # every group stands SALTS times, so that the rows of a large one are dealt over as many tasks
    dealt = mixed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).hint("merge")
    met = rows.withColumn("_salt", F.pmod(F.hash("_uid"), F.lit(SALTS))).join(dealt, ["_text", "_size", "_salt"], "left")
    placed = [F.coalesce(f"_min{k}", f"_d{k}").alias(f"_d{k}") if k in own else F.col(f"_d{k}") for k in range(DIMS)]
    return stored(met.select("_row", "_size", "_crc", *placed, "_uid"), "kd")


def _key(dim: int) -> Column:
    return F.shiftleft(F.col(f"_d{dim}"), 32).bitwiseOR(F.col("_crc"))


def _hash() -> Column:
    return F.xxhash64("_uid").bitwiseAND(F.lit((1 << HASH_BITS) - 1).cast("long"))


def _leaf(node: Node, value) -> Column:
    """value(leaf) of the leaf that a row falls in."""
    if node.left is None:
        return F.lit(value(node))
    key = _key(node.dim)
    left = (key < node.cut) | ((key == node.cut) & (_hash() < node.cut_hash))
    return F.when(left, _leaf(node.left, value)).otherwise(_leaf(node.right, value))


def _narrow(rows: DataFrame, root: Node, goals: dict[int, dict]) -> dict[int, tuple[int, int, int, int]]:
    """For each goal's node: the bin that its target falls in, bytes before it, bytes and rows in it. One job."""
    node = F.col("_node")
    at = None
    for k, g in goals.items():
        key = _hash() if g["hashed"] else _key(g["dim"])
        inside = (node == k) & (key >= g["lo"]) & (key < g["hi"])
        if g["hashed"]:
            inside = inside & (_key(g["dim"]) == g["cut"])
        place = F.call_function("div", key - F.lit(g["lo"]).cast("long"), F.lit(g["width"]).cast("long")).cast("int")
        at = F.when(inside, place) if at is None else at.when(inside, place)
    bins = rows.withColumn("_node", _leaf(root, lambda n: n.id)).where(node.isin(*goals)).select("_node", at.alias("_bin"), "_size").where("_bin is not null")
    weight = bins.groupBy("_node", "_bin").agg(F.sum("_size").alias("w"), F.count("*").alias("n"))
    goal = F.create_map(*(F.lit(x).cast("long") for k, g in goals.items() for x in (k, g["target"])))
    upto = F.sum("w").over(Window.partitionBy("_node").orderBy("_bin"))
    found = weight.withColumn("upto", upto).where((F.col("upto") >= goal[F.col("_node").cast("long")]) & (F.col("upto") - F.col("w") < goal[F.col("_node").cast("long")]))
    return {r["_node"]: (r["_bin"], r["upto"] - r["w"], r["w"], r["n"]) for r in found.select("_node", "_bin", "upto", "w", "n").collect()}


def build(rows: DataFrame, shards: int = SHARDS, dims: int = DIMS) -> Node:
    """The tree over compact rows. The driver holds its nodes, fewer than twice the shards."""
    root = Node(0, 0, shards)
    level, made, whole = [root], 1, None
    while level := [n for n in level if n.count > 1]:
        node = F.col("_node")
        spans = rows.withColumn("_node", _leaf(root, lambda n: n.id)).where(node.isin(*(n.id for n in level))).groupBy("_node").agg(
            F.sum("_size").alias("bytes"), *(f(f"_d{k}").alias(f"{f.__name__}{k}") for k in range(dims) for f in (F.min, F.max))
        )
        goals, seen = {}, {r["_node"]: r for r in spans.collect()}
        for n in level:
            if (r := seen.get(n.id)) is None:
                continue  # no rows: every cut is right
            width = [r[f"max{k}"] - r[f"min{k}"] for k in range(dims)]
            whole = whole or width
            n.dim = max(range(dims), key=lambda k: width[k] / max(whole[k], 1))
            lo, hi = r[f"min{n.dim}"] << 32, (r[f"max{n.dim}"] + 1) << 32
            goals[n.id] = {"node": n, "dim": n.dim, "hashed": False, "cut": 0, "lo": lo, "hi": hi, "width": -(-(hi - lo) // BINS), "target": r["bytes"] * (n.count // 2) // n.count, "slack": int(TOLERANCE * r["bytes"] / n.count)}
        while goals:
            found = _narrow(rows, root, goals)
            for k, g in list(goals.items()):
                n = g["node"]
                if k not in found:  # nothing on the left
                    n.cut, n.cut_hash = (g["cut"], g["lo"]) if g["hashed"] else (g["lo"], 0)
                    del goals[k]
                    continue
                place, before, inside, held = found[k]
                lo = g["lo"] + place * g["width"]
                hi = min(g["hi"], lo + g["width"])
                if inside <= g["slack"] or held == 1 or (g["hashed"] and g["width"] == 1):
                    edge = lo if g["target"] - before < before + inside - g["target"] else hi
                    n.cut, n.cut_hash = (g["cut"], edge) if g["hashed"] else (edge, 0)
                    del goals[k]
                elif g["width"] == 1:  # one text's copies are heavier than the slack: cut among them
                    g |= {"hashed": True, "cut": lo, "lo": 0, "hi": 1 << HASH_BITS, "width": (1 << HASH_BITS) // BINS, "target": g["target"] - before}
                else:
                    g |= {"lo": lo, "hi": hi, "width": -(-(hi - lo) // BINS), "target": g["target"] - before}
        following = []
        for n in level:
            half = n.count // 2
            n.left, n.right = Node(made, n.first, half), Node(made + 1, n.first + half, n.count - half)
            made += 2
            following += [n.left, n.right]
        level = following
    return root


def assign(rows: DataFrame, root: Node) -> DataFrame:
    """Compact rows with ``shard`` and ``slot``, a number without gaps in the shard.

    Rows are numbered in buckets of about SLOT_ROWS rows, and each bucket starts where those before it end, so no
    task ever holds a shard.
    """
    n = rows.count()
    buckets = max(1, -(-n // SLOT_ROWS))
    placed = rows.withColumn("shard", _leaf(root, lambda x: x.first).cast("int")).withColumn("_bucket", F.pmod(F.hash("_uid"), F.lit(buckets)))
    numbered = placed.withColumn("_at", F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_uid")))
    starts = placed.groupBy("shard", "_bucket").agg(F.count("*").alias("n"))
    starts = starts.select("shard", "_bucket", (F.sum("n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("n")).alias("_start"))
    return numbered.join(starts, ["shard", "_bucket"]).withColumn("slot", (F.col("_start") + F.col("_at") - 1).cast("long")).drop("_bucket", "_at", "_start")


def shard(docs: DataFrame, shards: int = SHARDS, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns as a struct ``_row``, with _size, _crc, shard and slot.

    A null text weighs 8 bytes, as an empty one does. Texts of any length are weighed whole. Repeated rows are rows of
    their own. An empty table gives no rows. Columns of docs may have any name, carried or not.
    """
    rows = compact(docs, text, carry)
    return assign(rows, build(rows, shards))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS) -> None:
    """The whole documents, one folder for each shard, named ``shard`` (with an underscore after it where docs has such a column)."""
    name = fresh(docs.columns, "shard")
    out = shard(docs, shards, carry=tuple(docs.columns)).select("_row.*", F.col("shard").alias(name))
    out.write.partitionBy(name).parquet(path)


def op6_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"))
    return out.select("_row.doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
