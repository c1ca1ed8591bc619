"""The trie of conversations' prefixes, from the neighbours in their sorted order.

1. A turn becomes a digest of its role and text; a conversation is the row of its digests, which sorts as the trie does.
2. Conversations are dealt by ranges of that order. In each block of a range, sorted neighbours are joined by edges of the
   length of their longest common prefix, and a union-find takes these in descending depth: a component climbs to the
   edge's depth, a node for each step, and every merge of two components makes their branching node there.
3. Nodes on a block's first or last conversation may go on across its boundary, all others are finished. A forest is
   contracted to these two paths, and the paths of neighbouring blocks and partitions are merged in rounds of GROUP
   forests, each of which finishes the nodes that no longer touch a boundary. The last round finishes the root.

Copies of a conversation are counted while they stream by; their ids are cut into pieces, so a group of any size is dealt
over many tasks and only its digest is made in order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WORD, read, stored

#: Bytes of a turn's digest.
TURN = 16
#: Distinct conversations of a block, forests merged at once, and bytes of one piece of ids.
BLOCK, GROUP, PIECE = 1 << 14, 64, 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()

#: kind 0: a finished node; 1: an open one; 2: a piece of the ids that end at a node. ``ref`` and ``up`` stand for a node's
#: and its parent's prefix, where other rows may have to find it. ``sha`` is null where the pieces will tell.
ROWS = (
    "kind int, part long, ref binary, up binary, depth long, conv_id long, parent long, n long, kids long, leaves long, saved long,"
    " words long, first boolean, last boolean, sha string, ids binary"
)
_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
SCHEMA = pa.schema([(c.strip().split()[0], _KINDS[c.strip().split()[1]]) for c in ROWS.split(",")])


def sequences(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns binary, words array<int>): for each conversation its turns' digests in order, and the words of each text."""
    part = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    whole = F.concat(F.octet_length(part(role)).cast("string"), F.lit(":"), part(role), part(text))
    digest = F.substring(F.unhex(F.sha2(whole, 256)), 1, TURN)
    words = F.regexp_count(part(text), F.lit(WORD)).cast("int")
    each = turns.where(F.col(f"`{conv_id}`").isNotNull()).select(F.col(f"`{conv_id}`").cast("long").alias("conv_id"), F.struct(F.col(f"`{turn}`").alias("turn"), digest.alias("d"), words.alias("w")).alias("t"))
    ordered = each.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    joined = F.unhex(F.array_join(F.transform("t", lambda x: F.hex(x["d"])), ""))
    return ordered.select("conv_id", joined.alias("turns"), F.transform("t", lambda x: x["w"]).alias("words"))


def rebuilt(own: DataFrame, family: int = 20, heads: int = 4) -> DataFrame:
    """Each conversation c with the first h turns of conversation c - c % family before its own turns after its first h; h = crc32(c) % heads."""
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    head = own.where(F.col("conv_id") % family == 0).select(F.col("conv_id").alias("base"), F.substring("turns", 1, TURN * (heads - 1)).alias("head"), F.slice("words", 1, heads - 1).alias("head_words"))
    joined = own.withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % family).join(head, "base", "left")
    start = F.substring(F.coalesce("head", F.lit(b"")), F.lit(1), F.col("h") * TURN)
    start_words = F.slice(F.coalesce("head_words", F.array().cast("array<int>")), F.lit(1), F.col("h"))
    rest = F.substring("turns", F.col("h") * TURN + 1, F.length("turns"))
    rest_words = F.slice("words", F.col("h") + 1, F.greatest(F.size("words") - F.col("h"), F.lit(0)))
    return joined.select("conv_id", F.concat(start, rest).alias("turns"), F.concat(start_words, rest_words).alias("words"))


def common(a: bytes, b: bytes) -> int:
    """Turns of the longest common prefix."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        low, high = (mid, high) if a[: mid * TURN] == b[: mid * TURN] else (low, mid - 1)
    return low


def references(turns: bytes) -> list[bytes]:
    """What stands for each prefix, from the root on."""
    running, found = hashlib.sha256(), []
    for k in range(len(turns) // TURN + 1):
        found.append(running.copy().digest()[:TURN])
        running.update(turns[k * TURN : (k + 1) * TURN])
    return found


class Open:
    """A node that may go on beyond its forest. kids, leaves and saved are those of its finished children alone."""

    __slots__ = ("conv", "depth", "first", "kids", "last", "leaves", "n", "ref", "saved", "sha", "up", "words")

    def __init__(self, ref: bytes, up: bytes | None, depth: int, words: int):
        self.ref, self.up, self.depth, self.words = ref, up, depth, words
        self.conv, self.n, self.kids, self.leaves, self.saved = None, 0, 0, 0, 0
        self.first = self.last = False
        self.sha: str | None = NOTHING

    def add(self, other: "Open") -> None:
        self.conv = other.conv if self.conv is None else min(self.conv, other.conv)
        for c in ("n", "kids", "leaves", "saved"):
            setattr(self, c, getattr(self, c) + getattr(other, c))
        if other.sha != NOTHING:
            self.sha = other.sha

    def row(self, part: int) -> dict:
        return {
            "kind": 1, "part": part, "ref": self.ref, "up": self.up, "depth": self.depth, "conv_id": self.conv, "n": self.n, "kids": self.kids,
            "leaves": self.leaves, "saved": self.saved, "words": self.words, "first": self.first, "last": self.last, "sha": self.sha,
        }


def merged(forests: list[dict[bytes, Open]], whole: bool = False) -> tuple[list[dict], dict[bytes, Open]]:
    """(finished nodes, open nodes) of neighbouring forests, in order. whole: there are no others, so all nodes are finished."""
    nodes: dict[bytes, Open] = {}
    for at, forest in enumerate(forests):
        for ref, x in forest.items():
            if (node := nodes.get(ref)) is None:
                node = nodes[ref] = Open(ref, x.up, x.depth, x.words)
            node.add(x)
            node.first |= x.first and at == 0
            node.last |= x.last and at == len(forests) - 1
    done = []
    for x in sorted(nodes.values(), key=lambda x: -x.depth):
        if whole or not (x.first or x.last):
            leaves, saved = x.leaves if x.kids else 1, x.saved + (x.n - 1) * x.words
            up = nodes[x.up] if x.up is not None else None
            known = up is not None and (whole or not (up.first or up.last))  # then its smallest member is
            done.append({"kind": 0, "ref": x.ref, "up": None if known else x.up, "depth": x.depth, "conv_id": x.conv, "parent": up.conv if known else None, "n": x.n, "kids": x.kids, "leaves": leaves, "saved": saved, "sha": x.sha})
            if up is not None:
                up.kids, up.leaves, up.saved = up.kids + 1, up.leaves + leaves, up.saved + saved
            del nodes[x.ref]
    return done, nodes


def forest(block: list[tuple[bytes, list[int], int, int, str | None]]) -> tuple[list[dict], dict[bytes, Open]]:
    """(finished nodes, open nodes) of distinct conversations (turns, words, copies, smallest id, digest of ids), sorted."""
    m = len(block)
    refs = {0: references(block[0][0]), m - 1: references(block[-1][0])}
    parent = list(range(m))
    depth = [len(b[0]) // TURN for b in block]
    n, low, sha = [b[2] for b in block], [b[3] for b in block], [b[4] for b in block]
    kids, leaves, saved = [0] * m, [0] * m, [0] * m
    waits: list[list[dict]] = [[] for _ in range(m)]  # finished children, which don't know their parent's smallest member yet
    touches: list[int | None] = [None] * m  # the first or last conversation, where the component holds it
    touches[0], touches[m - 1] = 0, m - 1
    done: list[dict] = []
    nodes: dict[bytes, Open] = {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def finish(c: int) -> None:
        """The component's node at its depth is complete as far as this block goes; the component climbs one step."""
        d = depth[c]
        words = block[c][1][d - 1] if d else 0
        if (edge := touches[c]) is None:
            here, below = leaves[c] if kids[c] else 1, saved[c] + (n[c] - 1) * words
            for w in waits[c]:
                w["parent"] = low[c]
            row = {"kind": 0, "depth": d, "conv_id": low[c], "n": n[c], "kids": kids[c], "leaves": here, "saved": below, "sha": sha[c]}
            done.append(row)
            waits[c], kids[c], leaves[c], saved[c] = [row], 1, here, below
        else:
            ref = refs[edge][d]
            for w in waits[c]:
                w["up"] = ref
            x = nodes[ref] = Open(ref, refs[edge][d - 1] if d else None, d, words)
            x.conv, x.n, x.kids, x.leaves, x.saved, x.sha = low[c], n[c], kids[c], leaves[c], saved[c], sha[c]
            waits[c], kids[c], leaves[c], saved[c] = [], 0, 0, 0
        depth[c], sha[c] = d - 1, NOTHING

    edges = [common(block[i - 1][0], block[i][0]) for i in range(1, m)]
    for i in sorted(range(m - 1), key=lambda i: -edges[i]):
        a, b = root(i), root(i + 1)
        for c in (a, b):
            while depth[c] > edges[i]:
                finish(c)
        if len(waits[a]) < len(waits[b]):
            a, b = b, a
        parent[b] = a
        waits[a] += waits[b]
        waits[b] = []
        n[a], low[a], kids[a], leaves[a], saved[a] = n[a] + n[b], min(low[a], low[b]), kids[a] + kids[b], leaves[a] + leaves[b], saved[a] + saved[b]
        sha[a] = sha[a] if sha[a] != NOTHING else sha[b]
        touches[a] = touches[a] if touches[a] is not None else touches[b]
    last = root(0)
    while depth[last] >= 0:
        finish(last)
    for ref in refs[0]:
        nodes[ref].first = True
    for ref in refs[m - 1]:
        nodes[ref].last = True
    return done, nodes


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in SCHEMA], schema=SCHEMA)


def _grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's forest, from (conv_id, turns, words) sorted by turns and conv_id."""
    part = TaskContext.get().partitionId()
    block: list[tuple] = []
    state: dict[bytes, Open] | None = None
    out: list[dict] = []
    key = None
    words: list[int] = []
    copies = low = 0
    piece: list[str] = []  # ids of this key that are not sent yet
    running = hashlib.sha256()
    begun = False  # a key other than the partition's first one has come

    def send() -> None:
        """The ids gathered: to the digest and, as other partitions may hold more of them, to the pieces of the first or last key."""
        if piece:
            ids = ",".join(piece).encode()
            running.update(ids if sent == 0 else b"," + ids)
            pieces.append({"kind": 2, "part": part, "ref": None, "conv_id": int(piece[0]), "ids": ids})

    def close(edge: bool) -> None:
        """The key is over. On the partition's edge its pieces go out, and its digest is left to them."""
        if key is not None:
            if edge:
                ref = references(key)[-1]
                out.extend(p | {"ref": ref} for p in pieces)
            block.append((key, words, copies, low, None if edge else running.hexdigest()))

    def grow() -> None:
        nonlocal state, block
        done, nodes = forest(block)
        out.extend(done)
        if state is not None:
            done, nodes = merged([state, nodes])
            out.extend(done)
        state, block = nodes, []

    pieces: list[dict] = []
    sent = size = 0
    for b in batches:
        for conv, turns, w in zip(*(b.column(k).to_pylist() for k in range(3))):
            if turns != key:
                if key is not None:
                    send()
                    close(not begun)
                    begun = True
                    if len(block) >= BLOCK:
                        grow()
                key, words, copies, low = turns, w, 0, conv
                piece, pieces, running, sent, size = [], [], hashlib.sha256(), 0, 0
            copies, low = copies + 1, min(low, conv)
            piece.append(str(conv))
            size += len(piece[-1]) + 1
            if size >= PIECE:
                send()
                sent += len(piece)
                piece, size = [], 0
                if not begun:
                    ref = references(key)[-1]
                    out.extend(p | {"ref": ref} for p in pieces)
                    pieces = []
            if len(out) >= BLOCK:
                yield _batch(out)
                out.clear()
    if key is not None:
        send()
        close(True)
        grow()
        out.extend(x.row(part) for x in state.values())
    yield _batch(out)


def _opened(r: dict) -> Open:
    x = Open(r["ref"], r["up"], r["depth"], r["words"])
    x.conv, x.n, x.kids, x.leaves, x.saved, x.first, x.last, x.sha = (r[c] for c in ("conv_id", "n", "kids", "leaves", "saved", "first", "last", "sha"))
    return x


def _contract(open_: DataFrame, whole: bool) -> DataFrame:
    """One round: the forests of every GROUP neighbouring parts become one."""
    names = [f.name for f in SCHEMA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush() -> pa.RecordBatch:
            done, nodes = merged(forests, whole)
            return _batch([*done, *(x.row(at[0]) for x in nodes.values())])

        forests: list[dict[bytes, Open]] = []
        at: tuple = (None, None)
        for b in batches:
            for r in b.to_pylist():
                if (r["part"] // GROUP, r["part"]) != at:
                    if forests and at[0] != r["part"] // GROUP:
                        yield flush()
                        forests = []
                    at = (r["part"] // GROUP, r["part"])
                    forests.append({})
                forests[-1][r["ref"]] = _opened(r)
        if forests:
            yield flush()

    dealt = open_.select(*names).repartition(F.floor(F.col("part") / GROUP)).sortWithinPartitions("part")
    return dealt.mapInArrow(run, ROWS)


def _digests(pieces: DataFrame) -> DataFrame:
    """(ref, sha): the digest of each node's ids in ascending order, from its pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, running = None, None
        for b in batches:
            found = []
            for ref, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if ref != key:
                    if key is not None:
                        found.append((key, running.hexdigest()))
                    key, running = ref, hashlib.sha256(ids)
                else:
                    running.update(b"," + ids)
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.string())], ["ref", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([running.hexdigest()])], ["ref", "sha"])

    # one key's pieces are of 64 KB each, and a hash can't be made but in order
    dealt = pieces.select("ref", "conv_id", "ids").repartition("ref").sortWithinPartitions("ref", "conv_id").select("ref", "ids")
    return dealt.mapInArrow(run, "ref binary, sha string")


def trie(found: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) for each node of the trie
    of (conv_id, turns binary, words array<int>). No conversations make no root."""
    parts = parts or int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = found.select("conv_id", "turns", "words").repartitionByRange(parts, "turns", "conv_id").sortWithinPartitions("turns", "conv_id")
    grown = stored(dealt.mapInArrow(_grown, ROWS), "forests")
    open_ = grown.where("kind = 1")
    forests = open_.agg((F.coalesce(F.max("part"), F.lit(-1)) + 1).alias("n")).first()["n"]
    nodes = grown.where("kind = 0")
    while forests:
        forests = -(-forests // GROUP)
        made = stored(_contract(open_, forests == 1), "forests")
        nodes, open_ = nodes.union(made.where("kind = 0")), made.where("kind = 1")
        forests = 0 if forests == 1 else forests
    # most nodes know their parent's smallest member and their digest: only the others are joined
    ups = nodes.where("ref is not null").select(F.col("ref").alias("up"), F.col("conv_id").alias("parent"))
    rest = nodes.where("up is not null").drop("parent").join(ups, "up").select(*nodes.columns)
    nodes = nodes.where("up is null").union(rest)
    rest = nodes.where("sha is null").drop("sha").join(_digests(grown.where("kind = 2")), "ref").select(*nodes.columns)
    nodes = nodes.where("sha is not null").union(rest)
    names = {"parent": "parent_conv_id", "n": "n_convs", "kids": "n_children", "leaves": "n_leaves", "saved": "saved_tokens", "sha": "ends_sha256"}
    return nodes.select("conv_id", "depth", *(F.col(c).alias(name) for c, name in names.items()))


def conversation_trie(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", rebuild: bool = False) -> DataFrame:
    """The trie's nodes over a table of turns; rebuild: of the conversations as ``rebuilt`` makes them.

    A null role or text is empty; a null turn comes first; equal turn numbers, repeated rows among them, follow one another
    in the order of their digests, each a turn of its own. Rows without a conversation id belong to none. No rows give no
    rows, not even a root. A conversation is one row of TURN bytes and a word count a turn; its texts may be of any length.
    Other columns don't matter.
    """
    own = stored(sequences(turns, conv_id, turn, role, text), "conversations")
    return trie(stored(rebuilt(own), "rebuilt") if rebuild else own)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"), rebuild=True)


#: crc32 isn't among DuckDB's functions: h goes by its polynomial, over the bits of the decimal's bytes.
OP13_SQL = r"""
WITH t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST) AS s FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, s, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda b: [ord(b)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 4 AS h FROM t
), r AS (
  SELECT a.conv_id, list_concat(coalesce(b.s[1:a.h], []), a.s[a.h + 1:]) AS s FROM h a LEFT JOIN t b ON b.conv_id = a.conv_id - a.conv_id % 20
), p AS (
  SELECT conv_id, d, s[1:d] AS node, CASE WHEN d > 0 THEN s[1:d - 1] END AS up, len(s) = d AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)
), n AS (
  SELECT node, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS sha,
    CASE WHEN d > 0 THEN (count(*) - 1) * len(regexp_extract_all(node[d].t, '[^\x20\x09-\x0D]+')) ELSE 0 END AS own
  FROM p GROUP BY node, d
), k AS (SELECT up AS node, count(*) AS kids FROM n WHERE d > 0 GROUP BY up
), m AS (
  SELECT node[1:j] AS node, j AS d, sum(own)::BIGINT AS saved, count(*) FILTER (leaf) AS leaves
  FROM (SELECT n.node, n.own, kids IS NULL AS leaf, unnest(range(0, n.d + 1)) AS j FROM n LEFT JOIN k USING (node)) GROUP BY ALL
)
SELECT n.conv_id, n.d AS depth, q.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(kids, 0)::BIGINT AS n_children, leaves AS n_leaves, saved AS saved_tokens, n.sha AS ends_sha256
FROM n JOIN m USING (node, d) LEFT JOIN k USING (node) LEFT JOIN n q ON q.node = n.up
"""
