import hashlib
import random
import re
import zlib

import pytest

from quire.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows, rebuild=True):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[: T.TURN]
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, (role, text)))
    own = {c: [t[3] for t in sorted(v)] for c, v in own.items()}
    made = own
    if rebuild:
        made = {}
        for c, turns in own.items():
            h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20 if c >= 0 else -(abs(c) % 20))
            made[c] = own.get(base, [])[:h] + turns[h:]
    members, ends = {}, {}
    for c, turns in made.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    words = lambda node: len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
    kids, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for node in members:
        if node:
            kids[node[:-1]] += 1
    for node, m in members.items():
        for d in range(len(node) + 1):
            saved[node[:d]] += (len(m) - 1) * words(node)
            leaves[node[:d]] += not kids[node]
    sha = lambda node: hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else -1, len(m), kids[node], leaves[node], saved[node], sha(node)) for node, m in members.items())


def answered(found):
    return sorted(tuple(-1 if v is None else v for v in r) for r in found.collect())


def made(seed, convs, letters="ab"):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-40, 4 * convs), convs):
        for k in range(rng.choice([1, 1, 2, 3, 5, 8])):
            rows.append((c, k, rng.choice(["user", "assistant"]), " ".join(rng.choices(letters, k=2)), "clash"))
    hot = [(c, k, "user", "the same", "") for c in range(1000, 1000 + convs // 2) for k in range(5)]
    return rows + hot


@pytest.mark.parametrize(("block", "group", "piece"), [(1 << 14, 64, 1 << 16), (3, 2, 20), (1, 2, 1)])
def test_matches_brute_force(spark, monkeypatch, block, group, piece):
    for name, value in (("BLOCK", block), ("GROUP", group), ("PIECE", piece)):
        monkeypatch.setattr(T, name, value)
    rows = made(block, 160)
    rows += [(1, None, None, None, ""), (1, None, "user", None, ""), (None, 1, "user", "none", ""), (7777, 3, "", "", ""), (8880, 1, "user", "word " * 5000, ""), (8881, 1, "user", "word " * 5000, "")]
    table = spark.createDataFrame(rows, SCHEMA).repartition(5)
    own = T.rebuilt(T.sequences(table))
    for parts in (1, 7):
        assert answered(T.trie(own, parts)) == brute(rows)
    if block == 3:
        assert answered(T.conversation_trie(table)) == brute(rows, rebuild=False)


def test_no_conversations(spark):
    assert T.conversation_trie(spark.createDataFrame([], SCHEMA), rebuild=True).count() == 0
    assert T.conversation_trie(spark.createDataFrame([(None, 1, "a", "b", "")], SCHEMA)).count() == 0


def test_one_turnless_conversation(spark):
    """Conversation 3 takes three turns from one that isn't there and keeps none of its own two."""
    c = next(c for c in range(1, 20) if zlib.crc32(str(c).encode()) % 4 == 3)
    rows = [(c, k, "user", "x", "") for k in range(2)]
    assert answered(T.conversation_trie(spark.createDataFrame(rows, SCHEMA), rebuild=True)) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_common_and_references():
    a, b = b"x" * 32 + b"y" * 16, b"x" * 32 + b"z" * 32
    assert T.common(a, b) == 2 and T.common(a, a) == 3 and T.common(b"", a) == 0
    assert T.references(a)[:3] == T.references(b)[:3] and T.references(a)[3] != T.references(b)[3]
