import random

import pytest
import xxhash

from quire.llm import near_dedup
from quire.llm import simhash as S

SCHEMA = "doc_id long, text string, component_id string"


def brute(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def closure(prints):
    ids = {}
    for d, fp in prints:
        ids[fp] = min(d, ids.get(fp, d))
    comp = {fp: r for fp, r in ids.items()}
    moved = True
    while moved:
        moved = False
        for a in comp:
            for b in comp:
                if (a ^ b).bit_count() <= 2 and comp[b] < comp[a]:
                    comp[a], moved = comp[b], True
    return [comp[fp] for _, fp in prints]


def test_fingerprints_and_components(spark):
    rng = random.Random(1)
    base = " ".join(rng.choice("abcdefghij") * 3 for _ in range(400)).split()
    texts = [None, "", " \t\n", "One", "one", "One two", "a b c", "A\x0bB\x0cC", "é x y z w"] + [" ".join(base)] * 5
    for k in range(60):
        words = list(base)
        for _ in range(k % 4):
            words[rng.randrange(400)] = "zz"
        texts.append(" ".join(words))
    texts.append("word " * 70_000)
    rows = [(1000 - i, t, "clash") for i, t in enumerate(texts)] + [(1000, None, "again")]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    prints = [(d, brute(t)) for d, t, _ in rows]
    assert got == {(d, f"{fp:016x}", c) for (d, fp), c in zip(prints, closure(prints))}


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_slices(radius):
    rng = random.Random(radius)
    values = [rng.getrandbits(64) for _ in range(40)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), k)) for v in values[:20] for k in range(1, 7)]
    planes, every = S.planes_of(values), (1 << len(values)) - 1
    for v in values:
        assert S.near(v, planes, every, radius) == sum(1 << j for j, w in enumerate(values) if (v ^ w).bit_count() <= radius)


def test_large_buckets_are_cut(spark, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 4)
    rng = random.Random(3)
    top = rng.getrandbits(32) << 32
    fps = list({(top | rng.getrandbits(5) << rng.choice([0, 9, 20])) - (1 << 64 if top >> 63 else 0) for _ in range(60)})
    classes = spark.createDataFrame([(fp, i) for i, fp in enumerate(fps)], "fp long, rep long")
    got = {r.node: r.component for r in S.components(S.links(classes)).collect()}
    prints = [(i, fp & (1 << 64) - 1) for i, fp in enumerate(fps)]
    assert [got.get(i, i) for i in range(len(fps))] == closure(prints)


def test_empty_table_and_stage(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicates(empty).count() == 0
    docs = spark.createDataFrame([(3, "a b c d", "x"), (1, "A b c d", "y"), (1, "a b c d", "z"), (7, "e f g h", "w"), (None, "i j k", "v")], SCHEMA)
    kept = near_dedup.stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 7]
