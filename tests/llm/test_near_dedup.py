import random

from pyspark.sql import functions as F

from quire.llm import near_dedup as N

SCHEMA = "doc_id long, text string"


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows, similarity=0.8):
    made = [grams(t) for _, t in rows]
    near = lambda a, b: a == b or len(a & b) >= similarity * len(a | b)
    comp = [d for d, _ in rows]
    moved = True
    while moved:
        moved = False
        for i in range(len(rows)):
            low = min(comp[j] for j in range(len(rows)) if near(made[i], made[j]))
            moved |= low < comp[i]
            comp[i] = min(low, comp[i])
    return sorted(zip((d for d, _ in rows), comp))


def sample():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows = [(500, None), (501, ""), (502, "one two"), (503, "One  two"), (504, "one two three")]
    for k in range(25):
        base = [word() for _ in range(200)]
        for changed in range(0, 9, 1 + k % 3):
            words = list(base)
            for at in rng.sample(range(5, 195), changed):
                words[at] = word()
            rows.append((len(rows), " ".join(words)))
    base = [word() for _ in range(120)]
    for k in range(30):  # a chain: each is near the next only
        rows.append((1000 - k, " ".join(base)))
        base = base[3:] + [word() for _ in range(3)]
    return rows


def test_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "BLOCK", 4)
    rows = sample()
    got = sorted((r.doc_id, r.component_id) for r in N.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect())
    assert got == brute(rows)


def test_stage_drops_copies_with_other_words(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(10**6)}" for _ in range(200)]
    near, far = list(words), list(words)
    near[60], near[140] = "other", "words"  # 186 of 206 shingles
    for k in range(10, 200, 20):
        far[k] = f"far{k}"
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(far))], SCHEMA)
    assert sorted(r.doc_id for r in N.stage(spark, docs, "").collect()) == [1, 3]


def test_stage_tells_rows_of_one_id_apart(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(f"w{rng.randrange(10**6)}" for _ in range(100)) for _ in range(3))
    stays = lambda rows: sorted(map(tuple, N.stage(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), "").collect()), key=str)
    assert stays([(3, b + " more"), (5, a), (5, b)]) == [(3, b + " more"), (5, a)]
    assert stays([(7, a), (7, b), (8, c)]) == [(7, a), (7, b), (8, c)]
    one = stays([(7, a), (7, a + " more"), (7, a), (9, a.upper())])
    assert len(one) == 1 and one[0][0] == 7 and one == stays([(9, a.upper()), (7, a + " more"), (7, a)])
    assert len(stays([(None, a), (None, a), (2, a), (2, a), (2, None), (4, "")])) == 4


def test_stage_keeps_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 2), (2, "A  b", "y", 3)], "doc_id int, text string, mark string, own int").withColumn("key", F.lit(1)).withColumn("component", F.lit(None).cast("string"))
    out = N.stage(spark, docs, "")
    assert out.schema.simpleString() == docs.schema.simpleString() and [r.mark for r in out.collect()] == ["x"]
    assert N.stage(spark, docs.limit(0), "").count() == 0


def test_empty_table(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_near_fingerprints_are_found_by_their_bit_planes(spark):
    rng = random.Random(13)
    rows = []
    for k in range(6):
        words = [f"w{rng.randrange(10**6)}" for _ in range(3000)]
        rows += [(10 * k, " ".join(words)), (10 * k + 1, " ".join([*words, "more"]))]
    rows.append((100, None))
    sets = N.sets(spark.createDataFrame(rows, SCHEMA))
    name = {r.key: r.doc_id for r in sets.collect()}
    prints = {r.doc_id: r.fp for r in sets.collect()}
    apart = {k: bin((prints[10 * k] ^ prints[10 * k + 1]) & (1 << 64) - 1).count("1") for k in range(6)}
    assert prints[100] is None and any(n <= 2 for n in apart.values())
    found = {tuple(sorted((name[r.a], name[r.b]))) for r in N.by_fingerprint(sets.where("fp is not null").select("key", "fp")).collect()}
    assert found == {(10 * k, 10 * k + 1) for k, n in apart.items() if n <= 2}
