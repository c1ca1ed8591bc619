import numpy as np

from quire.llm import nn_descent as N

SCHEMA = "vec_id long, embedding array<float>, label int, kept string"


def brute(rows, cosine=0.93):
    unit = []
    for _, v, label, _ in rows:
        x = None if v is None or label is None or None in v else np.array(v, dtype=np.float32).astype(float)
        unit.append(x / np.linalg.norm(x) if x is not None and len(x) and np.isfinite(x).all() and x.any() else None)
    n = len(rows)
    link = [[j for j in range(n) if j != i and unit[i] is not None and unit[j] is not None and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= cosine] for i in range(n)]
    comp = [r[0] for r in rows]
    moved = True
    while moved:
        moved = False
        for i in range(n):
            low = min([comp[i], *(comp[j] for j in link[i])])
            moved |= low < comp[i]
            comp[i] = low
    return sorted((rows[i][0], len(link[i]), comp[i], rows[i][0] == comp[i]) for i in range(n))


def test_matches_brute_force(spark):
    rng = np.random.default_rng(4)
    rows = []
    for k in range(60):
        centre = rng.normal(size=16)
        for spread in (0, 0.02, 0.05, 0.09, 0.14) if k % 3 == 0 else (0,):
            rows.append((len(rows), (centre + spread * rng.normal(size=16)).astype(np.float32).tolist(), k % 2, ""))
    hot = rng.normal(size=16)
    rows += [(1000 - i, (hot + 0.05 * rng.normal(size=16)).astype(np.float32).tolist(), 1, "") for i in range(150)]
    rows += [(2000 + i, hot.astype(np.float32).tolist(), 1, "") for i in range(60)]
    arc = [(3000 + i, [float(np.cos(i / 5)), float(np.sin(i / 5))], 7, "") for i in range(25)]  # a chain of links
    odd = [(4000, None, 1, ""), (4001, [0.0, 0.0], 1, ""), (4002, [1.0, None], 1, ""), (4003, [1.0, float("nan")], 1, ""), (4004, [1.0, 2.0], None, ""), (4005, [], 1, ""), (4006, [1e38, 1e38], 9, ""), (4007, [1.0, 1.0], 9, ""), (4008, [1.0] * 16, 1, "")]
    rows += arc + odd
    out = N.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted(map(tuple, out.collect())) == brute(rows)


def test_empty(spark):
    assert N.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def planted(n, pairs, seed, label=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for k in range(pairs):
        away = rng.normal(size=64)
        away -= away @ x[2 * k] * x[2 * k]
        c = rng.uniform(0.931, 0.945)
        x[2 * k + 1] = c * x[2 * k] + np.sqrt(1 - c * c) * away / np.linalg.norm(away)
    return [(k, v.tolist(), label) for k, v in enumerate(x)]


def test_no_planted_pair_is_lost(spark):
    """Pairs just over the threshold among random vectors, where neighbours of neighbours tell little."""
    report = []
    table = spark.createDataFrame(planted(3000, 60, 3), "vec_id long, embedding array<double>, label int").repartition(4)
    out = {r.vec_id: (r.n_links, r.component_id) for r in N.near_duplicates(table, report=report).collect()}
    assert out == {k: (1, k - k % 2) if k < 120 else (0, k) for k in range(3000)}
    assert report[-1] == {"finished exactly": True} and 0 < report[0]["held"] <= report[0]["audited"] <= 120


def test_descent_alone_is_enough_where_links_are_many(spark, monkeypatch):
    """Chains of neighbours: the descent finds all pairs that an audit of many tells of, and nothing is finished exactly."""
    monkeypatch.setattr(N, "TOLD", 100)
    turn = 2 * np.pi / 1500
    rows = [(k, [float(np.cos(k * turn)), float(np.sin(k * turn)), 0.1 * (k % 3)], k % 2) for k in range(1500)]
    report = []
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in N.near_duplicates(table, 0.999, report).collect())
    assert out == brute([(*r, "") for r in rows], 0.999) and report[-1] == {"finished exactly": False}


def test_labels_finished_exactly(spark, monkeypatch):
    monkeypatch.setattr(N, "PACK", 70)
    monkeypatch.setattr(N, "BLOCK", 100)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(500, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    radius = rng.uniform(0, 0.05, 500)
    nodes = spark.createDataFrame([(k, "big" if k < 420 else "small", v.astype("<f8").tobytes(), float(r)) for k, (v, r) in enumerate(zip(x, radius))], "id long, grp string, unit binary, radius double")
    angle = np.arccos(np.clip(x @ x.T, -1, 1))
    expected = {(i, j) for i in range(420) for j in range(i + 1, 420) if angle[i, j] <= 0.5 + radius[i] + radius[j]}
    assert {tuple(r) for r in N.linkable(nodes, 0.5).collect()} == expected and len(expected) > 500


def test_pair_at_the_threshold(spark):
    """In two dimensions the cosine of (1, 0) and (3, 4) is 0.6 exactly."""
    rows = [(1, [1.0, 0.0], 0), (2, [3.0, 4.0], 0), (3, [-1.0, 0.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links = lambda c: {r.vec_id: r.n_links for r in N.near_duplicates(table, c).collect()}
    assert links(0.6 - 1e-9) == {1: 1, 2: 1, 3: 0} and links(0.6 + 1e-9) == {1: 0, 2: 0, 3: 0}
