import hashlib

import duckdb
import numpy as np
import pytest

from quire.llm import va_file as V

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute(rows, size=64, k=8, rounds=10):
    kept = []
    for i, v, *_ in rows:
        if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v):
            kept.append((i, [int(np.floor(1024 * x)) for x in v]))
    first = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    centres = [v for _, v in first]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda: [min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for _, v in kept]
    for _ in range(rounds):
        now = near()
        for c in range(len(centres)):
            mine = [v for (_, v), n in zip(kept, now) if n == c]
            if mine:
                centres[c] = [sum(x) // len(mine) for x in zip(*mine)]
    now = near()
    return sorted((-1 if i is None else i, c, far(v, centres[c])) for (i, v), c in zip(kept, now)), centres


def answered(found):
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance) for r in found.collect())


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(6, 64))
    rows = [(k, (centres[k % 6] + (0.3 if k % 2 else 1.0) * rng.normal(size=64)).tolist(), "clash") for k in range(240)]
    rows += [(1000 + k, rows[0][1], "") for k in range(120)]  # a third are one vector
    rows += [(7, rows[7][1], ""), (7, rows[8][1], ""), (None, rows[9][1], ""), (2000, [0.0] * 64, ""), (2001, [-0.0] * 64, ""), (2002, [1000.0] * 64, ""), (2003, [-0.0001] * 64, "")]
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("inf")] + [0.0] * 63]
    return rows + [(3000 + k, v, "") for k, v in enumerate(bad)]


def test_matches_brute_force(spark, rows, monkeypatch):
    monkeypatch.setattr(V, "SLICE", 50)
    monkeypatch.setattr(V, "BATCH", 16)
    found, report = V.clusters(spark.createDataFrame(rows, SCHEMA).repartition(3))
    expected, centres = brute(rows)
    assert answered(found) == expected
    assert [r["components"] for r in report if "centroid" in r] == centres
    fetched = [r for r in report if "round" in r]
    assert len(fetched) == 10 and all(r["vectors"] == len(expected) for r in fetched) and fetched[-1]["fetched"] < 0.2 * len(expected)


def test_query_and_sql(spark, rows, tmp_path):
    own = [r for r in rows if r[0] is not None and r[0] != 7]
    spark.createDataFrame(own, "vec_id long, embedding array<float>, cluster string").write.parquet(f"{tmp_path}/embeddings.parquet")
    mine = V.op12_va_file(spark, str(tmp_path))
    base = duckdb.connect()
    base.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    told = base.sql(V.OP12_SQL)
    assert mine.columns == told.columns and sorted(map(tuple, mine.collect())) == sorted(told.fetchall())


@pytest.mark.parametrize("k", [0, 1, 3])
def test_few_vectors(spark, rows, k):
    found, _ = V.clusters(spark.createDataFrame(rows[:k], SCHEMA))
    assert answered(found) == (brute(rows[:k])[0] if k else [])


def test_empty_query(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert V.op12_va_file(spark, str(tmp_path)).count() == 0


def test_other_sizes(spark, rows):
    """Other numbers of components, clusters and rounds."""
    table = [(i, v[:7], "") for i, v, _ in rows[:100]]
    found, report = V.clusters(spark.createDataFrame(table, SCHEMA), size=7, clusters=3, rounds=2)
    expected, centres = brute(table, 7, 3, 2)
    assert answered(found) == expected and [r["components"] for r in report if "centroid" in r] == centres
    found, _ = V.clusters(spark.createDataFrame(table, SCHEMA), size=7, clusters=3, rounds=0)
    assert answered(found) == brute(table, 7, 3, 0)[0]


def test_bounds_hold(rows, monkeypatch):
    monkeypatch.setattr(V, "CELLS", 16)
    v = np.array([[int(np.floor(1024 * x)) for x in r[1]] for r in rows[:200]])
    edges = np.concatenate([v.min(axis=0)[:, None], np.sort(v[:15], axis=0).T, v.max(axis=0)[:, None] + 1], axis=1)
    lookup = V.tables(v[:5], edges)
    exact = V.squared(v, v[:5]) - V.squared(v, np.sort(v[:5], axis=0)[2][None])
    sums = lookup[V.cells(v, edges) + 16 * np.arange(64)].sum(axis=1)
    assert (sums[:, :5] <= exact).all() and (exact <= sums[:, 5:]).all() and (sums[:, 5:] - sums[:, :5]).min() > 0
