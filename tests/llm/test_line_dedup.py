import hashlib
import random

import duckdb
import pytest

from quire.llm import line_dedup as L

SCHEMA = "doc_id long, text string, n_lines string, Kept_Text string"
SPACES = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))


def brute(rows):
    holders = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(doc)
    common = {k: max(d for d in v if d is not None) for k, v in holders.items() if len(v - {None}) >= 3}
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in common or doc == common[key(x)]]
        out.append((-1 if doc is None else doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    shared = [f"Boilerplate line number {k} of this collection" for k in range(12)] + ["É" * 19 + "Zz", "Ä" * 20, "x" * 19, "y" * 20, "İ" * 25, "K" * 24, "K" * 24]
    docs = []
    for d in range(200):
        lines = [f"line {rng.random()} stands in one document alone" for _ in range(rng.randrange(4))]
        for s in rng.sample(shared, rng.randrange(6)):
            lines.insert(rng.randrange(len(lines) + 1), rng.choice(["", " ", "\t\r"]) + rng.choice([s, s.lower(), s.upper(), s]) + rng.choice(["", "\x0b ", "\xa0"]))
        if d % 3 == 0:
            lines += ["one line in a third of all documents, ten times"] * 10
        docs.append((d, "\n".join(lines) + rng.choice(["", "\n"]), "clash", "clash"))
    docs += [(500, None, "", ""), (501, "", "", ""), (502, "\n\n", "", ""), (None, shared[0] + "\n" + "nobody else has this line, it stays", "", ""), (None, "nobody else has this line, it stays", "", "")]
    docs += [(199, docs[199][1], "", ""), (199, shared[0] + "\n\n" + shared[1], "", ""), (600, "twice in two documents is not enough\n" * 5, "", ""), (601, "Twice in two documents is not enough", "", ""), (601, "twice in two documents is not enough", "", "")]
    return [*docs, (700, "\n".join(f"long text, line {k} of a great many" for k in range(20000)), "", "")] + [(701 + k, "\n".join(f"long text, line {k} of a great many" for k in range(0, 20000, 2)), "", "") for k in range(2)]


def test_matches_brute_force(spark, rows):
    out = L.without_common_lines(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert out.columns == ["doc_id", "text", "n_lines", "Kept_Text", "n_lines_", "n_dropped", "kept_text_"]
    assert sorted((-1 if r[0] is None else r[0], r[4], r[5], r[6]) for r in out.collect()) == brute(rows)


def test_query_and_sql(spark, rows, tmp_path):
    own = [r for r in rows if r[0] is not None]
    own = list({r[0]: r for r in own}.values())  # the SQL takes an id for a row
    spark.createDataFrame(own, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    mine = sorted(tuple(r) for r in L.op11_line_dedup(spark, str(tmp_path)).collect())
    base = duckdb.connect()
    base.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert mine == sorted(base.sql(L.OP11_SQL).fetchall())
    assert mine == [(d, n, gone, hashlib.sha256(t.encode()).hexdigest()) for d, n, gone, t in brute(own)]


def test_no_documents_and_parameters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert L.without_common_lines(empty).count() == 0
    few = spark.createDataFrame([(k, "short\nown " + str(k)) for k in range(2)], "id long, body string")
    out = L.without_common_lines(few, "id", "body", length=3, documents=2)
    assert sorted(r.kept_text for r in out.collect()) == ["own 0", "short\nown 1"]
