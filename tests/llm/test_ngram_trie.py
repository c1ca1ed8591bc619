import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ngram_trie as T
from quire.llm.elias_fano import Sequence, encode


@pytest.mark.parametrize("top", [1, 50, 10_000, 1 << 40, (1 << 64) - 1])
def test_elias_fano(top):
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, top, 700, dtype=np.uint64, endpoint=True))
    s = Sequence(encode(values))
    assert (s.get(np.arange(len(values))) == values).all()
    assert (s.find(values) == np.arange(len(values))).all()
    others = np.setdiff1d(rng.integers(0, top, 500, dtype=np.uint64, endpoint=True), values)
    assert (s.find(others) == -1).all()
    assert (Sequence(encode(np.zeros(0, dtype=np.uint64))).find(others) == -1).all()
    again = np.sort(rng.integers(0, min(top, 90), 300).astype(np.uint64))
    assert (Sequence(encode(again)).get(np.arange(300)) == again).all()


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")), "\n"]


class Plain:
    """The same model by dictionaries, without quantising."""

    def __init__(self, texts, least=1):
        self.uni, self.bi, self.tri = Counter(), Counter(), Counter()
        for t in texts:
            w = words(t)
            self.uni.update(w)
            self.bi.update(zip(w, w[1:]))
            self.tri.update(zip(w, w[1:], w[2:]))
        self.bi = {k: n for k, n in self.bi.items() if n >= least}
        self.tri = {k: n for k, n in self.tri.items() if n >= least}
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        self.back = Counter()
        for k, n in self.bi.items():
            self.back[k[:1]] += (n - 0.75) / self.uni[k[0]]
        for k, n in self.tri.items():
            self.back[k[:2]] += (n - 0.75) / self.bi[k[:2]]

    def p(self, w, context):
        if not context:
            return (self.uni.get(w, 0) + 1) / (self.n + self.v + 1)
        table, whole = (self.tri, self.bi.get(context, 0)) if len(context) == 2 else (self.bi, self.uni.get(context[0], 0))
        share = max(0, table.get((*context, w), 0) - 0.75) / whole if whole else 0
        return share + (1 - self.back[context] if whole else 1) * self.p(w, context[1:])


@pytest.mark.parametrize("least", [1, 2])
def test_scores_match_a_plain_model(spark, monkeypatch, least):
    monkeypatch.setattr(T, "SHARD_TOKENS", 400)
    rng = np.random.default_rng(2)
    pool = np.array(["The", "cat", "sat", "on", "MAT", "é", "x.", "\x0bdog", "it", *(f"w{k}" for k in range(60))])
    shares = np.concatenate([np.full(9, 0.08), np.full(60, 0.28 / 60)])
    texts = [" ".join(rng.choice(pool, rng.integers(1, 30), p=shares)) for _ in range(300)] + [None, "", " \n", "the " * 3000, "cat sat", "cat sat"]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, score string").repartition(3)
    trie = T.train(docs.where("doc_id % 7 <> 3"), min_count=least)
    assert trie.bits > 2 and len(trie.hot) > 3 and trie.hot_bits.max() > 1
    plain = Plain([t for i, t in enumerate(texts) if i % 7 != 3], least)
    new = spark.createDataFrame([(1000, "never seen words cat sat on", ""), (None, "cat", "")], docs.schema)
    got = {r.doc_id: r for r in T.score(docs.union(new), trie).collect()}
    both = {r.doc_id: r for r in T.train_and_score(docs, F.expr("doc_id % 7 <> 3"), min_count=least).collect()}
    assert len(both) == len(texts) and all(both[i] == got[i] for i in both)
    for i, t in [*enumerate(texts), (1000, "never seen words cat sat on"), (None, "cat")]:
        w, r = words(t), got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(x in plain.uni for x in w), plain.n)
        assert math.isclose(r.base_score, sum(math.log10(plain.p(x, ())) for x in w), rel_tol=1e-9)
        best = sum(math.log10(plain.p(x, tuple(w[max(0, k - 2) : k]))) for k, x in enumerate(w))
        assert best - 0.16 * len(w) - 1e-6 <= r.score <= best + 1e-6, (i, best, r.score)


def test_probabilities_add_up():
    plain = Plain(["a b c a b d", "a b c", "b c a", "c a b c"] * 3)
    for context in [("a",), ("a", "b"), ("zz",), ("b", "c")]:
        assert math.isclose(sum(plain.p(w, context) for w in plain.uni) + plain.p("never", context), 1.0)


def test_arrays_survive_packing():
    rng = np.random.default_rng(3)
    arrays = [rng.integers(0, 1 << 60, 50).astype(np.uint64), np.zeros(0, dtype=np.uint32), rng.integers(0, 9, 7).astype(np.uint8)]
    assert all((a == b).all() and a.dtype == b.dtype for a, b in zip(arrays, T.grow(T.shrink(*arrays))))


def test_untrained(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in T.score(docs, T.train(docs.limit(0))).collect()}
    assert T.score(docs.limit(0), T.train(docs)).count() == 0
    assert got[1].n_tokens == 3 and got[1].n_known == 0 and got[1].train_tokens == 0 and got[2].score == 0.0


def test_query_keeps_what_was_seen_once(spark, tmp_path):
    rng = np.random.default_rng(6)
    pool = [f"w{k}" for k in range(40)]
    rows = [(i, " ".join(rng.choice(pool, 12))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in T.op9_ngram_trie(spark, str(tmp_path)).collect()}
    plain = Plain([t for i, t in rows if not got[i].held_out])
    for i, t in rows:
        w = words(t)
        best = sum(math.log10(plain.p(x, tuple(w[max(0, k - 2) : k]))) for k, x in enumerate(w))
        assert best - 0.16 * len(w) - 1e-6 <= got[i].score <= best + 1e-6, (i, best, got[i].score)
