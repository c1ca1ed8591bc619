"""Scores of toxicity and language identification, worked out again from what they are said to be."""

import itertools
import math
import random

import numpy as np

from quire.llm import langid, toxicity

CLEAN = "the cat sat with those things that they thought were right for this night and the light over mountains".split()
FOUL = ["scumbag", "idiot", "vermin"]


def documents():
    rng = random.Random(6)
    rows = []
    for k in range(90):
        w = rng.choices(CLEAN, k=rng.randrange(8, 20))
        if k % 4 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(FOUL))
        rows.append((k, " ".join(w)))
    return rows, [(k, int(k % 4 == 0)) for k in range(0, 90, 2)]


def test_toxicity_scores_by_hand(spark):
    rows, labels = documents()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    texts, told = dict(rows), dict(labels)
    a, b = sum(told.values()), len(told) - sum(told.values())
    share = a / (a + b)
    kinds = lambda word: {"=" + word} | {word[:k] for k in range(3, 8) if len(word) >= k}
    holds = {d: {f for w in texts[d].split() for f in kinds(w)} for d in told}
    count = {f: (sum(told[d] for d in told if f in holds[d]), sum(1 - told[d] for d in told if f in holds[d])) for f in set().union(*holds.values())}

    def weight(p, q):
        n = p + q
        return math.log((p + 1) / (n * share + 1)) - math.log((q + 1) / (n * (1 - share) + 1))

    known = {f: n for f, n in count.items() if n[0] >= 2 and n[0] > n[1] and weight(*n) > 0.5}

    def top(text, own=None):
        each = [max([0.0, *(weight(known[f][0] - (own == 1), known[f][1] - (own == 0)) for f in kinds(w) if f in known)]) for w in set(text.split())]
        return sum(sorted(each, reverse=True)[:2])

    x, y = np.array([top(texts[d], told[d]) for d in told]), np.array(list(told.values()), dtype=float)
    # the curve is the least of the penalised loss: it rises on every side
    loss = lambda s, i: np.sum(np.log1p(np.exp(s * x + i)) - y * (s * x + i)) + 0.5 * s * s + 0.5e-3 * i * i
    s, i = model.beta
    assert s > 0 and all(loss(s, i) <= loss(s + d, i + e) + 1e-9 for d in (-0.02, 0, 0.02) for e in (-0.02, 0, 0.02))
    extra = [(500, None), (501, ""), (502, "idiot scumbag vermin"), (503, "mountains")]
    got = {r.doc_id: r.score for r in toxicity.score(spark.createDataFrame(rows + extra, "doc_id long, text string"), model).collect()}
    for d, text in rows + extra:
        assert abs(got[d] - 1 / (1 + math.exp(-(s * top(text or "") + i)))) < 1e-9, (d, text)
    assert all((got[d] >= 0.3) == (d % 4 == 0) for d, _ in rows) and got[502] > 0.9 > 0.3 > got[503] == got[500] == got[501]


def test_language_scores_by_enumeration(spark):
    rng = random.Random(2)
    pools = {"en": CLEAN, "de": "der hund und die katze sind nicht auf das schiff gegangen weil ich schlafe".split(), "fr": "le chat et la souris dans une maison avec des amis pour toujours".split()}
    rows = [(k, " ".join(rng.choices(pools[lang], k=30)), lang) for k, lang in enumerate(list(pools) * 20)]
    field = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = [(k, " ".join(rng.choice(pools[rng.choice(list(pools))]) for _ in range(n))) for k, n in enumerate([1, 2, 3, 5, 6, 6])]
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(asked, "doc_id long, text string"), field, by_word=True).collect()}
    n = len(field.languages)
    for d, text in asked:
        words = text.split()
        each = []
        for w in words:
            found = langid.features(w, field.lexicon)
            each.append(sum(field.weights[f].astype(float) for f in found) / math.sqrt(len(found)))
        total = np.zeros((len(words), n))
        for path in itertools.product(range(n), repeat=len(words)):
            p = math.exp(sum(each[t][k] for t, k in enumerate(path)) + sum(field.moves[a, b] for a, b in zip(path, path[1:])))
            for t, k in enumerate(path):
                total[t, k] += p
        share = (total / total.sum(axis=1, keepdims=True))
        mean = share.mean(axis=0)
        assert got[d].lang_pred == field.languages[int(mean.argmax())] and abs(got[d].score - mean.max()) < 1e-5
        assert got[d].word_langs == [field.languages[k] for k in share.argmax(axis=1)]
