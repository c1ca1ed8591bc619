import itertools

import numpy as np

from quire.llm import langid as L


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(3)
    scores, moves = rng.normal(size=(5, 2, 3)), rng.normal(size=(3, 3))
    lengths = np.array([3, 5])
    post = L.posteriors(scores, lengths, moves)
    for b in range(2):
        total = np.zeros((5, 3))
        for path in itertools.product(range(3), repeat=int(lengths[b])):
            weight = np.exp(sum(scores[t, b, k] for t, k in enumerate(path)) + sum(moves[i, j] for i, j in zip(path, path[1:])))
            for t, k in enumerate(path):
                total[t, k] += weight
        n = lengths[b]
        assert np.allclose(post[:n, b], total[:n] / total[:n].sum(axis=1, keepdims=True))
        assert not post[n:, b].any()
    full = np.array([5, 5])
    pairs = np.zeros((3, 3))
    for b in range(2):
        joint, z = np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=5):
            weight = np.exp(sum(scores[t, b, k] for t, k in enumerate(path)) + sum(moves[i, j] for i, j in zip(path, path[1:])))
            z += weight
            for i, j in zip(path, path[1:]):
                joint[i, j] += weight
        pairs += joint / z
    assert np.allclose(L._pairs(scores, L.posteriors(scores, full, moves), moves), pairs)


EN = "the cat sat with those things that they thought were right for this night and the light".split()
DE = "der hund und die katze sind nicht auf das schiff gegangen weil ich zwischen euch schlafe".split()


def test_learns_and_labels_switches(spark):
    rng = np.random.default_rng(1)
    say = lambda pool, n: " ".join(rng.choice(pool, n))
    rows = [(k, say(EN if k % 2 else DE, 40), "en" if k % 2 else "de", "x") for k in range(120)]
    mixed = say(EN, 30) + " " + say(DE, 30)
    rows += [(500, None, "en", ""), (501, "", None, ""), (502, "12 34 !", "de", ""), (503, say(DE, 60_000), None, ""), (504, mixed, None, ""), (503, "the light", None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = L.identify(docs, L.fit(docs), by_word=True).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    assert all(got[k].lang_pred == ("en" if k % 2 else "de") and 0 <= got[k].score <= 1 for k in range(120))
    assert [got[k].lang_pred for k in (500, 501, 502)] == ["und"] * 3
    assert {r.lang_pred for r in out if r.doc_id == 503} == {"de", "en"}
    labels = got[504].word_langs
    assert np.mean([a == b for a, b in zip(labels, ["en"] * 30 + ["de"] * 30)]) > 0.95


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    field = L.fit(empty)
    assert L.identify(empty, field).count() == 0
    one = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert L.identify(one, field).first().lang_pred == "und"


def test_a_noisy_column_of_languages(spark):
    """Of many languages the commonest are learned; ties go by name."""
    rows = [(k, " ".join(EN if k % 2 else DE), "en" if k % 2 else "de") for k in range(40)] + [(100 + k, "noise words", f"x{k}") for k in range(30)]
    field = L.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), languages=3, sequences=200)
    assert field.languages == ["de", "en", "x0"]
