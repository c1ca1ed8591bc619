import itertools

import numpy as np

from quire.llm import toxicity as T


def model():
    rng = np.random.default_rng(0)
    counts = np.zeros((T.SIZE,) * 3)
    for w in ["idiot", "loser", "the", "this", "that", "moron", "is", "a", "trash"] * 20 + ["of"] * 30:
        s = np.concatenate(([0, 0], T.symbols(w), [0]))
        np.add.at(counts, (s[:-2], s[1:-1], s[2:]), 1)
    return T.character_model(counts + rng.random(counts.shape) * 1e-3)


def test_decoder_matches_enumeration():
    decoder = T.Decoder(model())
    for span in ["1d10t", "l0s3r!", "t r a s h", "mm00n", "i.d.i.o.t", "a$", "ééé1"]:
        spelled = T.SPELLED.fullmatch(span)
        separator = " " if " " in span else spelled[1] if spelled else ""
        choices = [decoder.readings(c, span[k - 1] if k else "", separator) for k, c in enumerate(span)]
        best = None
        for path in itertools.product(*choices):
            a = b = 0
            total, text = 0.0, ""
            for code, letter, weight in path:
                total += weight
                if code is None or (code == 0 and b == 0):
                    continue
                total += decoder.model[a][b][code]
                text += letter
                a, b = (0, 0) if code == 0 else (b, code)
            total += 0 if b == 0 else decoder.model[a][b][0]
            if best is None or total > best[0]:
                best = (total, text.strip())
        assert decoder.decode(span) == best[1], span


def test_restores_disguises():
    r = T.Restorer(model())
    assert r.text("this is 1d10t and t r a s h") == "this is idiot and trash"
    assert r.text("looooser m.o.r.o.n") == "loser moron"
    assert r.text("") == ""


def rows():
    rng = np.random.default_rng(3)
    clean = "the this that of a is and reading chapter lesson water light number answer question".split()
    out, labels = [], []
    for k in range(240):
        words = list(rng.choice(clean, 30))
        if k % 4 == 0:
            for w in rng.choice(["idiot", "moron", "loser"], 3):
                words[rng.integers(30)] = w
        out.append((k, " ".join(words), "clash"))
        labels.append((k, int(k % 4 == 0), 1))
    return out, labels


def test_learns_and_scores(spark):
    docs, labels = rows()
    docs += [(900, None, ""), (901, "", ""), (902, "you 1d10t and l0s3r, m o r o n", ""), (903, "the light of a lesson " * 8000, ""), (903, "moron idiot", "")]
    labels += [(0, 0, 1), (None, 1, 1), (5, None, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string, score string")
    m = T.fit(d, spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    got = T.score(d, m, restored=True).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert all((by[k].score >= T.THRESHOLD) == (k % 4 == 0) for k in range(240))
    assert by[902].score >= T.THRESHOLD and "idiot" in by[902].restored_text
    assert by[900].score == by[901].score < T.THRESHOLD
    assert sorted(r.score >= T.THRESHOLD for r in got if r.doc_id == 903) == [False, True]


def test_without_labels(spark):
    d = spark.createDataFrame([(1, "some text"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in T.score(d, T.fit(d, none)).collect()} == {0.5}
    assert T.score(d.limit(0), T.fit(d.limit(0), none)).count() == 0
