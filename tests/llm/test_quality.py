import re

from quire.llm import quality as Q

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    w = WORDS.findall(t)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = {}
    for g in windows:
        seen[g] = seen.get(g, 0) + 1
    repeated = {j for i, g in enumerate(windows) if seen[g] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if WORDS.search(x)]
    return (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated))


TEXTS = [
    None, "", " \t\n", "one", "a b c", "a b c a b c", "a a a a a a", "x y z\nx y z\n\nx y z ", "é日本 😀 ## | <b>\x0b\x0c\r", "a b a b a b c", "long " * 40_000,
    "the end of the line\n" * 30, " ".join(f"word{i}" for i in range(200)), "  \x1c x", "same text", "same text", "w1 w2 w3 w4 w1 w2 w3 q " * 9,
]


def test_measures_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, n_words string")
    out = Q.ledger(docs).collect()
    assert len(out) == len(TEXTS)
    for r in out:
        m = r.measured
        expected = brute(TEXTS[r.doc_id])
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == expected, TEXTS[r.doc_id]
        n, _, _, _, repeated = expected
        assert bool(r.fail_bits & Q.BASE) == (n < 50 or 100 * repeated > 50 * n)
        assert r.n_words == "clash"
    assert Q.ledger(docs.limit(0)).count() == 0


def test_policies_and_ablation(spark):
    entries = spark.createDataFrame([(0,), (1,), (1,), (3,), (4,), (64,)], "fail_bits long")
    assert entries.where(Q.verdict("base")).count() == 3 and entries.where(Q.verdict("v1")).count() == 1
    got = {r.rule: (r.n_failed, r.n_failed_alone, r.n_kept_without) for r in Q.ablation(entries, "v1").collect()}
    assert got["too_few_words"] == (3, 2, 3) and got["repeated_windows"] == (1, 0, 1) and got["symbol_heavy"] == (1, 1, 2) and got["short_words"] == (0, 0, 1)


def test_stage_keeps_columns(spark):
    good = " ".join(f"word{i}" for i in range(80))
    docs = spark.createDataFrame([(1, good, "x", 5, "c", "l"), (2, "too short", "y", 0, "c", "l"), (3, None, "z", 0, "c", "l")], "doc_id long, text string, measured string, FAIL_BITS long, _c string, _l string")
    kept = Q.stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.collect() == docs.where("doc_id = 1").collect()
    entry = Q.ledger(docs).where("doc_id = 1").first()
    assert (entry.measured, entry["FAIL_BITS"], entry.measured_.n_words, entry.fail_bits_) == ("x", 5, 80, 0)
