import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import corpus_pipeline


def test_stages_against_brute_force(spark, tmp_path):
    rng = np.random.default_rng(8)
    pool = [a + b + c for a in "abcdefgh" for b in "rstuvw" for c in ("en", "ing", "ard", "oll", "ess", "umn")]
    docs, labels = [], []
    for k in range(160):
        words = list(rng.choice(pool, 70))
        if k % 8 == 0:
            words[10], words[40] = "idiot", "moron"
        docs.append((k, " ".join(words), "en", "src0", 1))
        labels.append((k, 1, int(k % 8 == 0)))
    docs += [(200 + k, docs[k][1].upper(), "en", "src0", 1) for k in range(1, 8)] + [(300, "short", "en", "s", 1), (301, None, "en", "s", 1), (302, "same words again " * 40, "en", "s", 1), (2, docs[2][1], "en", "src0", 1)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = rows
    for _, stage in corpus_pipeline.STAGES[:3]:
        before = kept.columns
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == before
    expected = {k for k in range(160) if k % 8}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(expected)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == expected
    assert all(sum(r.length for r in out if r.doc_id == d) == next(r.doc_tokens for r in out if r.doc_id == d) for d in expected)


def test_empty_and_clashing(spark, tmp_path):
    """No documents, or none that is kept, give no rows; extra columns of the stages' own names go through."""
    columns = "doc_id long, text string, lang string, source string, n_chars long, measured string, fail_bits int, mark string, key long, score string, ids array<int>"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], columns).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rng = np.random.default_rng(3)
    texts = [" ".join("".join(rng.choice(list("bdeginorst"), 6)) for _ in range(80)) for _ in range(15)]
    rows = [(1, texts[0], "en", "s", 1, "x", 1, "m", 2, "s", [1]), (2, texts[0].upper(), "en", "s", 1, "y", 1, "m", 2, "s", [1]), (3, texts[1], None, None, None, None, None, None, None, None, None), (3, texts[2], "", "", 0, "", 0, "", 0, "", []), (4, None, "", "", 0, "", 0, "", 0, "", [])]
    rows += [(100 + k, texts[3 + k], "", "", 0, "", 0, "", 0, "", []) for k in range(12)]
    (tmp_path / "more").mkdir()
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/more/documents.parquet")
    spark.createDataFrame([(100 + k, 1, 0) for k in range(12)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/more/labels.parquet")
    out = corpus_pipeline.run(spark, f"{tmp_path}/more").collect()
    assert sorted((r.doc_id, r.start) for r in out if r.start == 0) == [(1, 0), (3, 0), (3, 0), *((100 + k, 0) for k in range(12))]
