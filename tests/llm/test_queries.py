"""Every registered query over a small folder: columns, types, held-out rows, and values against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest

P = pytest.importorskip("public_tokenizers")

from quire.llm import registry

WORDS = {"en": "the cat sat with those things that they thought were right for this night and the light", "de": "der hund und die katze sind nicht auf das schiff gegangen weil ich zwischen euch schlafe"}
FOUL = ["scumbag", "worthless idiot", "filthy vermin"]

COLUMNS = {
    "op1_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op2_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op3_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op4_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op5_packing": {"doc_id": "bigint", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
    "op6_kd_sharding": {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"},
    "op7_quality_rules": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op8_nn_descent": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op9_ngram_trie": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op10_langid": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op11_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op12_va_file": {"vec_id": "bigint", "cluster": "int", "distance": "bigint", "cluster_inertia": "bigint", "inertia": "bigint", "centroid_sha256": "string"},
    "op13_prefix_trie": {
        "conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string",
    },
}


def remainder(doc_id, modulus):
    return zlib.crc32(str(doc_id).encode()) % modulus == 2


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    rows = []
    for i in range(240):
        lang = "en" if i % 2 else "de"
        w = [rng.choice(WORDS[lang].split()) for _ in range(rng.randrange(20, 90))]
        if i % 5 == 0:
            w.insert(rng.randrange(len(w)), rng.choice(FOUL))
        rows.append((i, " ".join(w), lang, f"src{i % 3}", "clash"))
    rows += [(300, None, None, None, None), (301, "", "en", "s", ""), (302, "² ½ Ⅷ 12 !", "en", "s", ""), (303, rows[7][1], "en", "s", ""), (304, rows[7][1].upper(), "en", "s", "")]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(0, 240, 2)] + [(9000 + i, 0, 1) for i in range(50)] + [(5, 1, None)]
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, made):
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(made[0], "doc_id long, text string, lang string, source string, score string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(made[1], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    rng = np.random.default_rng(2)
    vectors = [(k, rng.normal(size=8).tolist(), k % 3) for k in range(60)]
    vectors += [(100 + k, (np.array(vectors[k][1]) + 0.05).tolist(), k % 3) for k in range(20)] + [(200, None, 1), (201, [0.0] * 8, 1), (202, [float("nan")] * 8, 1), (203, vectors[0][1], None)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    turns = [(c, k, "user" if k % 2 == 0 else "assistant", WORDS["en"].split()[(c + k) % 7]) for c in range(30) for k in range(c % 5)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{path}/conversations.parquet")
    return path


@pytest.fixture(scope="module")
def answers(spark, folder):
    return {name: (frame := query(spark, folder), frame.collect()) for name, query in registry.QUERIES.items()}


@pytest.mark.parametrize("name", COLUMNS)
def test_columns(answers, made, name):
    kinds = dict(answers[name][0].dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    if name not in ("op5_packing", "op8_nn_descent", "op12_va_file", "op13_prefix_trie"):
        assert sorted(r.doc_id for r in answers[name][1]) == sorted(r[0] for r in made[0])


@pytest.mark.parametrize(("name", "modulus"), [("op1_toxicity", 4), ("op9_ngram_trie", 7), ("op10_langid", 4)])
def test_held_out(answers, name, modulus):
    assert all(r.held_out == remainder(r.doc_id, modulus) for r in answers[name][1])


def test_toxicity(answers, made):
    for r in answers["op1_toxicity"][1]:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        if r.doc_id < 240:
            assert r.predicted == int(r.doc_id % 5 == 0), r


def test_labels_of_other_documents_count_for_nothing(spark, made):
    from quire.llm import toxicity

    docs = spark.createDataFrame([r[:2] for r in made[0][:60]], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)], "doc_id long, toxic int")
    extra = labels.union(spark.createDataFrame([(7000 + i, 1) for i in range(40)], "doc_id long, toxic int"))
    a, b = toxicity.fit(docs, labels), toxicity.fit(docs, extra)
    assert np.array_equal(a.beta, b.beta) and a.table == b.table
    none = labels.where("doc_id = 1")  # one class alone: the smoothed share
    assert toxicity.fit(docs, none).beta[1] == toxicity.fit(docs, none.union(extra.where("doc_id >= 7000"))).beta[1]


def fingerprint(text):
    import re

    import xxhash

    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def smallest(links, nodes):
    name = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in links:
            low = min(name[a], name[b])
            moved |= name[a] != low or name[b] != low
            name[a] = name[b] = low
    return name


def test_simhash(answers, made):
    prints = {r[0]: fingerprint(r[1]) for r in made[0]}
    links = [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2]
    name = smallest(links, prints)
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in answers["op2_simhash"][1]} == {(d, f"{p:016x}", name[d]) for d, p in prints.items()}


def test_bpe_and_counts(answers, made):
    import base64

    import tiktoken
    from tokenizers import Tokenizer

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_multi_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = {r[0]: r[1] or "" for r in made[0]}
    for r in answers["op3_bpe"][1]:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
    own = {d: [*library.encode(t, add_special_tokens=False).ids, 0] for d, t in texts.items()}
    for r in answers["op4_token_counts"][1]:
        n = len(own[r.doc_id]) - 1
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)
    covered = {d: 0 for d in own}
    for r in answers["op5_packing"][1]:
        part = own[r.doc_id][r.start : r.start + r.length]
        covered[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(own[r.doc_id])
    assert covered == {d: len(x) for d, x in own.items()}


def test_embeddings(answers, folder, spark):
    rows = [r for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    good = {r.vec_id: (r.label, np.array(r.embedding, dtype=float)) for r in rows if r.label is not None and r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)}
    cosine = lambda x, y: x @ y / np.sqrt((x @ x) * (y @ y))
    links = [(a, b) for a in good for b in good if a != b and good[a][0] == good[b][0] and cosine(good[a][1], good[b][1]) >= 0.93]
    name = smallest(links, [r.vec_id for r in rows])
    expected = {(r.vec_id, sum(a == r.vec_id for a, _ in links), name[r.vec_id], name[r.vec_id] == r.vec_id) for r in rows}
    assert len(links) > 20 and {tuple(r) for r in answers["op8_nn_descent"][1]} == expected


def test_languages(answers):
    for r in answers["op10_langid"][1]:
        if r.doc_id < 240:
            assert r.lang_pred == ("en" if r.doc_id % 2 else "de")
        if r.doc_id in (300, 301, 302):
            assert (r.lang_pred, r.score) == ("und", 0.0)


def test_shards(answers, made):
    rows = answers["op6_kd_sharding"][1]
    texts = {r[0]: (r[1] or "").encode() for r in made[0]}
    assert all((r["size"], r.text_crc32, r.law, r.grown_shard) == (len(texts[r.doc_id]) + 8, zlib.crc32(texts[r.doc_id]), "bytes", None) for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(slots) <= set(range(24)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    where = {r.doc_id: r.shard for r in rows}
    assert where[7] == where[303]


def test_every_query_is_looked_at():
    assert set(COLUMNS) == set(registry.QUERIES)


def test_lines_vectors_and_conversations(answers, made):
    """What has whole tests of its own: here that the queries' rows fit together."""
    texts = {r[0]: r[1] or "" for r in made[0]} | {7: "", 303: ""}  # 304 holds their only line too
    assert all((r.n_lines, r.n_dropped, r.kept_sha256) == (1, int(r.doc_id in (7, 303)), hashlib.sha256(texts[r.doc_id].encode()).hexdigest()) for r in answers["op11_line_dedup"][1])
    assert answers["op12_va_file"][1] == []  # no vector has 64 components
    nodes = answers["op13_prefix_trie"][1]
    [root] = [r for r in nodes if r.depth == 0]
    assert root.parent_conv_id is None and root.n_convs == 24 and root.n_leaves == sum(r.n_children == 0 for r in nodes) and sum(r.n_children for r in nodes) == len(nodes) - 1
