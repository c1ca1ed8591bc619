import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
import public_tokenizers as P
import tiktoken
from tokenizers import Tokenizer

from quire.llm import bpe, packing, token_counts
from quire.llm.pretokens import pieces

TEXTS = [
    None, "", " ", "\n\n", "a", "Hello  world", "it's we're they'll 's 'r 'l", "a \n b\n\n c   d\t\te", "one\r\ntwo", "x" * 3000, " " * 700 + "end",
    "naïve café über straße ñandú", "日本語のテキスト と　空白", "emoji 😀😀 flags 🇫🇷 zwj 👩‍👩‍👧", "1234567890 ½ ² 12a3", "foo_bar--baz!!! $$$ ??", "\x1c\x1d odd \x85 \xa0 spaces   wide",
    "<|endoftext|>", "a <|endoftext|> b  <|endoftext|>!", "almost <|endof", "word " * 5000, "same", "same",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def rows(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, counts string").repartition(3)


def test_bpe_round_trip(spark):
    import base64

    path = P.path(bpe.FILE)
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r for r in bpe.encode(rows(spark), path, digests=True).collect()}
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        ids = enc.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids), (i, t)
        assert got[i].ids_sha256 == hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), (i, t)
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode(rows(spark).limit(0), path).count() == 0


@pytest.mark.parametrize("huge", [bpe.HUGE, bpe.LONG])
def test_bpe_of_long_pieces(monkeypatch, huge):
    import base64

    monkeypatch.setattr(bpe, "HUGE", huge)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(bpe.FILE), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec, rng = bpe.Codec(P.path(bpe.FILE)), random.Random(8)
    known = [t.decode() for t in ranks if t.isalpha()]
    pools = [list("abcdefghijklmnopqrstuvwxyz"), ["a", "aa", "ab", "b"], known, ["é", "ü", "日"], ["="]]
    texts = ["".join(rng.choice(pool) for _ in range(n)) for pool in pools for n in (130, 300, 2000)]
    if huge == bpe.LONG:
        texts = texts[1::3] + ["".join(rng.choice("ACGT") for _ in range(9000))]
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, dtype="<u4").tolist() == enc.encode_ordinary(t), t[:50]


def test_prefix_counts_are_exact(library):
    counter = token_counts.Counter(P.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    alphabet = ["a", "th", "e", " ", "  ", "\n", "'", "s", "re", "'ll", "!", "1", "é", "日", "\t", "ing", "<|endoftext|>", "<|", "😀", "\xa0"]
    texts = [t for t in TEXTS if t and len(t) < 100] + ["".join(rng.choice(alphabet) for _ in range(25)) for _ in range(150)]
    for t in texts:
        counts = counter.counts(t)
        assert counts.tolist() == [len(library.encode(t[: k + 1], add_special_tokens=False).ids) for k in range(len(t))], repr(t)


def test_compatible_tokens(library):
    """Against merging from single bytes."""
    counter = token_counts.Counter(P.path("byte_bpe_50k.json"))

    def merged(raw):
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while len(parts) > 1:
            best, k = min((counter.joined.get(counter.tokens[a] << 32 | counter.tokens[b], 1 << 60), k) for k, (a, b) in enumerate(zip(parts, parts[1:])))
            if best == 1 << 60:
                break
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    rng = random.Random(6)
    some = [rng.randrange(len(counter.raw)) for _ in range(3000)] + list(range(200)) * 10
    for a, b in zip(some, reversed(some)):
        assert counter.follows(a, b) == (merged(counter.raw[a] + counter.raw[b]) == [counter.raw[a], counter.raw[b]]), (counter.raw[a], counter.raw[b])
    for _ in range(400):
        whole = merged(" ".join(rng.choice(["reading", "wave", "Zq", "echo", "tion"]) for _ in range(3)).encode())
        assert all(counter.follows(counter.tokens[x], counter.tokens[y]) for x, y in zip(whole, whole[1:]))


def test_token_counts(spark, library):
    got = {r.doc_id: r for r in token_counts.token_counts(rows(spark), P.path("byte_bpe_50k.json")).collect()}
    for i, t in enumerate(TEXTS):
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 512)
        cut = (t or "")[: got[i].fit_chars]
        assert len(library.encode(cut, add_special_tokens=False).ids) <= 512 and (cut == (t or "") or n > 512)
    assert token_counts.token_counts(rows(spark).limit(0), P.path("byte_bpe_50k.json")).count() == 0
    arrays = token_counts.prefix_counts(rows(spark, ["ab cd", None]), P.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id, len(r.counts)) for r in arrays) == [(0, 5), (1, 0)]


def test_packing(spark, library):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["the", "of", "reading", "x1"]) for _ in range(rng.randrange(1, 900))) for _ in range(150)]
    out = packing.pack(rows(spark, texts), P.path("byte_bpe_50k.json"), with_ids=True).collect()
    docs, sequences = {}, {}
    for r in out:
        docs.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids)) and len(r.ids) == 4 * r.length
    for i, t in enumerate(texts):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], dtype="<u4").tobytes()
        mine = sorted(docs[i], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in mine) == ids
        assert [r.start for r in mine] == np.cumsum([0, *(r.length for r in mine)])[:-1].tolist() and {r.doc_tokens for r in mine} == {len(ids) // 4}
    short = 0
    for rs in sequences.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == np.cumsum([0, *(r.length for r in rs)])[:-1].tolist()
        short += sum(r.length for r in rs) < 1024
        assert sum(r.length for r in rs) <= 1024
    assert short <= 3
    assert packing.pack(rows(spark).limit(0), P.path("byte_bpe_50k.json")).count() == 0


def test_sum_of_squares_choice():
    rng = random.Random(4)
    packer = packing.Packer(16)
    for _ in range(500):
        size = rng.randrange(1, 16)
        costs = {}
        for h in range(0, 17 - size):
            if h and not packer.counts[h]:
                continue
            n = packer.counts[:16].copy()
            n[h] -= bool(h)
            if h + size < 16:
                n[h + size] += 1
            costs[h] = int((n[1:] ** 2).sum())
        best = min(costs.values())
        assert packer.level(size) == max(h for h, c in costs.items() if c == best)
        packer.put((0, 0, b"\0\0\0\0" * size, size), size)


def test_texts_are_encoded_by_distinct_words(monkeypatch):
    import pyarrow as pa

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh,.é") for _ in range(rng.randrange(1, 9))) for _ in range(300)]
    texts = pa.array([" ".join(rng.choice(words) for _ in range(200)) for _ in range(100)])
    seen = []
    monkeypatch.setattr(packing, "pieces", lambda text: seen.append(len(text)) or pieces(text))
    encoder = packing.Encoder(P.path("byte_bpe_50k.json"))
    assert len(list(encoder.encode(texts))) == 100
    assert sum(seen) < sum(map(len, texts.to_pylist())) / 10  # no word is cut as often as it occurs


def test_tasks_share_an_encoder(spark):
    """What one task has loaded and remembered serves the next one in its process."""

    def run(batches):
        import os

        import pyarrow as pa

        found = packing.encoder(P.path("byte_bpe_50k.json"))
        for b in batches:
            list(found.encode(b.column(1)))
            yield pa.RecordBatch.from_pydict({"pid": [os.getpid()], "address": [id(found)]})

    made = {tuple(r) for r in rows(spark).repartition(12).mapInArrow(run, "pid long, address long").collect()}
    assert len(made) == len({pid for pid, _ in made})


def test_encoder_against_the_library(library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(packing, "BLOCK", 7)  # many steps
    monkeypatch.setattr(packing, "MEMORY", 50)  # and generations
    rng = random.Random(11)
    parts = [" ", " ", " ", "  ", "\n", " \n", "\t", "\r\n", "\xa0", "\u3000", "\x85", "\u2028", "\x00", "\x1c", "a", "Wort", "naïve", "'s", "'", "'ll", "12", "½", ",", "!!", "日本", "😀", "e\u0301", "<|endoftext|>", "<|", "x" * 70, "\ufeff"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 25))) for _ in range(3000)] + [None, "", " ", "a ", " a", "\n", " \n a", "a\n b", "a \n b"] + TEXTS
    expected = [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
    encoder = packing.Encoder(P.path("byte_bpe_50k.json"))
    assert list(encoder.encode(pa.array(texts))) == expected
    assert list(encoder.encode(pa.array(texts, pa.large_string()).slice(1000, 500))) == expected[1000:1500]
    for some in ([], [None], ["", None, "same", " "]):
        assert list(encoder.encode(pa.array(some, pa.string()))) == [np.array(library.encode(t or "", add_special_tokens=False).ids, dtype="<u4").tobytes() for t in some]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    cut = list(packing.slices(batch, 60))
    assert pa.Table.from_batches(cut).to_pylist() == batch.to_pylist()
    assert all(len(b) == 1 or sum(len((t or "").encode()) for t in b.column(1).to_pylist()) <= 60 for b in cut) and len(cut) < len(texts)
    assert max(map(len, encoder.memory)) <= packing.LONG and len(encoder.memory) <= 50


def test_pieces_match_the_pattern():
    import regex

    pattern = regex.compile(P.PATTERN)
    for t in TEXTS:
        if t and "\x1c" not in t:
            assert pieces(t) == pattern.findall(t)
