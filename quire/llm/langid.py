"""Language identification by a linear-chain conditional random field over words.

A word's features are its affixes, its letter n-grams and, if the training texts use it often, the word itself; learned
transitions say how readily the language changes between neighbouring words. Forward-backward gives every word's
posterior over the languages, so a text that switches between languages is labelled word by word; a document's language
is the one with the largest share.

The field is fitted on a bounded sample: STRETCHES stretches of at most LONGEST words, anywhere in the text, of at most
about SAMPLE documents of each language, chosen by a hash of their id. SEQUENCES training sequences are spliced from
these stretches, so that transitions are seen as well as words; the lexicon is the stretches' LEXICON commonest words. The
LANGUAGES commonest languages are learned, whatever else a noisy column holds. All of these are parameters of ``fit``.
"""

from __future__ import annotations

import random
import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import held_out, read

#: Languages that are learned at most, documents of each in the training sample, about, stretches of each, and words of one at most.
LANGUAGES, SAMPLE, STRETCHES, LONGEST = 200, 250, 8, 60
BUCKETS = 1 << 17
LEXICON = 3000
SEQUENCES, LENGTH, EPOCHS, RATE = 1600, 96, 4, 0.15
MEMORY = 400_000
#: Words that one forward-backward pass holds.
HELD = 400_000
UNKNOWN = "und"

WORD = re.compile(r"[^\W\d_]+")
#: Characters that Python takes for word characters but that are neither letters nor decimal digits: powers, fractions, numerals.
_NUMERIC = re.compile("[" + "".join(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]+")


def words(text: str | None) -> list[str]:
    """Runs of letters, in lower case."""
    if not text:
        return []
    found = WORD.findall(text.lower())
    if text.isascii() or "".join(found).isalpha():
        return found
    return [part for w in found for part in _NUMERIC.split(w) if part]


def features(word: str, lexicon: set[str]) -> list[int]:
    marked = f"^{word}$"
    found = [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3, 4)]
    found += [marked[k : k + n] for n in (2, 3) for k in range(len(marked) - n + 1)]
    if word in lexicon:
        found.append(f"w{word}")
    return [zlib.crc32(f.encode("utf-8", "replace")) % BUCKETS for f in found]


class Field:
    """Weights of features and transitions over the languages."""

    def __init__(self, languages: list[str], lexicon: set[str]):
        self.languages, self.lexicon = languages, lexicon
        self.weights = np.zeros((BUCKETS, len(languages)), dtype=np.float32)
        self.moves = np.zeros((len(languages), len(languages)))

    def emissions(self, some: list[str]) -> np.ndarray:
        """Scores of each word: the mean of its features' weights, so that long words don't outshout short ones."""
        each = [features(w, self.lexicon) for w in some]
        n = np.array([len(f) for f in each])
        flat = np.fromiter((x for f in each for x in f), dtype=np.int64, count=int(n.sum()))
        return np.add.reduceat(self.weights[flat], np.cumsum(n) - n, axis=0) / np.sqrt(n)[:, None]


def posteriors(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """(time, batch, language) posteriors by forward-backward; steps beyond a sequence's length are zero."""
    steps, batch, n = scores.shape
    heat = np.exp(scores - scores.max(axis=2, keepdims=True))
    step = np.exp(moves - moves.max())
    forward = np.empty((steps, batch, n))
    a = heat[0] / heat[0].sum(axis=1, keepdims=True)
    forward[0] = a
    for t in range(1, steps):
        a = (a @ step) * heat[t]
        a /= a.sum(axis=1, keepdims=True)
        forward[t] = a
    b = np.ones((batch, n))
    ends = int(lengths.min())
    for t in range(steps - 2, -1, -1):
        b = (b * heat[t + 1]) @ step.T
        b /= b.sum(axis=1, keepdims=True)
        if t + 1 >= ends:
            b[lengths <= t + 1] = 1.0
        forward[t] *= b
    forward /= forward.sum(axis=2, keepdims=True)
    forward[np.arange(steps)[:, None] >= lengths[None, :]] = 0.0
    return forward


def train(rows: list[tuple[str, str]], seed: int = 7, lexicon: int = LEXICON, sequences: int = SEQUENCES) -> Field:
    """The field from (text, language) pairs, by AdaGrad on the sequences' log-likelihood."""
    by: dict[str, list[list[str]]] = {}
    for text, lang in sorted(rows):
        if found := words(text):
            by.setdefault(lang, []).append(found)
    languages = sorted(by)
    counts = Counter(w for docs in by.values() for d in docs for w in d)
    field = Field(languages, {w for w, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:lexicon]})
    if len(languages) < 2:
        return field
    rng = random.Random(seed)
    ids: dict[str, int] = {}
    x = np.zeros((sequences, LENGTH), dtype=np.int64)
    y = np.zeros((sequences, LENGTH), dtype=np.int64)
    for s in range(sequences):
        at = 0
        while at < LENGTH:
            k = rng.randrange(len(languages))
            doc = rng.choice(by[languages[k]])
            a = rng.randrange(len(doc))
            part = doc[a : a + min(rng.randrange(8, 60), LENGTH - at)]
            x[s, at : at + len(part)] = [ids.setdefault(w, len(ids)) for w in part]
            y[s, at : at + len(part)] = k
            at += len(part)
    each = [features(w, field.lexicon) for w in ids]
    n = np.array([len(f) for f in each])
    flat = np.array([v for f in each for v in f], dtype=np.int64)
    begin = np.cumsum(n) - n
    squares = np.full(field.weights.shape, 1e-4, dtype=np.float32)
    moved = np.full(field.moves.shape, 1e-4)
    size = 64
    for _ in range(EPOCHS):
        order = rng.sample(range(sequences), sequences)
        for k in range(0, sequences, size):
            some = order[k : k + size]
            used, where = np.unique(x[some], return_inverse=True)
            where = where.reshape(len(some), LENGTH)
            lens = n[used]
            index = np.repeat(begin[used], lens) + np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
            feats, root = flat[index], np.sqrt(lens)[:, None]
            scores = np.add.reduceat(field.weights[feats], np.cumsum(lens) - lens, axis=0) / root
            e = scores[where].transpose(1, 0, 2).astype(float)
            post = posteriors(e, np.full(len(some), LENGTH), field.moves)
            truth = np.eye(len(languages))[y[some]].transpose(1, 0, 2)
            gap = truth - post
            by_word = np.zeros((len(used), len(languages)))
            np.add.at(by_word, where.T.reshape(-1), gap.reshape(-1, len(languages)))
            gradient = np.zeros_like(field.weights)
            np.add.at(gradient, feats, np.repeat(by_word / root, lens, axis=0).astype(np.float32))
            rows_ = np.unique(feats)
            squares[rows_] += gradient[rows_] ** 2
            field.weights[rows_] += RATE * gradient[rows_] / np.sqrt(squares[rows_]) - 1e-4 * field.weights[rows_]
            pair = np.einsum("tbi,tbj->ij", truth[:-1], truth[1:]) - _pairs(e, post, field.moves)
            moved += pair**2
            field.moves += RATE * pair / np.sqrt(moved)
    return field


def _pairs(scores: np.ndarray, post: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected transitions: from each word's posterior to the next word's, given the first."""
    step = np.exp(moves - moves.max())
    heat = np.exp(scores - scores.max(axis=2, keepdims=True))
    # P(j at t+1 | i at t) is proportional to step[i, j] * heat[t+1, j] * backward[t+1, j]; backward = posterior / forward
    forward = np.empty_like(post)
    a = heat[0] / heat[0].sum(axis=1, keepdims=True)
    forward[0] = a
    for t in range(1, len(scores)):
        a = (a @ step) * heat[t]
        a /= a.sum(axis=1, keepdims=True)
        forward[t] = a
    ahead = (post / np.maximum(forward, 1e-300))[1:] * heat[1:]
    joint = forward[:-1, :, :, None] * step[None, None] * ahead[:, :, None, :]
    return (joint / joint.sum(axis=(2, 3), keepdims=True)).sum(axis=(0, 1))


def stretches(doc_id: int, text: str, pieces: int = STRETCHES, longest: int = LONGEST) -> list[str]:
    """Stretches of 8 words or more, as far as the text has them, at places chosen by the document's id."""
    found, rng = words(text), random.Random(doc_id)
    if len(found) <= longest:
        return [" ".join(found)] if found else []
    return [" ".join(found[a : a + rng.randrange(8, longest + 1)]) for a in (rng.randrange(len(found) - 7) for _ in range(pieces))]


def fit(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES, pieces: int = STRETCHES, longest: int = LONGEST, lexicon: int = LEXICON, sequences: int = SEQUENCES) -> Field:
    """The field from rows (doc_id, text, lang); rows without id, text or language are left out."""
    known = docs.where("text is not null and lang is not null and doc_id is not null")
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages)
    # broadcast: a row for each language that is learned
    chosen = known.join(F.broadcast(counts), "lang").where(place < F.lit(sample) / F.col("n")).select("doc_id", "text", "lang")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(s, lang) for d, t, lang in zip(*(b.column(k).to_pylist() for k in range(3))) for s in stretches(d, t, pieces, longest)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in (0, 1)], ["text", "lang"])

    # bounded by `sample` documents of each of so many languages and the stretches of each
    found = [(r["text"], r["lang"]) for r in chosen.mapInArrow(cut, "text string, lang string").collect()]
    return train(found, lexicon=lexicon, sequences=sequences)


class Labeller:
    """Word posteriors of many texts at once; remembers words' scores up to a bound."""

    def __init__(self, field: Field):
        self.field, self.ids = field, {}
        self.scores = np.zeros((0, len(field.languages)))

    def _index(self, texts: list[list[str]]) -> list[np.ndarray]:
        if len(self.ids) > MEMORY:
            self.ids, self.scores = {}, self.scores[:0]
        new = list({w for t in texts for w in t}.difference(self.ids))
        if new:
            begin = len(self.ids)
            self.ids.update((w, begin + k) for k, w in enumerate(new))
            self.scores = np.concatenate([self.scores, *(self.field.emissions(new[k : k + 5000]) for k in range(0, len(new), 5000))])
        get = self.ids.__getitem__
        return [np.fromiter(map(get, t), dtype=np.int64, count=len(t)) for t in texts]

    def posteriors(self, texts: list[list[str]]) -> Iterator[tuple[int, np.ndarray]]:
        """(place in texts, posteriors of its words), shortest texts first; texts without words are left out."""
        index = self._index(texts)
        order = sorted((k for k in range(len(texts)) if texts[k]), key=lambda k: len(texts[k]))
        while order:
            steps = len(texts[order[-1]])
            some = order[-max(1, min(256, HELD // steps)) :]
            del order[-len(some) :]
            lengths = np.array([len(texts[k]) for k in some])
            scores = np.zeros((steps, len(some), len(self.field.languages)))
            for j, k in enumerate(some):
                scores[: lengths[j], j] = self.scores[index[k]]
            post = posteriors(scores, lengths, self.field.moves)
            for j, k in enumerate(some):
                yield k, post[: lengths[j], j]


def identify(docs: DataFrame, field: Field, doc_id: str = "doc_id", text: str = "text", by_word: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score) for each row, and word_langs if asked for.

    A null text and one without letters is ``und`` with score 0, as is every text if nothing could be learned. Texts of
    any length are labelled whole; ties go to the language first in order. Repeated rows are labelled each; an empty
    table gives no rows. Columns of docs other than the two named don't matter.
    """
    schema = "doc_id long, lang_pred string, score double" + ", word_langs array<string>" * by_word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(field)
        for whole in batches:
            for at in range(0, len(whole), 512):
                b = whole.slice(at, 512)
                cut = [words(t) for t in b.column(1).to_pylist()]
                langs, scores, each = [UNKNOWN] * len(cut), [0.0] * len(cut), [[]] * len(cut)
                for k, post in labeller.posteriors(cut) if field.languages else ():
                    share = post.mean(axis=0)
                    best = int(share.argmax())
                    langs[k], scores[k] = field.languages[best], min(1.0, float(share[best]))
                    if by_word:
                        each[k] = [field.languages[i] for i in post.argmax(axis=1)]
                columns = [b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())]
                if by_word:
                    columns.append(pa.array(each, pa.list_(pa.string())))
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text", "lang")
    field = fit(docs.where(~held_out("doc_id", 4)))
    return identify(docs, field).select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")
