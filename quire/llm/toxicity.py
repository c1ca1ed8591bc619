"""Toxicity by noisy-channel deobfuscation.

A disguised span (leetspeak, letters spaced out, stretched letters) becomes a lattice: each character may be read as
itself, as a letter it stands for, as a word break, or as nothing. Viterbi decoding under a character trigram model of
the training texts picks the likeliest reading, and the restored words are scored.

- The character model counts every trigram of every training document; the table is bounded by its alphabet of 64 symbols.
- The classifier is fitted on at most about LABELLED labelled training documents of each class, chosen by a hash of
  their id. It weighs words and word beginnings by how much oftener toxic documents hold them. A document's score is a
  logistic curve over its two heaviest words together: toxicity is in a few words, wherever they stand in however long a
  text, so clean words neither lower a score nor does length raise it. Features that clean documents hold as often, and
  those of little weight, are left out of the table, as they never are among the heaviest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import held_out, read

#: The classifier's sample: labelled documents of each class, about.
LABELLED = 5000
THRESHOLD = 0.3
PREFIXES = range(3, 8)
MIN_DOCS = 2
SHRINK = 1.0
#: Entries of a task's memory of words already weighed.
MEMORY = 400_000

SIZE = 64
BREAK, OTHER = 0, 63
#: Letters that a character stands for in leetspeak.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l",
}
#: Costs of the channel, as natural logarithms of a reading's weight.
SUBSTITUTE, DROPS_REPEAT = -1.0, -0.4
#: A word break and nothing, for a character that stands for letters, for one that doesn't, and for a separator between single letters.
LETTERLIKE, PLAIN, SEPARATOR = (-4.0, -7.0), (-1.0, -1.0), (-3.0, -0.1)

SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")
SPELLED = re.compile(r"[^\W_]([.\-_*/~])[^\W_](?:\1[^\W_])+")
STRETCHED = re.compile(r"([^\W\d_])\1\1")
EDGES = ".,;:!?\"'()[]{}*-_…«»“”¿¡"


def _codes() -> np.ndarray:
    """Symbol of each code point below 0x180: a-z, then the letters from U+00DF on; white space breaks, the rest is OTHER."""
    table = np.full(0x180, OTHER, dtype=np.int64)
    table[[9, 10, 11, 12, 13, 32]] = BREAK
    table[ord("a") : ord("z") + 1] = np.arange(1, 27)
    accented = [c for c in range(0xDF, 0x100) if c != 0xF7]
    table[accented] = np.arange(27, 27 + len(accented))
    table[[0x153, 0x161]] = 27 + len(accented), 28 + len(accented)
    return table


CODES = _codes()


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    return np.where(points < 0x180, CODES[np.minimum(points, 0x17F)], OTHER)


def trigram_counts(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Counts of all symbol trigrams of all texts, each text between breaks. Each task sends its own sums only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, dtype=np.int64)
        for b in batches:
            for x in b.column(0).to_pylist():
                if x:
                    s = np.concatenate(([BREAK, BREAK], symbols(x), [BREAK]))
                    total += np.bincount((s[:-2] * SIZE + s[1:-1]) * SIZE + s[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    rows = docs.select(text).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(SIZE**3)
    for r in rows:
        counts[r["at"]] = r["n"]
    return counts.reshape(SIZE, SIZE, SIZE)


def character_model(counts: np.ndarray) -> np.ndarray:
    """log P(c | a, b): trigrams interpolated with bigrams, symbols and a uniform share."""
    uni = (counts.sum(axis=(0, 1)) + 1) / (counts.sum() + SIZE)
    bi_n = counts.sum(axis=0)
    bi = (bi_n + 4 * uni) / (bi_n.sum(axis=1, keepdims=True) + 4)
    tri = (counts + 4 * bi) / (counts.sum(axis=2, keepdims=True) + 4)
    return np.log(tri)


class Decoder:
    """Viterbi decoding of one span's lattice."""

    def __init__(self, model: np.ndarray):
        self.model = model.tolist()

    def readings(self, ch: str, before: str, separator: str) -> list[tuple[int | None, str, float]]:
        """(symbol or None for nothing, letter, weight) of what a character may be."""
        if ch.isalpha():
            code = int(CODES[ord(ch)]) if ord(ch) < 0x180 else OTHER
            found: list[tuple[int | None, str, float]] = [(code, ch, 0.0)]
            if ch == before:
                found.append((None, "", DROPS_REPEAT))
            return found
        found = [(int(CODES[ord(x)]), x, SUBSTITUTE) for x in LEET.get(ch, "")]
        breaks, drops = SEPARATOR if ch == separator else LETTERLIKE if found else PLAIN
        return [*found, (BREAK, " ", breaks), (None, "", drops)]

    def decode(self, span: str) -> str:
        model, spelled = self.model, SPELLED.fullmatch(span)
        separator = " " if " " in span else spelled[1] if spelled else ""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(BREAK, BREAK): (0.0, None)}
        before = ""
        for ch in span:
            following: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in best.items():
                for code, letter, weight in self.readings(ch, before, separator):
                    if code is None or (code == BREAK and b == BREAK):
                        state, total, way = (a, b), score + weight, path
                    else:
                        total = score + weight + model[a][b][code]
                        state, way = ((BREAK, BREAK) if code == BREAK else (b, code)), (letter, path)
                    if (held := following.get(state)) is None or total > held[0]:
                        following[state] = (total, way)
            best, before = following, ch
        path = max(((s + (0 if b == BREAK else model[a][b][BREAK]), p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])[1]
        letters = []
        while path:
            letters.append(path[0])
            path = path[1]
        return "".join(reversed(letters)).strip()


def disguised(token: str) -> bool:
    """Whether a token is decoded: it has letters, and characters among or beside them that its edges don't explain, or a stretched one."""
    if token.isalpha():
        return bool(STRETCHED.search(token))
    return any(c.isalpha() for c in token)


class Restorer:
    """Restored words of texts; remembers tokens up to a bound."""

    def __init__(self, model: np.ndarray):
        self.decoder = Decoder(model)
        self.memory: dict[str, tuple[str, ...]] = {}

    def token(self, token: str) -> tuple[str, ...]:
        if (found := self.memory.get(token)) is None:
            core = token.strip(EDGES)
            if core.isalpha() and not STRETCHED.search(core):
                found = (core,)
            else:
                found = tuple(self.decoder.decode(token).split()) if disguised(token) else ()
            if len(self.memory) >= MEMORY:
                self.memory.clear()
            self.memory[token] = found
        return found

    def spans(self, lowered: str) -> Iterator[str]:
        """Letters spaced out, each span decoded as one."""
        for m in SPACED.finditer(lowered):
            if sum(c.isalpha() for c in m[0]) >= 3:
                yield from self.decoder.decode(m[0]).split()

    def text(self, text: str) -> str:
        """The text with every disguised span restored."""
        decoded = SPACED.sub(lambda m: self.decoder.decode(m[0]) if sum(c.isalpha() for c in m[0]) >= 3 else m[0], text.lower())
        return " ".join(" ".join(self.token(t)) if disguised(t.strip(EDGES)) else t for t in decoded.split())


def features(word: str) -> list[str]:
    return [f"={word}", *(word[:k] for k in PREFIXES if len(word) >= k)]


def _words(restorer: Restorer, text: str) -> set[str]:
    lowered = text.lower()
    found = {w for t in set(lowered.split()) for w in restorer.token(t)}
    found.update(restorer.spans(lowered))
    return found


def _weight(a: float, b: float, share: float) -> float:
    """How much oftener than by chance toxic documents hold a feature that a toxic and b clean ones hold."""
    ea, eb = (a + b) * share, (a + b) * (1 - share)
    return math.log((a + SHRINK) / (ea + SHRINK)) - math.log((b + SHRINK) / (eb + SHRINK))


def _curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Slope and intercept of a logistic curve, by Newton's method; a ridge keeps the slope finite where classes part cleanly."""
    x = np.column_stack([x, np.ones(len(x))])
    ridge = np.diag([1.0, 1e-3])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (w * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta += np.clip(step, -1, 1)
    return np.array([max(beta[0], 0.0), beta[1]])


class Model:
    """What scoring needs: the character model, counts of features, the class share and the curve."""

    def __init__(self, chars: np.ndarray, table: dict[str, tuple[int, int]], share: float):
        self.chars, self.table, self.share = chars, table, share
        self.beta = np.array([0.0, math.log(max(share, 1e-6) / max(1 - share, 1e-6))])

    def heaviest(self, words: set[str], memory: dict[str, float] | None = None, own: int | None = None) -> float:
        """Weight of the two heaviest words; own: the label of a training document, which is then left out of the counts."""
        found = []
        for w in words:
            if memory is None or (x := memory.get(w)) is None:
                x = 0.0
                for f in features(w):
                    if (n := self.table.get(f)) is not None:
                        x = max(x, _weight(n[0] - (own == 1), n[1] - (own == 0), self.share))
                if memory is not None:
                    if len(memory) >= MEMORY:
                        memory.clear()
                    memory[w] = x
            if x > 0:
                found.append(x)
        return sum(sorted(found, reverse=True)[:2])

    def score(self, weight: float) -> float:
        z = float(self.beta[0] * weight + self.beta[1])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Model:
    """The model from rows (doc_id, text) and (doc_id, toxic). A document labelled twice counts as toxic if either says so.

    Labels of documents that docs doesn't hold count for nothing. A doc_id on several rows counts once, with the smallest
    of its texts. Without labels of both classes every score is the share of toxic ones, smoothed.
    """
    chars = character_model(trigram_counts(docs))
    ids = docs.where("text is not null").select("doc_id")
    marked = labels.where("doc_id is not null and toxic is not null").join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in marked.groupBy("toxic").count().collect()}
    part = {k: min(1.0, labelled / max(n.get(k, 0), 1)) for k in (0, 1)}
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    sample = marked.where((F.col("toxic") == 1) & (place < part[1]) | (F.col("toxic") == 0) & (place < part[0]))
    # broadcast: at most about twice `labelled` rows, by the fractions above
    known = docs.where("text is not null").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").cast("int").alias("toxic")).select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, found, seen = Restorer(chars), (Counter(), Counter()), [0, 0]
        for b in batches:
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[y].update({f for w in _words(restorer, t) for f in features(w)})
                seen[y] += 1
        names = list(found[0].keys() | found[1].keys())
        columns = [["", *names], [seen[1], *(found[1][f] for f in names)], [seen[0], *(found[0][f] for f in names)]]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], ["f", "a", "b"])

    totals = known.mapInArrow(count, "f string, a long, b long").groupBy("f").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # bounded by the sample: only features that several toxic documents hold, and oftener than clean ones
    rows = totals.where(f"f = '' or a >= {MIN_DOCS} and a > b").collect()
    table = {r["f"]: (r["a"], r["b"]) for r in rows}
    a, b = table.pop("", (0, 0))
    model = Model(chars, {f: x for f, x in table.items() if a + b and _weight(*x, a / (a + b)) > 0.5}, a / (a + b) if a + b else 0.0)
    if not a or not b:
        smoothed = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
        model.beta[1] = math.log(smoothed / (1 - smoothed))
        return model

    def tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(chars)
        for batch in batches:
            ys = batch.column(1).to_pylist()
            x = [model.heaviest(_words(restorer, t), None, y) for t, y in zip(batch.column(0).to_pylist(), ys)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), pa.array(ys, pa.int32())], ["x", "y"])

    x, y = np.array(known.mapInArrow(tops, "x double, y int").collect(), dtype=float).T
    model.beta = _curve(x, y, np.where(y == 1, 1 / part[1], 1 / part[0]))
    return model


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text", restored: bool = False) -> DataFrame:
    """(doc_id, score) for each row, and restored_text if asked for.

    Null and empty texts get the score of no toxic word. Repeated rows are scored each, texts of any length whole; an
    empty table gives no rows. Columns of docs other than the two named don't matter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, memory = Restorer(model.chars), {}
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            scores = [model.score(model.heaviest(_words(restorer, t), memory)) for t in texts]
            columns, names = [b.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"]
            if restored:
                columns, names = [*columns, pa.array([restorer.text(t) for t in texts], pa.string())], [*names, "restored_text"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, score double" + ", restored_text string" * restored
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def _fitted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> Model:
    return fit(docs.select("doc_id", "text").where(~held_out("doc_id", 4)), read(spark, sf_dir, "labels", "doc_id", "toxic"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents", "doc_id", "text")
    scored = score(docs, _fitted(spark, docs, sf_dir))
    return scored.select("doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose score reaches the threshold; the text goes through the tasks once and is not shuffled.

    A null text scores as an empty one; texts are scored whole; repeated rows are rows of their own; an empty table gives
    no rows. The columns stay as they are, whatever their names.
    """
    model = _fitted(spark, docs, sf_dir)
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, memory = Restorer(model.chars), {}
        for b in batches:
            keep = [model.score(model.heaviest(_words(restorer, t or ""), memory)) < THRESHOLD for t in b.column(at).to_pylist()]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
