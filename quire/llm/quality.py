"""Quality rules as a bitmask ledger, in DataFrame functions only.

Every rule is evaluated once for each document. The ledger keeps the measurements and one failure bit for each
rule; a policy is a versioned mask over these bits, so that changing or ablating a policy never reads a text again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import WORD, fresh, let, read

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"

#: name -> failure condition over the measurements. A rule's bit is its place in this list; append only.
RULES: list[tuple[str, str]] = [
    ("too_few_words", "n_words < 50"),
    ("repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    ("symbol_heavy", "10 * n_symbols > n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 8 * n_lines"),
    ("short_words", "word_chars < 2 * n_words"),
    ("long_words", "word_chars > 20 * n_words"),
    ("few_letters", "10 * n_letters < 6 * word_chars"),
]
BIT = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: version -> mask of the rules whose failure rejects a document.
BASE = BIT["too_few_words"] | BIT["repeated_windows"]
POLICIES = {"base": BASE, "v1": sum(BIT.values())}


def _repeat_words(words: Column) -> Column:
    """Words that lie in a window of three words found twice or more.

    The windows' hashes are sorted with their positions in the low bits; neighbours that share a hash are candidates,
    and only those are compared by their words. Sorting keeps this at n log n for the most repetitive text.
    """
    bits = F.length(F.bin(F.size(words).cast("long")))
    mask = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - F.lit(1).cast("long")
    window = lambda w, i: F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))

    def packed(low: Column) -> Column:
        high = F.bitwise_not(low)
        return F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).bitwiseAND(high).bitwiseOR(i.cast("long")),
        )

    def candidates(ordered: Column, low: Column) -> Column:
        same = lambda p, q: F.coalesce(F.bitwise_not(low).bitwiseAND(p.bitwiseXOR(q)) == 0, F.lit(False))
        hits = F.filter(ordered, lambda p, k: same(p, F.get(ordered, k + 1)) | same(p, F.get(ordered, k - 1)))
        return F.transform(hits, lambda p: p.bitwiseAND(low).cast("int"))

    def exact(at: Column) -> Column:
        pairs = F.sort_array(F.transform(at, lambda i: F.struct(window(words, i).alias("g"), i.alias("i"))))
        same = lambda s, t: F.coalesce(s["g"] == t["g"], F.lit(False))
        return let(pairs, lambda p: F.sort_array(F.transform(F.filter(p, lambda s, k: same(s, F.get(p, k + 1)) | same(s, F.get(p, k - 1))), lambda s: s["i"])))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, k: F.least(F.lit(3), F.coalesce(F.get(at, k + 1) - p, F.lit(3))).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: a + b)

    found = let(mask, lambda low: let(F.sort_array(packed(low)), lambda ordered: candidates(ordered, low)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(
        let(found, lambda at: F.when(F.size(at) == 0, F.lit(0).cast("long")).otherwise(let(exact(at), covered)))
    )


def measurements(text: str = "text") -> Column:
    """The struct of a text's measurements; a null text counts as empty."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    counted = let(F.regexp_extract_all(t, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    flat = F.translate(t, SPACES, "")
    return let(
        F.struct(counted.alias("c"), by_line.alias("l"), flat.alias("flat")),
        lambda x: F.struct(
            x["c"]["n_words"].alias("n_words"),
            F.length(x["flat"]).cast("long").alias("word_chars"),
            (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
            F.length(F.regexp_replace(x["flat"], r"[^\p{L}]+", "")).cast("long").alias("n_letters"),
            x["l"]["n_lines"].alias("n_lines"),
            x["l"]["n_dup_lines"].alias("n_dup_lines"),
            x["c"]["n_repeat_words"].alias("n_repeat_words"),
        ),
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_letters", "n_lines", "n_dup_lines", "n_repeat_words")


def ledger(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with ``measured`` and ``fail_bits`` (bit k: rule k failed), the last two columns.

    Null and empty texts have no words and fail ``too_few_words``; texts of any length are measured whole; repeated rows
    each get their own entry; no rows give none. Columns of docs stay as they are: where docs has a column of one of
    these names, the ledger's own gets an underscore after it (``names`` tells).
    """
    measured, bits = names(docs)
    failed = None
    for k, (_, rule) in enumerate(RULES):
        bit = F.when(F.expr(_within(rule, measured)), F.lit(1 << k)).otherwise(F.lit(0)).cast("long")
        failed = bit if failed is None else failed.bitwiseOR(bit)
    return docs.withColumn(measured, measurements(text)).withColumn(bits, failed)


def names(docs: DataFrame) -> tuple[str, str]:
    """The names of the ledger's two columns beside those of docs."""
    return fresh(docs.columns, "measured"), fresh(docs.columns, "fail_bits")


def _within(rule: str, measured: str) -> str:
    """A rule's text with each measurement taken from the struct, whatever other columns are called."""
    return " ".join(f"`{measured}`.{x}" if x in MEASURES else x for x in rule.split(" "))


def verdict(policy: str, bits: str = "fail_bits") -> Column:
    """True where no rule of the policy failed."""
    return F.col(bits).bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def ablation(entries: DataFrame, policy: str, bits: str = "fail_bits") -> DataFrame:
    """For each rule of a policy: documents that fail it, fail it alone, and are kept without it.

    Entries are first counted by their bit pattern, at most 2**len(RULES) rows, so no text and no measurement is read.
    """
    mask = POLICIES[policy]
    patterns = entries.groupBy((F.col(bits).bitwiseAND(F.lit(mask).cast("long"))).alias("b")).agg(F.count("*").alias("n"))
    rules = F.array(*(F.struct(F.lit(name).alias("rule"), F.lit(BIT[name]).cast("long").alias("bit")) for name, _ in RULES if BIT[name] & mask))
    each = patterns.select("b", "n", F.explode(rules).alias("r"))
    number = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    hit = F.col("b").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("b").bitwiseAND(F.bitwise_not(F.col("r.bit")))
    return each.groupBy(F.col("r.rule").alias("rule")).agg(
        number(hit).alias("n_failed"), number(hit & (rest == 0)).alias("n_failed_alone"), number(rest == 0).alias("n_kept_without")
    )


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = ledger(read(spark, sf_dir, "documents", "doc_id", "text"))
    return entries.select(
        "doc_id",
        *(F.col(f"measured.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        "fail_bits",
        (~verdict("base")).alias("base_failed"),
        verdict("v1").alias("kept"),
    )


#: fail_bits and the verdict restate RULES over the measurements.
OP7_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM g) WHERE c > 1
  ) GROUP BY doc_id
), l AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM w)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id
), m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup, 0)::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '[^\p{L}]+', '', 'g'))::BIGINT AS n_letters
  FROM w LEFT JOIN r USING (doc_id) LEFT JOIN l USING (doc_id)
), b AS (
  SELECT *, ((n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (10 * n_dup_lines > 8 * n_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 20 * n_words)::BIGINT
    + 64 * (10 * n_letters < 6 * word_chars)::BIGINT)::BIGINT AS fail_bits FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, fail_bits, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept FROM b
"""


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that the policy rejects; its columns as they are."""
    return ledger(docs).where(verdict("v1", names(docs)[1])).select(*(F.col(f"`{c}`") for c in docs.columns))
