"""Quality checks over questions (book_slug, chapter, number, question, answer, ...), each a finding for each book.

Every check is an aggregate or an anti-join; a finding is (book_slug, check, severity, n, message).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as T


def upper_median(n: Column) -> Column:
    """The middle of the sorted counts, the upper one of two. Of chapters in a book, a short list."""
    return F.element_at(F.array_sort(F.collect_list(n)), (F.call_function("div", F.count(n), F.lit(2).cast("long")) + 1).cast("int"))


def size_outliers(rows: DataFrame, book: str, chapter: str, ratio: float = fixed.SIZE_RATIO, least: int = 10) -> DataFrame:
    """Chapters of over ratio times their book's median, in books of three chapters and a median of at least `least`."""
    n = rows.groupBy(book, chapter).agg(F.count("*").alias("n"))
    per = n.groupBy(book).agg(upper_median(F.col("n")).alias("median"), F.count("*").alias("chapters")).where((F.col("chapters") >= 3) & (F.col("median") >= least))
    return n.join(per, book).where(F.col("n") > ratio * F.col("median")).select(book, chapter, "n", "median")


def cross_chapter_copies(rows: DataFrame, book: str, chapter: str, text: str, order: str) -> DataFrame:
    """Rows whose passage another chapter of the book had first. Keys are combined before the shuffle."""
    keyed = rows.withColumn("key", T.prose_key(F.col(text))).where("key is not null").select(book, chapter, "key", order)
    first = keyed.groupBy(book, "key").agg(F.min_by(chapter, order).alias("first_chapter"))
    return keyed.join(first, [book, "key"]).where(F.col(chapter) != F.col("first_chapter")).drop("key")


def measured(text: Column) -> Column:
    """struct<size, key> of a text, from one look at it: its characters and its passage's key, both without MathML and pictures."""
    bare = F.regexp_replace(F.regexp_replace(T.text(text), fixed.MATH, ""), fixed.IMAGE, "")
    key = lambda s: T.bind(F.substring(T.collapse(s), 1, 120), lambda k: F.when(F.length(k) >= 60, k))
    return T.bind(bare, lambda s: F.struct(F.length(T.strip(s)).cast("long").alias("size"), key(s).alias("key")))


def chapter_findings(rows: DataFrame, chapter: str, text: str, order: str, limit: int = fixed.RUNON_CHARS) -> DataFrame:
    """(book_slug, check, severity, n) of chapters: their runaway texts, and those that another chapter had first.

    Texts are read and measured once; a passage that stands in any number of rows is one row of each chapter before it
    meets those of other chapters.
    """
    each = rows.select(F.col(chapter).alias("book_slug"), F.col(order).alias("_o"), measured(F.col(text)).alias("_m"))
    per = each.groupBy("book_slug", F.col("_m.key").alias("_key")).agg(F.count("*").alias("_n"), F.count_if(F.col("_m.size") > limit).alias("_over"), F.min("_o").alias("_o"))
    # texts without a key stand alone; of a passage there is a row for each chapter at most
    alone = Window.partitionBy(F.coalesce("_key", F.concat(F.lit("\x00"), "book_slug")))
    first = F.min(F.struct("_o", "book_slug")).over(alone)["book_slug"]
    counted = per.withColumn("_copy", F.when(F.col("_key").isNotNull() & (F.col("book_slug") != first), F.col("_n")).otherwise(0)).groupBy("book_slug").agg(F.sum("_over").alias("over"), F.sum("_copy").alias("copies"))
    kinds = (("runaway questions", "fail", "over"), ("copies of another chapter", "warn", "copies"))
    found = F.explode(F.array(*(F.struct(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col(c).alias("n")) for check, severity, c in kinds)))
    return counted.select("book_slug", found.alias("_x")).select("book_slug", "_x.*").where("n > 0")


def lost_keys(rows: DataFrame, book: str, chapter: str, answer: Column) -> DataFrame:
    """Chapters with questions enough and hardly an answer, where some chapter of the book has answers."""
    rate = rows.groupBy(book, chapter).agg(F.count("*").alias("n"), F.avg(answer.cast("int")).alias("rate")).where(F.col("n") >= fixed.MIN_ANSWER_QUESTIONS)
    best = rate.groupBy(book).agg(F.max("rate").alias("best"))
    return rate.join(best, book).where((F.col("best") >= fixed.ANY_RATE) & (F.col("rate") < fixed.LOW_RATE)).drop("best")


def runaways(rows: DataFrame, *texts: str, limit: int = fixed.RUNON_CHARS) -> DataFrame:
    size = sum((T.text_length(F.col(c)) for c in texts), F.lit(0).cast("long"))
    return rows.withColumn("size", size).where(F.col("size") > limit)


def furniture(rows: DataFrame, *texts: str) -> DataFrame:
    """(pattern, n): rows with a hit of each pattern in any of the texts, all patterns in one pass."""
    hit = lambda p: F.greatest(*(T.text(F.col(c)).rlike(p) for c in texts)) if len(texts) > 1 else T.text(F.col(texts[0])).rlike(p)
    counts = rows.agg(*(F.count_if(hit(p)).alias(name) for name, p in fixed.FURNITURE))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(name).alias("pattern"), F.col(f"`{name}`").alias("n")) for name, _ in fixed.FURNITURE))).alias("x")).select("x.*")


def answers_that_are_questions(rows: DataFrame, questions: DataFrame, answer: str, question: str) -> DataFrame:
    keys = questions.select(T.prose_key(F.col(question)).alias("_key")).where("_key is not null").distinct()
    return rows.withColumn("_key", T.prose_key(F.col(answer))).join(keys, "_key", "left_semi").drop("_key")


def keys_outside_options(rows: DataFrame, answer: str, options: str) -> DataFrame:
    """Rows whose one-letter answer none of their options has; case doesn't matter."""
    key = F.lower(T.strip(T.text(F.col(answer))))
    named = F.transform(F.map_keys(options), F.lower)
    return rows.where(key.rlike("^[a-z]$") & ~F.coalesce(F.array_contains(named, key), F.lit(False)))


def unresolved_figures(rows: DataFrame, text: Column, known: str) -> DataFrame:
    """Rows with the image tokens that their own list of ids doesn't have, repeats included."""
    missing = F.filter(T.image_tokens(text), lambda x: ~F.array_contains(F.col(known), x))
    return rows.withColumn("missing", missing).where(F.size("missing") > 0)


def finding(rows: DataFrame, book: str, check: str, severity: str) -> DataFrame:
    """(book_slug, check, severity, n): nothing for books without a case."""
    return rows.groupBy(F.col(book).alias("book_slug")).agg(F.count("*").alias("n")).select("book_slug", F.lit(check).alias("check"), F.lit(severity).alias("severity"), "n")


def report(findings: DataFrame) -> DataFrame:
    """One text for each book with findings, failures first."""
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), F.col("check"), F.lit(": "), F.col("n").cast("string"))
    rank = F.when(F.col("severity") == "fail", 0).otherwise(1)
    lines = F.array_sort(F.collect_list(F.struct(rank.alias("rank"), F.col("check").alias("check"), line.alias("line"))))
    return findings.groupBy("book_slug").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("report"), F.max(F.col("severity") == "fail").alias("failed"))
