"""Catalogue, search, facets, paging and reports: what viewers and the question bank ask for.

Sources hold very unequal numbers of rows, so every count is an aggregate that combines before its shuffle; no window
runs over a source.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T


def count_if(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def catalogue(rows: DataFrame, book: str, updated: str) -> DataFrame:
    return rows.groupBy(book).agg(F.count("*").alias("n_rows"), F.max(updated).alias("last_updated"))


def audit(rows: DataFrame, book: str, answer: str) -> DataFrame:
    """For each book: rows, and rows whose answer isn't blank."""
    return rows.groupBy(book).agg(F.count("*").alias("n_rows"), count_if(T.filled(F.col(answer))).alias("with_solution"))


def child_counts(parents: DataFrame, key: str, children: dict[str, DataFrame]) -> DataFrame:
    """parents with a count of each kind of child; 0 where there is none. Children are counted before they are joined."""
    for name, rows in children.items():
        parents = parents.join(rows.groupBy(key).agg(F.count("*").alias(name)), key, "left").withColumn(name, F.coalesce(name, F.lit(0).cast("long")))
    return parents


def page(rows: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(max(1, min(200, limit)))


def total_pages(n: Column, size: int) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(n / size))


def contains_any(needle: str, *columns: Column) -> Column:
    """Case-blind search over the columns joined by spaces; a blank needle finds nothing."""
    if not needle.strip():
        return F.lit(False)
    return F.lower(F.concat_ws(" ", *(T.text(c) for c in columns))).contains(needle.strip().lower())


def facet(rows: DataFrame, key: Column) -> DataFrame:
    """Counts of each value, blank ones as a dash."""
    return rows.groupBy(F.coalesce(F.nullif(T.text(key), F.lit("")), F.lit("—")).alias("value")).agg(F.count("*").alias("n"))


def bank_search(rows: DataFrame, chosen: dict[str, list], needle: str = "", text: str | None = None, ignore: str | None = None) -> DataFrame:
    """Any of the values within a dimension, all dimensions at once. ignore: the dimension whose facet is counted."""
    for name, values in chosen.items():
        if values and name != ignore:
            rows = rows.where(F.col(name).isin(values))
    return rows.where(contains_any(needle, F.col(text))) if needle and text else rows


def bank_facets(rows: DataFrame, chosen: dict[str, list]) -> DataFrame:
    """(dimension, value, n): a dimension's own choice doesn't narrow its facet; chosen values that match nothing count 0."""
    missed = {name: (~F.coalesce(F.col(name).isin(values), F.lit(False))).cast("int") if values else F.lit(0) for name, values in chosen.items()}
    total = reduce(add, missed.values())
    # each row once for every facet that it counts in, with no more than that facet's own choice against it
    each = F.array(*(F.when(total == miss, F.struct(F.lit(name).alias("dimension"), F.col(name).cast("string").alias("value"), F.lit(1).alias("n"))) for name, miss in missed.items()))
    counted = rows.select(F.explode(F.filter(each, lambda x: x.isNotNull())).alias("x")).select("x.*")
    picked = rows.sparkSession.createDataFrame([(name, str(v), 0) for name, values in chosen.items() for v in values], "dimension string, value string, n int")
    return counted.unionByName(picked).groupBy("dimension", "value").agg(F.sum("n").alias("n"))


def percent(part: Column, whole: Column, digits: int = 0) -> Column:
    """100 * part / whole, halves up; 0 without a whole."""
    scale = 10.0**digits
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.floor(part * 100.0 * scale / whole + 0.5) / scale)


def top_groups(rows: DataFrame, group: str, order: list[Column], k: int) -> DataFrame:
    """The first k of each group, found by a window that Spark limits before it shuffles."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("place", place).where(F.col("place") <= k)


def streaks(days: DataFrame, user: str, day: str) -> DataFrame:
    """Runs of days in a row: (user, first, last, n)."""
    run = F.date_sub(F.col(day), F.row_number().over(Window.partitionBy(user).orderBy(day)))
    return days.select(user, day).distinct().withColumn("_run", run).groupBy(user, "_run").agg(F.min(day).alias("first"), F.max(day).alias("last"), F.count("*").alias("n")).drop("_run")


def practice_report(answers: DataFrame, attempt: str, dimensions: dict[str, str], correct: str = "is_correct", seconds: str = "seconds") -> DataFrame:
    """(attempt, dimension, value, n_total, n_attempted, n_correct, n_skipped, score_pct, accuracy, seconds, avg_seconds) of practice attempts.

    ``correct`` is null where a question was skipped. dimensions: the report's names of what accuracy is broken down by, and
    their columns. The whole attempt is dimension "all". score_pct is the correct share of all questions, accuracy that of
    the attempted ones, null if there are none; both of 100, to one place, halves up. Time goes by all questions. Answers
    are counted once, by all dimensions together; an attempt's counts, a few rows whatever its answers, then meet and are
    added up for each dimension where they are.
    """
    named = answers.select(F.col(attempt).alias("attempt"), *(F.col(c).cast("string").alias(name) for name, c in dimensions.items()), F.col(correct).alias("_ok"), F.coalesce(F.col(seconds), F.lit(0)).alias("_s"))
    count = lambda c: F.count(F.when(c, 1))
    base = named.groupBy("attempt", *dimensions).agg(F.count("*").alias("n_total"), F.count("_ok").alias("n_attempted"), count(F.col("_ok")).alias("n_correct"), F.sum("_s").alias("seconds"))
    counts = ("n_total", "n_attempted", "n_correct", "seconds")
    of = lambda name, value: F.struct(F.lit(name).alias("dimension"), value.alias("value"))
    each = F.explode(F.array(of("all", F.lit(None).cast("string")), *(of(name, F.col(name)) for name in dimensions))).alias("_d")
    counted = base.repartition("attempt").select("attempt", each, *counts).groupBy("attempt", F.col("_d.dimension").alias("dimension"), F.col("_d.value").alias("value")).agg(*(F.sum(c).alias(c) for c in counts))
    pct = lambda a, b: F.when(F.col(b) > 0, T.half_up(100.0 * F.col(a) / F.col(b), 10.0))
    return counted.select(
        "attempt", "dimension", "value", "n_total", "n_attempted", "n_correct", (F.col("n_total") - F.col("n_attempted")).alias("n_skipped"),
        pct("n_correct", "n_total").alias("score_pct"), pct("n_correct", "n_attempted").alias("accuracy"), "seconds", (F.col("seconds") / F.col("n_total")).alias("avg_seconds"),
    )
