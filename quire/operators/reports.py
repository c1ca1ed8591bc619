"""Reports over attempts, answers and chapters: aggregates that combine before their shuffle, and rules of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.operators.serve import count_if, percent


def histograms(rows: DataFrame, columns: dict[str, str]) -> DataFrame:
    """(kind, value, n): how often each value of several columns (by the names of kinds) stands in rows, in one pass over grouping sets. Null is a value of its own."""
    named = rows.select(*(F.col(c).cast("string").alias(kind) for kind, c in columns.items()))
    counted = named.groupingSets([[kind] for kind in columns], *columns).agg(F.count("*").alias("n"), *(F.grouping(kind).alias(f"_{k}") for k, kind in enumerate(columns)))
    kind, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, name in enumerate(columns):
        own = F.col(f"_{k}") == 0
        kind, value = F.when(own, name).otherwise(kind), F.when(own, F.col(name)).otherwise(value)
    return counted.select(kind.alias("kind"), value.alias("value"), "n")


def chapter_meta(questions: DataFrame, keys: list[str], answered: Column, with_figures: Column) -> DataFrame:
    """(keys, questions, answered, with_figures, answered_pct) of each chapter or book."""
    counted = questions.groupBy(*keys).agg(F.count("*").alias("questions"), count_if(answered).alias("answered"), count_if(with_figures).alias("with_figures"))
    return counted.withColumn("answered_pct", percent(F.col("answered"), F.col("questions")))


def whole_chapters(rows: DataFrame, keys: list[str], most: int, *totals: Column) -> DataFrame:
    """(keys, total, too_large, totals): what is exported of each chapter at once; of one with more rows than that its size alone, and null totals."""
    counted = rows.groupBy(*keys).agg(F.count("*").alias("total"), F.struct(*totals).alias("_x"))
    large = F.col("total") > most
    return counted.withColumn("too_large", large).withColumn("_x", F.when(~F.col("too_large"), F.col("_x"))).select(*keys, "total", "too_large", "_x.*")


def without_questions(chapters: DataFrame, questions: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters in which no question was found."""
    return chapters.join(questions.select(*keys), keys, "left_anti")


def exam_results(attempts: DataFrame, student: str, value: str, passing: float) -> DataFrame:
    """(student, exams_taken, avg_value, best_value, passed) of each student, to four places."""
    return attempts.groupBy(student).agg(F.count("*").alias("exams_taken"), F.round(F.avg(value), 4).alias("avg_value"), F.round(F.max(value), 4).alias("best_value"), count_if(F.col(value) >= passing).alias("passed"))


def exam_overview(results: DataFrame, exam: str, group: str, student: str, value: str) -> DataFrame:
    """(exam, class, students, average, best, worst): how each class did in each exam."""
    return results.groupBy(F.col(exam).alias("exam"), F.col(group).alias("class")).agg(
        F.countDistinct(student).alias("students"), F.round(F.avg(value), 2).alias("average"), F.max(value).alias("best"), F.min(value).alias("worst")
    )


def score_buckets(results: DataFrame, keys: list[str], value: str, width: float = 10, last: int = 9) -> DataFrame:
    """(keys, bucket, n): scores by buckets of a width, what lies beyond them in the first and the last."""
    bucket = F.least(F.lit(last), F.greatest(F.lit(0), F.floor(F.col(value) / width))).cast("long")
    return results.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def verdict(chosen: Column, right: Column) -> Column:
    """skip where nothing was chosen, else right or wrong."""
    return F.when(chosen.isNull(), "skip").when(chosen == right, "right").otherwise("wrong")


def marked(answers: DataFrame, keys: list[str], verdicts: Column, right: int = 4, wrong: int = -1, skipped: int = 0) -> DataFrame:
    """(keys, score, max_marks) under a marking scheme."""
    marks = F.when(verdicts == "right", right).when(verdicts == "wrong", wrong).otherwise(skipped)
    return answers.groupBy(*keys).agg(F.sum(marks).cast("long").alias("score"), (F.count("*") * right).alias("max_marks"))


def exam_phase(published: Column, start: Column, length: Column, now: Column) -> Column:
    """draft until it is published, then upcoming, live or ended by the time."""
    return F.when(~published, "draft").when(start > now, "upcoming").when(start + length >= now, "live").otherwise("ended")


def daily_progress(answers: DataFrame, student: str, at: str, days: int = 7) -> DataFrame:
    """(student, day, answered) of each student on each of the last days that anyone answered on; days without answers count 0."""
    daily = answers.groupBy(student, F.to_date(at).alias("day")).agg(F.count("*").alias("n"))
    last = daily.agg(F.max("day")).scalar()
    each = daily.select(student).distinct().withColumn("_last", last).select(student, F.explode(F.sequence(F.date_sub("_last", days - 1), F.col("_last"))).alias("day"))
    return each.join(daily, [student, "day"], "left").select(student, F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("n", F.lit(0)).cast("long").alias("answered"))


def with_enough(questions: DataFrame, keys: list[str], least: int) -> DataFrame:
    """(keys, n) of chapters with at least so many questions."""
    return questions.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def weakest(answers: DataFrame, student: str, subject: str, right: Column, most: int) -> DataFrame:
    """(student, subject): each student's subjects with the smallest share of right answers, ties by name."""
    from quire.operators.serve import top_groups

    rates = answers.groupBy(student, subject).agg(F.avg(right.cast("int")).alias("_rate"))
    return top_groups(rates, student, [F.col("_rate"), F.col(subject)], most).select(student, subject)


def recaps(sections: DataFrame, keys: list[str], order: list[str], every: int = 3) -> DataFrame:
    """sections with ``recap``, the number from 0 of the recap that follows them: one after every few sections of a chapter."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return sections.withColumn("recap", F.floor((place - 1) / every).cast("long"))


def carried(lines: DataFrame, keys: list[str], order: list[str], is_head: Column, value: Column) -> Column:
    """The value at the last heading up to a line, null before the first."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return F.last(F.when(is_head, value), ignorenulls=True).over(before)


def preview(c: Column) -> Column:
    """The lines of a text that hold anything, as they are."""
    return F.filter(F.split(c, "\n"), lambda x: F.trim(x) != "")


def exam_counts(exams: DataFrame, keys: list[str], phase: Column, attempts: Column) -> DataFrame:
    """(keys, total, hosted, drafts, ongoing, completed, future, attempts, first, last) of exams by their phases; exams without attempts count none.

    first and last are the range of their starts (a column ``start``), those without one left out.
    """
    p = lambda name: count_if(phase == name)
    return exams.groupBy(*keys).agg(
        F.count("*").alias("total"), count_if(phase != "draft").alias("hosted"), p("draft").alias("drafts"), p("live").alias("ongoing"), p("ended").alias("completed"), p("upcoming").alias("future"),
        F.sum(F.coalesce(attempts, F.lit(0))).alias("attempts"), F.min("start").alias("first"), F.max("start").alias("last"),
    )


def scaled_to_peak(series: DataFrame, keys: list[str], value: str) -> DataFrame:
    """series with ``pct``, each value's share of its group's peak (1 at least) of 100, halves up. The peak is an aggregate joined back, as a group may be of any size."""
    from quire.functions.text import half_up

    peaks = series.groupBy(*keys).agg(F.greatest(F.max(value), F.lit(1)).alias("_peak"))
    return series.join(peaks, keys).withColumn("pct", half_up(100.0 * F.col(value) / F.col("_peak")).cast("long")).drop("_peak")


def item_details(items: DataFrame, chapters: DataFrame, sources: DataFrame, chapter: str, source: str, wanted: Column | None = None) -> DataFrame:
    """(item, chapter, source) structs of items with their chapter and that one's source, null where there is none; of those wanted, if not all."""
    own = items if wanted is None else items.where(wanted)
    pack = lambda rows, key, name: rows.select(F.col(key).alias(f"_{name}"), F.struct(*rows.columns).alias(name))
    both = own.select(F.struct(*items.columns).alias("item")).join(pack(chapters, chapter, "chapter"), F.col(f"item.{chapter}") == F.col("_chapter"), "left")
    return both.join(pack(sources, source, "source"), F.col(f"chapter.{source}") == F.col("_source"), "left").select("item", "chapter", "source")


def labelled_values(values: DataFrame, labels: DataFrame, value: str, label: str) -> DataFrame:
    """values with the label of each, itself where it has none; of several labels the smallest."""
    named = labels.groupBy(value).agg(F.min(label).alias("_label"))
    return values.join(named, value, "left").withColumn(label, F.coalesce("_label", F.col(value).cast("string"))).drop("_label")


def most_recent(rows: DataFrame, at: str, n: int, *ties: str) -> DataFrame:
    """The last n rows by a time, those without one last: a top-n report, so n rows of each task meet."""
    return rows.orderBy(F.desc_nulls_last(at), *ties).limit(n)


def number_list(c: Column) -> Column:
    """The distinct numbers of a list between commas, null where it is empty: no filter then. What isn't a number raises an error."""
    parts = F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.nullif(F.array_sort(F.array_distinct(F.transform(parts, lambda x: x.cast("int")))), F.array().cast("array<int>"))


def find_topics(topics: DataFrame, numbers: Column | None, words: str = "") -> DataFrame:
    """Topics (topic_number, chapter_name) of a list of numbers, if there is one, whose name holds the words, whatever their case."""
    listed = F.lit(True) if numbers is None else numbers.isNull() | F.array_contains(numbers, F.col("topic_number"))
    return topics.where(listed & F.contains(F.lower(F.coalesce("chapter_name", F.lit(""))), F.lit(words.lower())))
