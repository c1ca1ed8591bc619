"""Topics as they are laid out for reading: labelled arrays, titles, case studies, questions of exercises as examples."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import classify as K
from quire.functions import fixed
from quire.functions import text as T
from quire.operators import segment as S
from quire.operators.export import rename_all_repeats


def _any(c: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(or_, (T.strip(T.text(c)).rlike(p) for p in patterns))


def is_bank_title(title: Column) -> Column:
    """Whether a heading is one of exercises or of an examination."""
    return _any(title, fixed.BANK_TITLES)


def is_non_theory_title(title: Column, series: tuple[str, ...] = ()) -> Column:
    """Whether a heading isn't theory: exercises, illustrations, solutions, checks; a series of books adds its own patterns."""
    return is_bank_title(title) | _any(title, fixed.NON_THEORY_TITLES + series)


def is_side_title(title: Column) -> Column:
    """Whether a heading is of a box beside the text."""
    return _any(title, fixed.SIDE_TITLES)


def without_checks(body: Column) -> Column:
    """A body without its checks of knowledge: from each banner to the line of its solution, or to the end."""
    # most bodies have none, which a look for the words tells sooner than the pattern
    bare = lambda s: F.when(F.lower(s).contains("check your knowledge"), F.regexp_replace(s, fixed.INLINE_CHECK, "")).otherwise(s)
    return T.compact(T.bind(F.regexp_replace(T.text(body), r"\R", "\n"), bare))


def short_title(c: Column) -> Column:
    return T.truncate(T.collapse(F.regexp_replace(F.regexp_replace(T.text(c), fixed.MATH, " "), r"<[^>]+>", " ")), fixed.TITLE_CHARS)


def theory_sections(rows: DataFrame, keys: list[str], series: tuple[str, ...] = ()) -> DataFrame:
    """(keys, order, topics, markdown) of a chapter's lines: its sections that are theory, without checks of knowledge."""
    found = S.sections(rows, keys).where(~is_non_theory_title(F.col("title"), series)).withColumn("body", without_checks(F.col("body"))).where("title <> '' or body <> ''")
    found = found.withColumn("order", F.row_number().over(Window.partitionBy(*keys).orderBy("section")))
    head = F.concat(F.lit("## "), "title")
    markdown = F.when(F.col("title") == "", F.col("body")).when(F.col("body") == "", head).otherwise(F.concat(head, F.lit("\n\n"), "body"))
    return found.select(*keys, "order", T.first_filled(short_title(F.col("title")), F.concat(F.lit("Section "), F.col("order").cast("string"))).alias("topics"), markdown.alias("markdown"))


def case_prompts(body: Column) -> Column:
    """array<struct<label, text>>: the labelled prompts of a case study; lines between them go on, pictures and headings don't count."""
    kept = F.filter(F.transform(T.lines(T.text(body)), T.strip), lambda x: (x != "") & ~x.startswith("!["))

    def prompt(p: Column) -> Column:
        rest = F.filter(F.split(F.regexp_replace(p, f"^{fixed.CASE_PROMPT}", ""), "\n"), lambda x: ~x.startswith("##"))
        return F.struct(F.regexp_extract(p, f"^{fixed.CASE_PROMPT}", 1).alias("label"), T.strip(F.array_join(rest, "\n")).alias("text"))

    return T.bind(T.pieces(F.array_join(kept, "\n"), fixed.CASE_PROMPT), lambda p: F.transform(F.slice(p, 2, F.size(p)), prompt))


def case_studies(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, id, title, description, questions) of a chapter's lines."""
    found = S.sections(rows, keys, fixed.CASE_STUDY_HEADING).where("section > 0")
    questions = F.transform(case_prompts(F.col("body")), lambda p: p["text"])
    return found.select(*keys, F.concat(F.lit("case_study_"), F.col("section").cast("string")).alias("id"), "title", F.col("body").alias("description"), questions.alias("questions"))


def labelled(topics: DataFrame, examples: str = "examples") -> DataFrame:
    """topics with an array for each label of their examples' source_type, what has no label of its own among the exercises, and the chapter's name.

    Columns named as the arrays are replaced; a null array gives empty ones.
    """
    every = F.coalesce(F.col(examples), F.array())
    kinds = [kind for _, kind in fixed.EXAMPLE_ARRAYS]

    def only(kind: str) -> Column:
        return F.filter(every, lambda e: F.coalesce(e["source_type"] == kind, F.lit(False)))

    of = {name: only(kind) for name, kind in fixed.EXAMPLE_ARRAYS}
    of["exercises"] = F.filter(every, lambda e: ~F.coalesce(e["source_type"].isin(*kinds), F.lit(False)))
    named = {"chapter_name": T.strip(T.first_filled(*(F.col(c) for c in ("chapter_name", "topic_name") if c in topics.columns)))}
    return topics.withColumns({**of, **named}).drop("topic_name")


def bank_examples(questions: DataFrame, keys: list[str], order: list[str], offset: int = 0) -> DataFrame:
    """Questions of exercises (keys book_slug and topic_number; title, subsection_title, subsection, number, prompt, solution, passage, source_line) as examples.

    Numbers in ids run through a topic in the given order. source_order is the line's place after the offset.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    part, number = T.strip(T.text(F.col("subsection_title"))), T.text(F.col("number"))
    apart = (part != "") & ~F.contains(F.lower("title"), F.lower(part))
    label = F.when(apart, F.concat("title", F.lit(" — "), part)).otherwise(F.col("title"))
    source = F.when(part.rlike(fixed.TEXTBOOK_WORDS) | F.col("title").rlike(fixed.TEXTBOOK_WORDS), "textbook_exercise").otherwise("exercise")
    rows = questions.withColumn("_n", place).withColumn("_source", source)
    return rows.select(
        *keys, T.database_id(F.col(keys[0]), F.col(keys[1]), F.lit("q"), F.col("_n")).alias("id"), F.concat(label, F.lit(" — Q"), number).alias("title"),
        T.text(F.col("prompt")).alias("problem"), T.text(F.col("solution")).alias("solution"), F.col("_source").alias("source_type"),
        K.question_type(F.col("prompt"), F.col("_source"), part).alias("question_type"), number.alias("question_number"), part.alias("subsection_title"),
        T.text(F.col("subsection")).alias("subsection_kind"), (F.coalesce("source_line", F.lit(0)) + offset).cast("int").alias("source_order"), T.text(F.col("passage")).alias("passage"),
    )


def with_bank(examples: DataFrame, bank: DataFrame, keys: list[str]) -> DataFrame:
    """A topic's illustrations and checks of knowledge, then its bank's examples; ids that repeat get numbers."""
    kept = examples.where(F.col("source_type").isin(*fixed.KEPT_EXAMPLES)).withColumn("_half", F.lit(0)).unionByName(bank.withColumn("_half", F.lit(1)), allowMissingColumns=True)
    return rename_all_repeats(kept, keys, "id", ["_half", "source_order"]).drop("_half")
