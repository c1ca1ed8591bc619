"""Chapters as files with a header, their manifest, and documents in versions: what is written is told by what is there already."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as T

KEYS = ["book_slug", "topic_number", "md_kind"]
HEADER = ("topic_number", "topic_name", "page_range", "source_markdown", "md_kind", "lines")
PICTURE = r"(?i)!\[[^\]]*\]\([^)]*\)|<img\b[^>]*>"


def has_pictures(body: Column) -> Column:
    return T.text(body).rlike(PICTURE)


def chapter_files(chunks: DataFrame, pictures: bool = True) -> DataFrame:
    """(book_slug, topic_number, md_kind, topic_name, page_range, source_markdown, lines, body) of chapters (the same, with start, end and markdown).

    ``lines`` is the range of the book's lines, from 1, that the chapter was cut from. Without pictures they go from the body.
    """
    body = T.text(F.col("markdown")) if pictures else T.without_images(F.col("markdown"))
    kind = F.col("md_kind") if "md_kind" in chunks.columns else F.lit("combined")
    span = F.concat_ws("-", (F.col("start") + 1).cast("string"), (F.col("end") + 1).cast("string"))
    return chunks.select("book_slug", F.col("topic_number").cast("int").alias("topic_number"), kind.alias("md_kind"), "topic_name", "page_range", "source_markdown", span.alias("lines"), body.alias("body"))


def halves(chunks: DataFrame, parts: DataFrame, keys: list[str]) -> DataFrame:
    """chunks twice, as theory and as examples, with the texts of their parts (keys, part, markdown): theory, and the rest in order."""
    cut = parts.groupBy(*keys).agg(F.max(F.when(F.col("part") == "theory", F.col("markdown"))).alias("_theory"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") != "theory", F.struct("part", "markdown")))), lambda x: x["markdown"]), "\n").alias("_examples"))
    both = chunks.drop("markdown").join(cut, keys, "left")
    each = F.explode(F.array(F.struct(F.lit("theory").alias("md_kind"), T.text(F.col("_theory")).alias("markdown")), F.struct(F.lit("examples").alias("md_kind"), T.text(F.col("_examples")).alias("markdown"))))
    return both.withColumn("_x", each).select(*(c for c in both.columns if c not in ("_theory", "_examples", "md_kind")), "_x.md_kind", "_x.markdown")


def decided(new: DataFrame, cached: DataFrame, force: bool = False, pictures: bool = True) -> DataFrame:
    """new with ``action`` and the body that is to stand in the file.

    A file is kept only if it was cut from the same lines; one without a recorded range counts as such. Of a kept one
    pictures are taken away if none are wanted, and one that lost them is written again from its source. Actions: write,
    split again, keep, strip, restore.
    """
    old = cached.select(*KEYS, F.lit(True).alias("_there"), T.text(F.col("lines")).alias("_lines"), T.text(F.col("body")).alias("_body"))
    both = new.join(old, KEYS, "left")
    moved = (F.col("_lines") != "") & (F.col("_lines") != F.col("lines"))
    shown = has_pictures(F.col("_body"))
    kept = F.when(shown, "keep" if pictures else "strip").otherwise("restore" if pictures else "keep")
    action = F.when(F.lit(force) | F.col("_there").isNull(), "write").when(moved, "split again").otherwise(kept)
    both = both.withColumn("action", action)
    body = F.when(F.col("action") == "keep", F.col("_body")).when(F.col("action") == "strip", T.without_images(F.col("_body"))).otherwise(F.col("body"))
    return both.withColumn("body", body).select(*new.columns, "action")


def write_chapters(rows: DataFrame, folder: str) -> None:
    """A text file for each chapter, its header before its body, in folders by book, topic and kind; those of other chapters stay.

    A chapter is one row and one task's write; books are dealt over tasks by chapter.
    """
    head = F.concat(F.lit("---\n"), *(x for c in HEADER for x in (F.lit(f"{c}: "), T.text(F.col(c)), F.lit("\n"))), F.lit("---\n\n"))
    files = rows.select(*(F.col(c).alias(f"{c}_") for c in KEYS), F.concat(head, "body").alias("value"))
    for c in KEYS:
        files = files.withColumnRenamed(f"{c}_", c)
    files.write.partitionBy(*KEYS).option("partitionOverwriteMode", "dynamic").option("lineSep", "\n").mode("overwrite").text(folder)


def read_chapters(spark: SparkSession, folder: str) -> DataFrame:
    """(book_slug, topic_number, md_kind, topic_name, page_range, source_markdown, lines, body, path): what write_chapters wrote, as the files themselves tell."""
    schema = "value string, book_slug string, topic_number int, md_kind string"
    rows = spark.read.schema(schema).text(folder, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    told = lambda c: T.strip(F.regexp_extract("value", rf"(?s)\A---\n(?:(?!---\n)[^\n]*\n)*?{c}:([^\n]*)\n", 1)).alias(c)
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)\A---\n.*?\n---\n\n?", ""), r"\n\z", "")
    return rows.select(*KEYS, *(told(c) for c in HEADER if c not in KEYS), body.alias("body"), "path")


def manifest(chapters: DataFrame) -> DataFrame:
    """(book_slug, topic_number, topic_name, page_range, lines, paths) of the chapters that are there: a path for each kind."""
    return chapters.groupBy("book_slug", "topic_number").agg(
        F.max("topic_name").alias("topic_name"), F.max("page_range").alias("page_range"), F.max("lines").alias("lines"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("md_kind", "path")))).alias("paths")
    )


def stale(recorded: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, recorded, lines, state) of topics whose files aren't of the lines that they would be cut from now: moved, missing, or left over."""
    now = chunks.select(*keys, F.col("lines").alias("_now"))
    both = recorded.select(*keys, F.col("lines").alias("recorded")).join(now, keys, "full")
    state = F.when(F.col("recorded").isNull(), "missing").when(F.col("_now").isNull(), "left over").when(T.text(F.col("recorded")) != T.text(F.col("_now")), "moved")
    return both.select(*keys, "recorded", F.col("_now").alias("lines"), state.alias("state")).where("state is not null")


def merged_text(chapters: DataFrame, kind: str = "combined") -> DataFrame:
    """(book_slug, markdown): a book's chapters as one text again, in order, a blank line between them. A book is one row of its own text."""
    x = F.array_sort(F.collect_list(F.struct("topic_number", "body")))
    return chapters.where(F.col("md_kind") == kind).groupBy("book_slug").agg(F.array_join(F.transform(x, lambda c: c["body"]), "\n\n").alias("markdown"))


def save(rows: DataFrame, path: str) -> int | None:
    """Writes rows as the next version of a table and returns its number; nothing, and None, where there are no rows.

    Versions are folders beside one another: the first stays as the original, an edit never touches what it was made
    from. A version counts when its number is written down, after its rows; what a failed write left is written over.
    """
    if rows.isEmpty():
        return None
    spark = rows.sparkSession
    number = (last_version(spark, path) or 0) + 1
    rows.write.mode("overwrite").parquet(f"{path}/data/version={number}")
    spark.range(number, number + 1, 1, 1).select(F.col("id").cast("int").alias("version")).write.mode("append").parquet(f"{path}/versions")
    return number


def last_version(spark: SparkSession, path: str) -> int | None:
    """The last version that was written to its end; none if there is none."""
    try:
        return spark.read.schema("version int").parquet(f"{path}/versions").agg(F.max("version").alias("v")).first()["v"]
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def load(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of a table, the last if none is given; 1 is the original."""
    number = version or last_version(spark, path)
    if number is None:
        raise ValueError(f"no version at {path}")
    return spark.read.parquet(f"{path}/data/version={number}")


def without_notes(books: DataFrame, notes: str = "study_notes") -> DataFrame:
    """books whose topics lose their study notes, which are kept as a table of their own."""
    return books.withColumn("topics", F.transform("topics", lambda t: t.dropFields(notes)))


def study_notes(books: DataFrame, notes: str = "study_notes") -> DataFrame:
    """(book_slug, topic_number, chapter_name, page_range, study_notes) of topics that have any."""
    slug = T.first_filled(F.col("metadata.book_slug"), T.book_slug(F.col("metadata.name")))
    rows = books.select(slug.alias("book_slug"), F.explode("topics").alias("t")).where(F.col(f"t.{notes}").isNotNull())
    return rows.select("book_slug", "t.topic_number", T.first_filled(F.col("t.chapter_name"), F.col("t.topic_name")).alias("chapter_name"), T.text(F.col("t.page_range")).alias("page_range"), F.col(f"t.{notes}").alias("study_notes"))


def merged_notes(new: DataFrame, there: DataFrame) -> DataFrame:
    """(book_slug, topics, topic_count): a book's notes in the order of its topics, new ones in place of those there."""
    keys = ["book_slug", "topic_number"]
    every = there.join(new.select(*keys), keys, "left_anti").unionByName(new)
    x = F.array_sort(F.collect_list(F.struct("topic_number", "chapter_name", "page_range", "study_notes")))
    return every.groupBy("book_slug").agg(x.alias("topics"), F.count("*").alias("topic_count"))


def is_student_summary(source: Column, summary: Column) -> Column:
    """Whether a topic's summary is a model's own and not empty."""
    return F.lower(T.strip(T.text(source))).isin(*fixed.KEPT_SUMMARIES) & T.filled(summary)
