"""Reading and writing books: nested JSON documents, markdown, question banks and CSV reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators.export import BOOK


def read_books(spark: SparkSession, *paths: str) -> DataFrame:
    """Whole-file JSON documents with their source path; what doesn't parse is kept out. A file is a row, so a folder of any number of books is one scan."""
    rows = spark.read.schema(BOOK).option("multiLine", True).option("mode", "DROPMALFORMED").json(list(paths))
    return rows.select("*", F.col("_metadata.file_path").alias("source_path")).where("topics is not null or metadata is not null")


def books_in(spark: SparkSession, workspace: str) -> DataFrame:
    """Slugs of the folders that hold their own final document. Lists files and reads none."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_final.json").load(workspace).select("path")
    parts = F.split("path", "/")
    slug = F.element_at(parts, -2)
    return files.where(F.element_at(parts, -1) == F.concat(slug, F.lit("_final.json"))).select(slug.alias("book_slug"), "path").distinct()


def read_markdown(spark: SparkSession, *paths: str) -> DataFrame:
    """(book_slug, markdown, front) of whole files; a header block between two lines of dashes becomes a map."""
    rows = spark.read.text(list(paths), wholetext=True).select("value", F.col("_metadata.file_path").alias("path"))
    front = F.regexp_extract("value", r"(?s)\A---\n(.*?)\n---", 1)
    pairs = F.filter(F.transform(F.split(front, "\n"), lambda x: F.split(x, ":", 2)), lambda p: F.size(p) == 2)
    entries = F.map_from_entries(F.transform(pairs, lambda p: F.struct(F.trim(p[0]), F.trim(p[1]))))
    body = F.regexp_replace(F.regexp_replace("value", r"(?s)\A---\n.*?\n---", ""), r"\A\n+", "")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(_mathpix)?\.(md|markdown)$", "")
    return rows.select(T.book_slug(name).alias("book_slug"), body.alias("markdown"), entries.alias("front"), "path")


def preferred_markdown(files: DataFrame) -> DataFrame:
    """One cached text for each book: the converter's own before .md before .markdown."""
    rank = F.when(F.col("path").endswith("_mathpix.md"), 0).when(F.col("path").endswith(".md"), 1).otherwise(2)
    return files.groupBy("book_slug").agg(F.min_by(F.struct("markdown", "front", "path"), F.struct(rank, F.col("path"))).alias("x")).select("book_slug", "x.*")


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, base64) of picture files, each read once."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{png,jpg,jpeg,gif,webp}").load(folder).select("path", F.base64("content").alias("base64"))


def read_served(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A served table over JDBC, read in ranges of its key. The driver's jar must be there."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts, fetchsize=10_000)
    return reader.options(**options).load()


def write_table(rows: DataFrame, path: str, partition: str | None = None, replace: bool = False) -> None:
    """Parquet. With a partition column, replace overwrites the partitions that rows has and no others."""
    writer = rows.write.option("partitionOverwriteMode", "dynamic").mode("overwrite" if replace else "append")
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def write_json(rows: DataFrame, path: str, partition: str | None = None) -> None:
    (rows.write.partitionBy(partition) if partition else rows.write).option("ignoreNullFields", False).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    """Every cell quoted, quotes doubled, with a header."""
    rows.write.option("header", True).option("quoteAll", True).option("escape", '"').csv(path)


def validate(books: DataFrame) -> DataFrame:
    """(book_slug, source_path, errors, warnings) of each document."""
    none = F.size(F.coalesce("topics", F.array().cast(books.schema["topics"].dataType))) == 0
    unnumbered = F.exists("topics", lambda t: t["topic_number"].isNull())
    listed = lambda *pairs: F.filter(F.array(*(F.when(c, F.lit(m)) for c, m in pairs)), lambda x: x.isNotNull())
    missing: Column = F.col("metadata").isNull()
    return books.select(
        T.first_filled(F.col("metadata.book_slug"), T.book_slug(F.col("metadata.name"))).alias("book_slug"), "source_path",
        listed((missing & none, "empty document")).alias("errors"),
        listed((missing, "no metadata"), (none, "no topics"), (F.coalesce(unnumbered, F.lit(False)), "topic without a number")).alias("warnings"),
    )
