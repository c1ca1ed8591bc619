"""New books as they arrive, run through the same batch functions. An extension of the batch functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quire.operators.export import BOOK
from quire.sources.books import write_table


def pending(books: DataFrame, ledger: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Books without an entry of the same keys (name, version, source lines) in the ledger; all of them if forced."""
    return books if force else books.join(ledger.select(*keys), keys, "left_anti")


def stream_books(spark: SparkSession, folder: str, target: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame], partition: str = "book_slug") -> StreamingQuery:
    """Each micro-batch of new files is transformed and replaces its books' partitions, so a batch that runs again leaves the same table."""
    source = spark.readStream.schema(BOOK).option("multiLine", True).option("maxFilesPerTrigger", 1000).json(folder)

    def put(batch: DataFrame, _: int) -> None:
        write_table(transform(batch), target, partition, replace=True)

    return source.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
