"""The corpus pipeline: each stage is written as Parquet and read again as the next stage's documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quire.llm import near_dedup, packing, quality, toxicity
from quire.llm.common import shared_path

STAGES = [
    ("quality rules", quality.stage),
    ("toxicity", toxicity.stage),
    ("near-dedup", near_dedup.stage),
    ("packing", packing.stage),
]

#: Toxicity and packing are beyond SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that the stages keep.

    Null and empty texts fail the quality rules; texts of any length go through whole; of rows that are equal in id and
    text one stays; an empty table gives no rows; extra columns, whatever their names, pass through to the last stage.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage{k}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
