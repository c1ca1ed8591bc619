"""What the operators of this folder share: reading tables, shared scratch tables and let-bindings."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of characters other than these six; the pattern is Java's and Python's alike.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def held_out(doc_id: str, modulus: int) -> Column:
    """True where crc32 of the id's decimal text leaves remainder 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % modulus == 2, F.lit(False))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new temporary one where that is unset and Spark runs on one machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master or "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quire-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


def mounted(path: str) -> str:
    """The path of a folder that Python can open, for files that tasks map into memory."""
    parsed = urlparse(path)
    if parsed.scheme not in ("", "file"):
        raise ValueError(f"files are mapped into memory; {path} isn't a mounted folder. Pass one that the driver and all executors share as `folder`")
    return unquote(parsed.path)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as a table in the shared folder and read again, which cuts its lineage."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(columns: list[str], name: str) -> str:
    """The name, with underscores after it until no column has it, whatever its case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)
