"""Every text of a nested document: rewritten in place, or listed by its path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from quire.functions import fixed
from quire.functions import text as T
from quire.operators import markup as M


def _has_text(kind: K.DataType) -> bool:
    if isinstance(kind, K.ArrayType):
        return _has_text(kind.elementType)
    if isinstance(kind, K.StructType):
        return any(_has_text(f.dataType) for f in kind)
    return _has_text(kind.valueType) if isinstance(kind, K.MapType) else isinstance(kind, K.StringType)


def rewritten(c: Column, kind: K.DataType, change: Callable[[Column], Column]) -> Column:
    """A value of any schema with each of its texts changed. Keys of maps stay, nulls stay null, and what holds no text isn't touched."""
    if not _has_text(kind):
        return c
    if isinstance(kind, K.ArrayType):
        return F.transform(c, lambda x: rewritten(x, kind.elementType, change))
    if isinstance(kind, K.MapType):
        return F.transform_values(c, lambda _, x: rewritten(x, kind.valueType, change))
    if isinstance(kind, K.StructType):
        return F.when(c.isNotNull(), F.struct(*(rewritten(c[f.name], f.dataType, change).alias(f.name) for f in kind)))
    return F.when(c.isNotNull(), change(c))


def texts(c: Column, kind: K.DataType, path: Column | None = None) -> Column:
    """array<struct<path, value>>: the texts of a value of any schema, as names, [places from 0] and keys lead to them; nulls are left out."""
    listed = "array<struct<path:string,value:string>>"
    if not _has_text(kind):
        return F.array().cast(listed)
    path = F.lit("") if path is None else path
    below = lambda name: F.when(path == "", name).otherwise(F.concat(path, F.lit("."), name))
    if isinstance(kind, K.ArrayType):
        found = F.flatten(F.transform(c, lambda x, k: texts(x, kind.elementType, F.concat(path, F.lit("["), k.cast("string"), F.lit("]")))))
    elif isinstance(kind, K.MapType):
        found = F.flatten(F.transform(F.map_entries(c), lambda e: texts(e["value"], kind.valueType, below(e["key"].cast("string")))))
    elif isinstance(kind, K.StructType):
        found = F.concat(*(texts(c[f.name], f.dataType, below(F.lit(f.name))) for f in kind if _has_text(f.dataType)))
    else:
        found = F.when(c.isNotNull(), F.array(F.struct(F.when(path == "", "root").otherwise(path).alias("path"), c.alias("value"))))
    return F.coalesce(found, F.array().cast(listed))


def leaks(documents: DataFrame, keys: list[str], document: str, pattern: str = fixed.LATEX_LEAK, path: str | None = None) -> DataFrame:
    """(keys, path, value): the texts in which a pattern is found, formulas between dollars if none is given.

    path: a column that says where in a larger document each one stands, so that books come as rows of their topics.
    """
    at = None if path is None else F.col(path)
    found = F.filter(texts(F.col(document), documents.schema[document].dataType, at), lambda x: x["value"].rlike(pattern))
    # an inner explode would look for the pattern twice, the first time for a filter on the array's size
    return documents.select(*keys, F.explode_outer(found).alias("_x")).where("_x is not null").select(*keys, "_x.path", "_x.value")


def leaks_of_json(documents: DataFrame, keys: list[str], document: str, pattern: str = fixed.LATEX_LEAK, depth: int = 16, path: str | None = None) -> DataFrame:
    """The same of documents as JSON text, whose schemas may all differ: VARIANTs are exploded level by level, as deep as any goes, ``depth`` at most.

    A VARIANT holds its whole document, so a book of any size comes as rows of its topics, each with its ``path``. A deeper document, or a text that isn't JSON, raises an error rather than be passed over.
    """
    spark = documents.sparkSession
    rows = documents.select(*keys, (F.lit("") if path is None else F.col(path)).alias("path"), F.parse_json(F.col(document)).alias("v"))
    kind = F.regexp_extract(F.schema_of_variant("v"), "^[A-Z]+", 0)
    out = None
    for level in range(depth + 1):
        own = rows.withColumn("_kind", kind)
        plain = own.where("_kind = 'STRING'").select(*keys, F.when(F.col("path") == "", "root").otherwise(F.col("path")).alias("path"), F.variant_get("v", "$", "string").alias("value"))
        out = plain if out is None else out.unionAll(plain)
        held = own.where(F.col("_kind").isin("OBJECT", "ARRAY"))
        if level == depth:
            break
        step = F.when(F.col("_kind") == "ARRAY", F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.when(F.col("path") == "", "").otherwise("."), "key"))
        each = held.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()).select(F.col("pos"), F.col("key"), F.col("value").alias("_below")))
        rows = each.select(*keys, F.concat("path", step).alias("path"), F.col("_below").alias("v"))
    deep = held.select(*keys, "path", F.raise_error(F.concat(F.lit(f"deeper than {depth} levels at "), "path")).cast("string").alias("value"))
    return out.unionAll(deep).where(F.col("value").rlike(pattern))


def plain_formulas(c: Column) -> Column:
    """A text's formulas, between dollars or as MathML, as readable text."""
    return M.mathml_text(M.without_formulas(c))


def without_formulas(documents: DataFrame, document: str) -> DataFrame:
    """documents with the formulas of all texts of a nested column as readable text."""
    return documents.withColumn(document, rewritten(F.col(document), documents.schema[document].dataType, plain_formulas))


def with_image_tokens(documents: DataFrame, document: str, ids: Column) -> DataFrame:
    """documents with the pictures of all texts of a nested column as tokens, by the map of addresses and ids that each row has."""
    from quire.operators.figures import tokenised

    return documents.withColumn(document, rewritten(F.col(document), documents.schema[document].dataType, lambda c: tokenised(c, ids)))
