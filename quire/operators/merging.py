"""Several parts about one topic as one: ordered unions of nested arrays, defaults, key points."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as T
from quire.operators.export import first_wins


class Union(NamedTuple):
    """How an array is merged: what makes two elements one, how many stay, and whether elements without a key stay."""

    key: Callable[[Column], Column]
    most: int | None = None
    keyless: bool = True


def by_id_or_title(x: Column) -> Column:
    return T.first_filled(x["id"], x["title"])


#: The arrays of a reply about a part of a topic.
REPLY = {
    "key_points": Union(lambda x: T.text(x["text"]), fixed.MERGED_POINTS, keyless=False),
    "case_studies": Union(by_id_or_title),
    "examples": Union(by_id_or_title),
    "practice_exercises": Union(lambda x: T.first_filled(x["id"], F.substring(T.text(x["question"]), 1, fixed.QUESTION_KEY_CHARS)), fixed.MERGED_PRACTICE),
}


def merge_parts(parts: DataFrame, keys: list[str], order: str, arrays: dict[str, Union] | None = None, summary: str | None = "summary", summaries: int = fixed.MERGED_SUMMARIES) -> DataFrame:
    """(keys, summary, arrays) of each topic (keys) from its parts: what a topic's parts hold, in their order, each element once.

    Of elements with one key the first stays, by part and place; an element without a key stays for itself or goes, as the
    array says. Summaries that are filled are joined. A topic whose parts hold nothing has empty arrays; null arrays are
    empty ones. All arrays are exploded at once and dealt out once, by topic: what sorts them comes after that, in
    partitions that are more by as much as the arrays multiply the rows. Elements hold no maps.
    """
    arrays = REPLY if arrays is None else arrays
    kinds = [(name, parts.schema[name].dataType.elementType, spec) for name, spec in arrays.items()]
    listed = {name: F.coalesce(F.col(name), F.array().cast(parts.schema[name].dataType)) for name in arrays}
    if summary:
        kinds.insert(0, (summary, parts.schema[summary].dataType, Union(lambda x: F.lit(""), summaries)))
        listed[summary] = F.filter(F.array(F.col(summary)), lambda x: T.text(x) != "")

    def tagged(k: int) -> Column:
        name, _, spec = kinds[k]
        own = lambda x: [(x if other == name else F.lit(None).cast(kind)).alias(other) for other, kind, _ in kinds]
        return F.transform(listed[name], lambda x, at: F.struct(F.lit(k).alias("_kind"), at.alias("_at"), spec.key(x).alias("_key"), *own(x)))

    names = [name for name, _, _ in kinds]
    rows = parts.select(*keys, F.col(order).alias("_part"), F.explode_outer(F.concat(*(tagged(k) for k in range(len(kinds))))).alias("_e")).select(*keys, "_part", "_e.*")
    dropped = [k for k, (_, _, spec) in enumerate(kinds) if not spec.keyless]
    kept = rows.where(~(F.coalesce(F.col("_kind"), F.lit(-1)).isin(dropped) & (F.col("_key") == ""))) if dropped else rows
    alone = F.concat_ws("/", F.lit("n"), F.col("_part").cast("string"), F.col("_at").cast("string"))
    # as many rows as arrays come of a part, so there are as many times the partitions
    dealt = len(kinds) * int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kept = first_wins(kept.repartition(dealt, *keys).withColumn("_key", F.when(F.col("_key") != "", F.concat(F.lit("k"), "_key")).otherwise(alone)), [*keys, "_kind", "_key"], ["_part", "_at"])
    limits = {k: spec.most for k, (_, _, spec) in enumerate(kinds) if spec.most is not None}
    if limits:
        place = F.row_number().over(Window.partitionBy(*keys, "_kind").orderBy("_part", "_at"))
        most = F.coalesce(*(F.when(F.col("_kind") == k, n) for k, n in limits.items()), F.lit(2**31 - 1))
        kept = kept.withColumn("_place", place).where(F.col("_place") <= most)
    each = [F.sort_array(F.collect_list(F.when(F.col("_kind") == k, F.struct("_part", "_at", F.col(name).alias("x"))))) for k, name in enumerate(names)]
    made = kept.groupBy(*keys).agg(*(c.alias(name) for c, name in zip(each, names)))
    plain = {name: F.transform(name, lambda e: e["x"]) for name in names}
    if summary:
        plain[summary] = F.array_join(plain[summary], "\n\n")
    return made.select(*keys, *(plain[name].alias(name) for name in names))


def with_defaults(topics: DataFrame, name: str = "topic_name") -> DataFrame:
    """topics with what a topic has at the least: a summary and a key point that name it, and empty texts and arrays for null ones."""
    own = T.text(F.col(name))
    point = F.array(F.struct(F.concat(F.lit("Study "), own, F.lit(" concepts.")).alias("text")))
    made = {"summary": T.first_filled(F.col("summary"), F.concat(F.lit("Topic: "), own)), "theory_notes": T.text(F.col("theory_notes"))}
    made["key_points"] = F.when(F.coalesce(F.size("key_points"), F.lit(0)) > 0, F.col("key_points")).otherwise(point)
    for c in ("case_studies", "examples", "practice_exercises"):
        made[c] = F.coalesce(F.col(c), F.array().cast(topics.schema[c].dataType))
    return topics.withColumns(made)


def key_points(bodies: Column, most: int = fixed.KEY_POINTS) -> Column:
    """Points of lists: lines that begin with a dash, a bracket or a number, without these marks, each once, in order."""
    every = F.flatten(F.transform(bodies, lambda b: T.lines(T.text(b))))
    listed = F.filter(F.transform(every, T.strip), lambda x: x.rlike(r"^(?:-|\(|\d+\.)"))
    bare = F.transform(listed, lambda x: T.strip(F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"(?U)^[-•]\s*", ""), r"(?U)^\(\w+\)\s*", ""), r"(?U)^\d+\.\s*", "")))
    return F.slice(F.array_distinct(F.filter(bare, lambda x: x != "")), 1, most)


def merged_points(own: Column, told: Column, most: int = fixed.KEY_POINTS) -> Column:
    """The points found, as they are, then those told that aren't among them, each once."""
    return F.slice(F.concat(own, F.filter(F.array_except(told, own), lambda x: x != "")), 1, most)


def first_those(items: Column, which: Callable[[Column], Column]) -> Column:
    """Those for which it holds before all others, both in their order."""
    yes = lambda x: F.coalesce(which(x), F.lit(False))
    return F.concat(F.filter(items, yes), F.filter(items, lambda x: ~yes(x)))
