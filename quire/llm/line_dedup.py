"""Line dedup: lines that stand in many documents are dropped from all but one, in DataFrame functions only.

1. Texts are exploded to normalised lines, and each line's key becomes a hash of 128 bits; a key is one row for each
   place where it stands.
2. Distinct documents are counted for each hash. Counts combine before each exchange, so a line that stands in a third of
   all documents is a few rows of each task.
3. Places whose hash is over the threshold are collected for each text, and the text is put together again from the
   stretches between them, by position. Texts move once, and only when Spark finds the list of places too long to send.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import fresh, let, read, stored

#: A key of at least LENGTH code points found in at least DOCUMENTS documents is dropped.
LENGTH, DOCUMENTS = 20, 3
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def key_of(line: Column) -> Column:
    """The line without white space at its ends, A-Z in lower case. Only lines beyond ASCII take the slower way."""
    bare = F.btrim(line, F.lit(SPACES))
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def _whole(text: str) -> Column:
    return F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))


def _mark(text: Column) -> tuple[Column, Column]:
    """128 bits for a string, from two seeds."""
    return F.xxhash64(text), F.xxhash64(F.lit(7), text)


def places(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """(doc, t1, t2, pos, h1, h2): each place of a line whose key is long enough; t1 and t2 stand for the whole text."""
    whole = docs.select(F.col(f"`{doc_id}`").alias("doc"), _whole(text).alias("text"))
    t1, t2 = _mark(F.col("text"))
    lines = whole.select("doc", t1.alias("t1"), t2.alias("t2"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= length).withColumn("key", key_of(F.col("line"))).where(F.length("key") >= length)
    h1, h2 = _mark(F.col("key"))
    return keyed.select("doc", "t1", "t2", "pos", h1.alias("h1"), h2.alias("h2"))


def common_lines(found: DataFrame, documents: int = DOCUMENTS) -> DataFrame:
    """(h1, h2, n_docs, last): keys found in at least so many documents, and the largest of these."""
    counted = found.groupBy("h1", "h2").agg(F.countDistinct("doc").alias("n_docs"), F.max("doc").alias("last"))
    return counted.where(F.col("n_docs") >= documents)


def kept_text(lines: Column, dropped: Column) -> Column:
    """The lines without those at the dropped positions (ascending), joined: each stretch between two of them is cut out once."""
    ends = F.concat(dropped, F.array(F.size(lines)))
    begin = lambda k: F.coalesce(F.get(dropped, k - 1) + 1, F.lit(0))
    stretches = F.transform(ends, lambda end, k: F.slice(lines, begin(k) + 1, end - begin(k)))
    return F.array_join(F.flatten(stretches), "\n")


def without_common_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, documents: int = DOCUMENTS) -> DataFrame:
    """docs with ``n_lines``, ``n_dropped`` and ``kept_text``, the last three columns.

    A null or empty text is one empty line, whose key is too short ever to be dropped; a text that loses all its lines is
    kept as an empty one. Documents are counted by their id: repeated rows of an id count once and are treated alike, and
    where the largest id holds a line, all its lines stay. A row without an id counts for no document; its lines are
    dropped where others make them common. Texts of any length are taken whole. No rows give no rows. Where docs has a
    column of one of the new names, in whatever case, the new one gets an underscore after it.
    """
    found = stored(places(docs, doc_id, text, length), "lines")
    # a table of its own, so that Spark may split what stands for a very common line, or send the table if it is short
    common = stored(common_lines(found, documents).select("h1", "h2", "last"), "common")
    gone = found.join(common, ["h1", "h2"]).where(~F.col("doc").eqNullSafe(F.col("last")))
    at = gone.groupBy("doc", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("at"))
    added: list[str] = []
    for name in ("n_lines", "n_dropped", "kept_text"):
        added.append(fresh([*docs.columns, *added], name))
    t1, t2 = _mark(_whole(text))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(f"`{doc_id}`").alias("doc"), t1.alias("t1"), t2.alias("t2"))
    at = at.select(F.col("doc").alias("d"), F.col("t1").alias("u1"), F.col("t2").alias("u2"), "at")
    joined = rows.join(at, F.col("doc").eqNullSafe(F.col("d")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    whole = F.coalesce(F.col(f"own.`{text}`").cast("string"), F.lit(""))
    # the number of lines is that of line breaks and one; only texts that lose lines are split again
    count = (F.length(whole) - F.length(F.replace(whole, F.lit("\n"))) + 1).cast("long")
    none = F.col("at").isNull()
    kept = F.when(none, whole).otherwise(let(F.split(whole, "\n"), lambda x: kept_text(x, F.col("at"))))
    made = joined.select("own", count.alias("n"), F.when(none, F.lit(0)).otherwise(F.size("at")).cast("long").alias("gone"), kept.alias("kept"))
    return made.select(*(F.col(f"own.`{c}`").alias(c) for c in docs.columns), F.col("n").alias(added[0]), F.col("gone").alias(added[1]), F.col("kept").alias(added[2]))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_common_lines(read(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, pos, lines[pos] AS line,
    translate(trim(lines[pos], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos FROM d)
), c AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (c.last <> l.doc_id) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (c.last IS NULL OR c.last = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN c ON c.key = l.key GROUP BY l.doc_id
"""
