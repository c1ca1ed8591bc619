"""Segmentation, alignment and parsing of chapters that Spark builds from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import parse as P
from quire.operators import segment as S
from quire.plans.registry import query, read, spread

_FLAG = {"A": "Single Option Correct", "N": "Fill in the Blanks", "R": "True / False"}


def order_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, markdown): an order as a chapter, with an exercise, a sub-section for each flag, and a numbered line for each line."""
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_returnflag", "l_linenumber", "l_partkey", "l_suppkey")
    # an order's lines meet once, as numbers, and become text in their own row
    whole = lines.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_set(F.struct("l_returnflag", "l_linenumber", "l_partkey", "l_suppkey")).alias("x"))
    line = lambda r, a, b: F.concat(r["l_linenumber"].cast("string"), F.lit(a), r[b].cast("string"))
    told = F.transform("x", lambda r: F.struct(r["l_returnflag"].alias("f"), r["l_linenumber"].alias("n"), line(r, ". Part ", "l_partkey").alias("q"), line(r, ". Supplier ", "l_suppkey").alias("a")))
    whole = whole.select("o_orderkey", F.sort_array(told).alias("x"))
    titles = F.create_map(*(F.lit(x) for kv in _FLAG.items() for x in kv))
    half = lambda f, k: F.concat(F.lit("## "), titles[f], F.lit("\n"), F.array_join(F.transform(F.filter("x", lambda r: r["f"] == f), lambda r: r[k]), "\n"))
    join = lambda k: F.array_join(F.transform(F.array_distinct(F.transform("x", lambda r: r["f"])), lambda f: half(f, k)), "\n\n")
    return whole.select("o_orderkey", F.concat(F.lit("## Theory\n\nSome prose.\n\n## Exercise 1\n\n"), join("q"), F.lit("\n\n## SOLUTIONS\n\n## Exercise 1\n\n"), join("a")).alias("markdown"))


_CHAPTER_LINES = """
WITH l AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber, l_partkey, l_suppkey FROM lineitem),
d AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber, 'Part ' || l_partkey AS q, 'Supplier ' || l_suppkey AS a FROM l)
"""


@query(_CHAPTER_LINES + """
SELECT l_orderkey AS o_orderkey, CASE l_returnflag WHEN 'A' THEN 'single_option' WHEN 'N' THEN 'fill_blanks' ELSE 'true_false' END AS kind, l_linenumber::VARCHAR AS number, q AS text FROM d
""")
def blocks_parse(spark, sf_dir):
    """The questions of every chapter by its headings."""
    return S.chapter_blocks(order_chapters(spark, sf_dir), ["o_orderkey"], of=("bank",)).select("o_orderkey", "kind", "number", "text")


#: A number that repeats at once stays in its block, where its first answer counts; one more repeat opens a new block.
_PAIRED = _CHAPTER_LINES + """
, n AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag, l_linenumber ORDER BY q, a) AS at_number, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, q, a) AS at_flag FROM d)
SELECT l_orderkey AS o_orderkey, CASE l_returnflag WHEN 'A' THEN 'single_option' WHEN 'N' THEN 'fill_blanks' ELSE 'true_false' END AS kind, l_linenumber::VARCHAR AS number, q AS text,
  first_value(a) OVER (PARTITION BY l_orderkey, l_returnflag, l_linenumber, (at_number - 1) // 2 ORDER BY at_number) AS answer
"""


@query(_PAIRED + "FROM n")
def align_greedy(spark, sf_dir):
    """Questions with the answers of their block, also where a number repeats."""
    return S.question_bank(order_chapters(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", "kind", "number", "text", "answer")


@query(_PAIRED + ", (sum((at_flag = 1 OR (at_number > 1 AND at_number % 2 = 1))::INTEGER) OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, at_flag) - 1)::INTEGER AS block FROM n")
def question_bank(spark, sf_dir):
    """All questions with answers and the number of their block in the chapter."""
    return S.question_bank(order_chapters(spark, sf_dir), ["o_orderkey"]).select("o_orderkey", "block", "kind", "number", "text", "answer")


@query("""
WITH x AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
h AS (SELECT doc_id, n, line, length(line) BETWEEN 1 AND 60 AS head FROM x), s AS (SELECT *, sum(head::INTEGER) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM h)
SELECT doc_id, section::BIGINT AS section, count(*) FILTER (NOT head) AS n_body, min(n)::INTEGER - 1 AS first_line FROM s GROUP BY doc_id, section
""")
def sections_split(spark, sf_dir):
    """Documents cut at their short lines."""
    rows = read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    found = S.sections(rows, ["doc_id"], F.length("line").between(1, 60))
    return found.select("doc_id", "section", (F.col("n_lines") - (F.col("section") > 0).cast("long")).alias("n_body"), "first_line")


@query("""
SELECT l_orderkey AS o_orderkey, 4::INTEGER AS first_bank_line, count(*) AS n_sections FROM (SELECT DISTINCT l_orderkey, l_returnflag FROM lineitem) GROUP BY 1
""")
def bank_split(spark, sf_dir):
    """Where each chapter's bank begins, and its sub-sections there."""
    rows = S.parted(order_chapters(spark, sf_dir), ["o_orderkey"]).where("part = 'bank'")
    return rows.groupBy("o_orderkey").agg(F.min("line_no").alias("first_bank_line"), F.count_if((F.col("kind") != "") & (F.col("exercise") == "")).alias("n_sections"))


@query("""
WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS line_no, event_type = 'purchase' AS key, (event_id % 97)::INTEGER AS num FROM events),
k AS (SELECT user_id, line_no, num, lead(line_no, 4) OVER w AS l4, lead(num, 1) OVER w AS n1, lead(num, 2) OVER w AS n2, lead(num, 3) OVER w AS n3, lead(num, 4) OVER w AS n4 FROM e WHERE key WINDOW w AS (PARTITION BY user_id ORDER BY line_no))
SELECT user_id, min(line_no)::INTEGER AS start FROM k WHERE l4 < line_no + 60 AND num <= n1 AND n1 <= n2 AND n2 <= n3 AND n3 <= n4 GROUP BY 1
""")
def key_run(spark, sf_dir):
    """The first run of key lines in each user's events; purchases are the key lines."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1
    line = F.when(F.col("event_type") == "purchase", F.concat((F.col("event_id") % 97).cast("string"), F.lit(". (a) bought"))).otherwise("a line.")
    rows = read(spark, sf_dir, "events", "user_id", "ts", "event_id", "event_type").select("user_id", place.alias("line_no"), line.alias("line"))
    return S.key_run_start(rows.withColumn("blank", F.lit(False)).withColumn("is_heading", F.lit(False)), ["user_id"])


@query("""
WITH RECURSIVE d AS (SELECT source || '/' || (doc_id // 500) AS chapter, doc_id, n_chars FROM documents),
s AS (SELECT chapter, doc_id, n_chars, row_number() OVER (PARTITION BY chapter ORDER BY doc_id) AS p FROM d),
r(chapter, p, doc_id, batch, used) AS (
  SELECT chapter, p, doc_id, 0::BIGINT, n_chars::BIGINT FROM s WHERE p = 1
  UNION ALL SELECT s.chapter, s.p, s.doc_id, CASE WHEN r.used > 0 AND r.used + s.n_chars > 48000 THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.used > 0 AND r.used + s.n_chars > 48000 THEN s.n_chars ELSE r.used + s.n_chars END
  FROM r JOIN s ON s.chapter = r.chapter AND s.p = r.p + 1
) SELECT chapter, doc_id, batch FROM r
""")
def pack_batches(spark, sf_dir):
    """Sections of chapters in batches of at most 48,000 characters. A chapter is a source's documents of five hundred ids."""
    chapter = F.concat_ws("/", "source", F.floor(F.col("doc_id") / 500).cast("string"))
    rows = read(spark, sf_dir, "documents", "source", "doc_id", "n_chars").select(chapter.alias("chapter"), "doc_id", "n_chars")
    return S.packed(rows, ["chapter"], "doc_id", "n_chars", 48_000)


@query("""
SELECT p_partkey, 'Which brand is ' || p_name AS stem, 4 AS n_options, (p_size % 4)::INTEGER AS correct FROM part
""")
def options_parse(spark, sf_dir):
    text = F.concat(F.lit("Which brand is "), "p_name", F.lit(" (a) "), "p_brand", F.lit(" (b) none (c) all of them (d) "), "p_type")
    key = F.concat(F.lit("Ans: ("), F.substring(F.lit("abcd"), (F.col("p_size") % 4 + 1).cast("int"), F.lit(1)), F.lit(")"))
    return spread(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").select("p_partkey", P.parsed_options(text, key).alias("o")).select("p_partkey", "o.stem", F.size("o.options").alias("n_options"), "o.correct")


@query("SELECT p_partkey, 'Match the parts.' AS stem, p_name AS first, p_type AS last FROM part")
def matching_parse(spark, sf_dir):
    text = F.concat(F.lit("Match the parts.\nColumn I\n(A) "), "p_name", F.lit("\n(B) "), "p_brand", F.lit("\nColumn II\n(p) one\n(q) "), "p_type", F.lit("\n(1) A-p; B-q\n(2) A-q; B-p"))
    m = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type").select("p_partkey", P.matching(text).alias("m"))
    return m.select("p_partkey", "m.stem", F.element_at("m.list_1", 1)["text"].alias("first"), F.element_at("m.list_2", -1)["text"].alias("last"))


@query()
def title_similarity(spark, sf_dir):
    """Likeness by matching blocks, which SQL has no function for."""
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type").select("p_partkey", F.round(P.title_similarity("p_name", "p_type"), 6).alias("similarity"))
