"""Topics' layout on the driver's tables: titles, theory, case studies, labelled arrays, exercises as examples."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import pedagogy as P
from quire.operators import segment as S
from quire.plans.registry import query, read

_TITLES = ["Very Short Answer Questions", "Solutions", "Exercise 4", "Case study 2", "Learn More", "Physics", "Moving"]
_TITLE_SQL = "['" + "', '".join(_TITLES) + "'][(p_partkey % 7 + 1)::INTEGER]"


@query(f"""
SELECT p_partkey, {_TITLE_SQL} || ' ' || p_name AS title, p_partkey % 7 = 0 AS bank, p_partkey % 7 <= 3 AS apart, p_partkey % 7 = 4 AS side FROM part
""")
def title_kinds(spark, sf_dir):
    title = F.concat_ws(" ", F.element_at(F.array(*map(F.lit, _TITLES)), (F.col("p_partkey") % 7 + 1).cast("int")), "p_name")
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", title.alias("title"))
    return rows.select("p_partkey", "title", P.is_bank_title(F.col("title")).alias("bank"), P.is_non_theory_title(F.col("title")).alias("apart"), P.is_side_title(F.col("title")).alias("side"))


@query("""
SELECT p_partkey, 1 AS "order", p_name AS topics, '## ' || p_name || chr(10) || chr(10) || p_brand || chr(10) || 'after' AS markdown FROM part
UNION ALL SELECT p_partkey, 2, 'Last', '## Last' || chr(10) || chr(10) || p_type FROM part
""")
def theory_only(spark, sf_dir):
    """Parts as chapters: a section with a check of knowledge within, one of exercises, and a last one."""
    text = F.concat(F.lit("## "), "p_name", F.lit("\n"), "p_brand", F.lit("\nTime to Check Your Knowledge\nWhy?\nSOLUTION :\nafter\n\n## Exercise 3\n1. Find it.\n## Last\n"), "p_type")
    rows = S.lines(read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type").select("p_partkey", text.alias("markdown")), ["p_partkey"])
    return P.theory_sections(rows, ["p_partkey"])


@query("""
SELECT p_partkey, 'case_study_1' AS id, 'CASE STUDY ' || p_size AS title, p_brand || chr(10) || p_type AS first, 2::INTEGER AS n FROM part
UNION ALL SELECT p_partkey, 'case_study_2', 'Case Study: ' || p_name, NULL, 0 FROM part
""")
def case_study_prompts(spark, sf_dir):
    text = F.concat(F.lit("Opening\n## CASE STUDY "), F.col("p_size").cast("string"), F.lit("\nA story.\nQ. 1: "), "p_brand", F.lit("\n![](x)\n"), "p_type", F.lit("\nCASE - II and then?\n## Case Study: "), "p_name", F.lit("\nNo prompts."))
    rows = S.lines(read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").select("p_partkey", text.alias("markdown")), ["p_partkey"])
    return P.case_studies(rows, ["p_partkey"]).select("p_partkey", "id", "title", F.get("questions", F.lit(0)).alias("first"), F.size("questions").alias("n"))


_STATUS = "CASE l_returnflag WHEN 'A' THEN 'illustration' WHEN 'N' THEN 'textbook_exercise' ELSE 'other' END"


@query(f"""
WITH e AS (SELECT l_orderkey, l_linenumber, {_STATUS} AS kind FROM lineitem)
SELECT l_orderkey, 'Order ' || l_orderkey AS chapter_name, count(*) FILTER (kind = 'illustration') AS illustrations, count(*) FILTER (kind = 'textbook_exercise') AS textbook_exercises, count(*) FILTER (kind = 'other') AS exercises,
  coalesce(sum(l_linenumber) FILTER (kind = 'other'), 0)::BIGINT AS lines FROM e GROUP BY l_orderkey
""")
def labelled_arrays(spark, sf_dir):
    """Orders as topics, their lines as examples, labelled by their flag."""
    kind = F.when(F.col("l_returnflag") == "A", "illustration").when(F.col("l_returnflag") == "N", "textbook_exercise").otherwise("other")
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag").select("l_orderkey", F.struct("l_linenumber", kind.alias("source_type")).alias("e"))
    topics = lines.groupBy("l_orderkey").agg(F.collect_list("e").alias("examples")).withColumn("topic_name", F.concat(F.lit("Order "), F.col("l_orderkey").cast("string"), F.lit(" ")))
    total = F.aggregate("exercises", F.lit(0).cast("long"), lambda a, e: a + e["l_linenumber"])
    sizes = [F.size(c).cast("long").alias(c) for c in ("illustrations", "textbook_exercises", "exercises")]
    return P.labelled(topics).select("l_orderkey", "chapter_name", *sizes, total.alias("lines"))


@query("""
WITH q AS (SELECT p_brand, p_partkey, p_name, p_size, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
SELECT p_brand || '_t01_q_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id,
  CASE WHEN p_partkey % 2 = 0 THEN 'Exercise 1 — Text-Book Questions — Q' ELSE 'Exercise 1: Short Answer — Q' END || p_size AS title,
  CASE WHEN p_partkey % 2 = 0 THEN 'textbook_exercise' ELSE 'exercise' END AS source_type, p_name AS problem, 500 + p_size AS source_order FROM q
""")
def exercise_examples(spark, sf_dir):
    """Parts as questions of their brand's exercises."""
    even = F.col("p_partkey") % 2 == 0
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size").select(
        F.col("p_brand").alias("book_slug"), F.lit(1).alias("topic_number"), "p_partkey", F.when(even, "Exercise 1").otherwise("Exercise 1: Short Answer").alias("title"),
        F.when(even, "Text-Book Questions").otherwise("Short Answer").alias("subsection_title"), F.lit("textbook").alias("subsection"), F.col("p_size").alias("number"),
        F.col("p_name").alias("prompt"), F.lit(None).cast("string").alias("solution"), F.lit("").alias("passage"), F.col("p_size").alias("source_line"),
    )
    return P.bank_examples(rows, ["book_slug", "topic_number"], ["p_partkey"], 500).select("id", "title", "source_type", "problem", "source_order")
