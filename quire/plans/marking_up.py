"""Formulas, tables and chapters as text, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import markup as M
from quire.plans.registry import query, read, spread


@query(r"""
SELECT o_orderkey, '(' || (o_custkey % 100) || ')/(' || (o_orderkey % 9 + 1) || ')x' || translate((o_orderkey % 50)::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') || ' ≤ π' AS plain FROM orders
""")
def formulas(spark, sf_dir):
    text = lambda n: n.cast("string")
    latex = F.concat(F.lit("\\frac{"), text(F.col("o_custkey") % 100), F.lit("}{"), text(F.col("o_orderkey") % 9 + 1), F.lit("}x^{"), text(F.col("o_orderkey") % 50), F.lit("} \\leq \\pi"))
    return read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", M.readable(latex).alias("plain"))


@query("""
SELECT c_custkey, '<table><tr><th>name</th><th>segment</th></tr><tr><td>' || c_name || '</td><td>' || c_mktsegment || '</td></tr><tr><td>' || c_nationkey || '</td><td></td></tr></table>' AS html FROM customer
""")
def pipe_tables(spark, sf_dir):
    lines = F.array(F.lit("| name | segment |"), F.lit("| --- | --- |"), F.concat(F.lit("| "), "c_name", F.lit(" | "), "c_mktsegment", F.lit(" |")), F.concat(F.lit("| "), F.col("c_nationkey").cast("string"), F.lit(" |")))
    return read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey").select("c_custkey", M.table_html(lines).alias("html"))


@query("SELECT event_id, repeat('★', least(5, greatest(0, round_even(value / 20, 0)))::INTEGER) || repeat('☆', 5 - least(5, greatest(0, round_even(value / 20, 0)))::INTEGER) AS stars FROM events")
def ratings(spark, sf_dir):
    return read(spark, sf_dir, "events", "event_id", "value").select("event_id", M.stars(F.col("value") / 20).alias("stars"))


@query("""
SELECT n_nationkey, '<h1>' || n_name || '</h1><h2>Summary</h2>' || r_name || '<h2>Key points</h2>' || string_agg('<li>' || s_name || '</li>', '' ORDER BY s_suppkey) AS html
FROM nation JOIN region ON r_regionkey = n_regionkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey, n_name, r_name
""")
def chapter_documents(spark, sf_dir):
    """Nations as chapters: their region as the summary, their suppliers as key points."""
    points = read(spark, sf_dir, "supplier", "s_suppkey", "s_name", F.col("s_nationkey").alias("n_nationkey")).groupBy("n_nationkey").agg(F.transform(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))), lambda x: x["s_name"]).alias("points"))
    rows = read(spark, sf_dir, "nation", "n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey")).join(read(spark, sf_dir, "region"), "r_regionkey").join(points, "n_nationkey")
    none = lambda kind: F.array().cast(kind)
    return rows.select("n_nationkey", M.chapter_html(F.col("n_name"), F.col("r_name"), F.col("points"), none("array<struct<title:string,body:string>>"), none("array<struct<question:string,answer:string>>")).alias("html"))


@query("""
SELECT c_custkey, '## ' || c_mktsegment || chr(10) || c_name AS theory FROM customer
""")
def theory_texts(spark, sf_dir):
    """Customers as books of one topic each, through the nested schema."""
    from quire.operators.export import BOOK, theory_text
    from pyspark.sql.types import StructType

    rows = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    document = F.to_json(F.struct(F.struct(F.col("c_custkey").cast("string").alias("book_slug")).alias("metadata"), F.array(F.struct(F.lit(1).alias("topic_number"), F.array(F.struct(F.col("c_mktsegment").alias("heading"), F.col("c_name").alias("excerpt"))).alias("theory_sections"))).alias("topics")))
    books = rows.select(F.from_json(document, StructType.fromDDL(BOOK)).alias("b")).select("b.*")
    return theory_text(books).select(F.col("book_slug").cast("long").alias("c_custkey"), "theory")


@query("""
SELECT c_custkey::VARCHAR || '__t1__exercise__0001' AS id, c_name AS question, c_mktsegment AS answer, CASE WHEN c_custkey % 2 = 0 THEN 2 ELSE 1 END AS n_rows FROM customer
""")
def qa_export(spark, sf_dir):
    """Customers as books whose question stands in one array or in two: rows count both, distinct questions one."""
    from quire.operators.export import BOOK, qa_rows
    from pyspark.sql.types import StructType

    rows = read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment")
    item = F.array(F.struct(F.col("c_name").alias("problem"), F.col("c_mktsegment").alias("solution")))
    topic = F.struct(F.lit(1).alias("topic_number"), item.alias("exercises"), F.when(F.col("c_custkey") % 2 == 0, item).alias("examples"))
    document = F.to_json(F.struct(F.struct(F.col("c_custkey").cast("string").alias("book_slug")).alias("metadata"), F.array(topic).alias("topics")))
    made = qa_rows(rows.select(F.from_json(document, StructType.fromDDL(BOOK)).alias("b")).select("b.*"))
    first = F.min_by(F.struct("id", "question", "answer"), F.when(F.col("section_type") == "exercise", 0).otherwise(1)).alias("f")
    return made.groupBy("book_slug").agg(first, F.count("*").cast("int").alias("n_rows")).select("f.*", "n_rows")


@query(r"""
SELECT p_partkey, '## ' || p_name || chr(10) || chr(10) || '⏱ Estimated time: ' || p_size || ' min  ·  📊 Difficulty: 🟡 Medium  ·  ⭐ Exam importance: ' || repeat('★', (1 + p_size % 5)::INTEGER) || repeat('☆', (4 - p_size % 5)::INTEGER) || chr(10) || chr(10)
  || '**Quick Summary**' || chr(10) || p_type || chr(10) || chr(10) || '**Detailed Explanation**' || chr(10) || '- **Definition:** ' || p_brand || chr(10) || chr(10) || '**📌 Points to Remember (Exam Focus)**' || chr(10) || '✓ ' || p_name || chr(10) || '✓ two' || chr(10) || chr(10)
  || '**Formula 1** — 🟢 Easy' || chr(10) || '`' || p_size || 'x`' || chr(10) || '- Variables: x' || chr(10) || chr(10) || '**Derivation: Derivation**' || chr(10) || '- Steps:' || chr(10) || '  1. a' || chr(10) || '  2. ' || p_brand || chr(10) || '- Final result: `' || p_size || '`' AS markdown,
  '<h3>' || p_name || '</h3><div class="rich"><p>' || p_type || ' <strong>b</strong><br>more</p><ul><li>' || p_brand || '</li><li><code>two</code></li></ul><ol><li>' || p_size || '</li></ol><hr><blockquote class="notes-recap">so</blockquote></div><h4>Last</h4>' AS html,
  '## ' || p_name || chr(10) || p_type || chr(10) || 'kept' AS polished FROM part
""")
def study_notes(spark, sf_dir):
    """Parts as sections of a model's reply, rendered as markdown; summaries as HTML and polished."""
    from quire.operators import notes as N

    size = F.col("p_size").cast("string")
    section = F.struct(
        F.concat(F.lit(" "), "p_name").alias("heading"), F.lit("2").alias("level"), F.concat(size, F.lit(" min")).alias("estimated_time"), F.lit(" MODERATE").alias("difficulty"), (1 + F.col("p_size") % 5).cast("string").alias("exam_importance"),
        F.lit("").alias("quick_summary"), F.concat(F.lit("# Heading\n"), "p_type", F.lit(" [image:img_001]")).alias("summary"), F.col("p_brand").alias("definition"), F.array(F.concat(F.lit("- "), "p_name"), F.lit(" "), F.lit("✓ two")).alias("points_to_remember"),
        F.array(F.struct(F.concat(size, F.lit("x")).alias("formula"), F.lit("easy").alias("difficulty"), F.lit("x").alias("variables")), F.struct(F.lit("").alias("formula"), F.lit("").alias("difficulty"), F.lit("y").alias("variables"))).alias("formulas"),
        F.array(F.struct(F.lit("").alias("name"), F.array(F.lit("* a"), F.col("p_brand")).alias("steps"), size.alias("final_result"))).alias("derivations"),
    )
    rows = spread(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size").withColumn("s", section)
    made = rows.withColumn("n", N.normalised(F.col("s"), rows.schema["s"].dataType))
    told = F.concat(F.lit("## "), "p_name", F.lit("\n"), "p_type", F.lit(" **b**\nmore\n\n- "), "p_brand", F.lit("\n* `two`\n1. "), size, F.lit("\n---\n> so\n### Last\n"))
    rough = F.concat(F.lit("no heading\n\n## "), "p_name", F.lit("\n\n\n"), F.lit("## "), "p_name", F.lit("\n"), "p_type", F.lit("\n### within\nkept\n\n## empty"))
    return made.select("p_partkey", N.rendered(F.col("n")).alias("markdown"), N.summary_html(told).alias("html"), N.polished(rough).alias("polished"))
