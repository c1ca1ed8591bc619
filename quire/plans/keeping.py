"""Which chapters' files are stale, what is to be written, and texts made ready for export, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import markup as M
from quire.plans.registry import query, read, spread
from quire.sources import chapter_files as C


@query("""
SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 100 || '-' || (o_orderkey % 100 + 9) END AS recorded,
  CASE WHEN o_orderkey % 7 > 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 100 + 1 ELSE o_orderkey % 100 END || '-' || (o_orderkey % 100 + 9) END AS lines,
  CASE WHEN o_orderkey % 5 = 0 THEN 'missing' WHEN o_orderkey % 7 = 0 THEN 'left over' ELSE 'moved' END AS state
FROM orders WHERE (o_orderkey % 5 = 0) <> (o_orderkey % 7 = 0) OR (o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 AND o_orderkey % 3 = 0)
""")
def stale_topics(spark, sf_dir):
    """Customers as books, orders as chapters: those whose files were cut from other lines than now, aren't there, or are left over."""
    k = F.col("o_orderkey")
    span = lambda a, b: F.concat_ws("-", a.cast("string"), b.cast("string")).alias("lines")
    orders = read(spark, sf_dir, "orders", "o_custkey", "o_orderkey")
    recorded = orders.where(k % 5 > 0).select("o_custkey", "o_orderkey", span(k % 100, k % 100 + 9))
    now = orders.where(k % 7 > 0).select("o_custkey", "o_orderkey", span(k % 100 + F.when(k % 3 == 0, 1).otherwise(0), k % 100 + 9))
    return C.stale(recorded, now, ["o_custkey", "o_orderkey"])


@query("""
WITH n AS (SELECT p_brand AS book_slug, p_partkey::INTEGER AS topic_number, p_partkey % 6 AS k, p_name FROM part)
SELECT book_slug, topic_number, CASE k WHEN 0 THEN 'write' WHEN 1 THEN 'split again' WHEN 2 THEN 'keep' WHEN 3 THEN 'restore' WHEN 4 THEN 'keep' ELSE 'restore' END AS action,
  CASE WHEN k IN (2, 4) THEN 'old ![](x) ' ELSE 'new ![](x) ' END || p_name AS body FROM n
""")
def chapter_actions(spark, sf_dir):
    """Brands as books, parts as chapters: which files are written, cut anew, kept, or given their pictures back."""
    k = F.col("p_partkey") % 6
    rows = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand")
    new = C.chapter_files(rows.select(F.col("p_brand").alias("book_slug"), F.col("p_partkey").alias("topic_number"), F.lit("t").alias("topic_name"), F.lit("").alias("page_range"), F.lit("b.md").alias("source_markdown"), F.lit(9).alias("start"), F.lit(19).alias("end"), F.concat(F.lit("new ![](x) "), "p_name").alias("markdown")))
    body = F.when(k.isin(1, 2, 4), F.concat(F.lit("old ![](x) "), "p_name")).otherwise(F.concat(F.lit("old "), "p_name"))
    lines = F.when(k == 1, "10-21").when(k == 4, "").when(k == 5, None).otherwise("10-20")
    cached = rows.where(k > 0).select(F.col("p_brand").alias("book_slug"), F.col("p_partkey").cast("int").alias("topic_number"), F.lit("combined").alias("md_kind"), lines.alias("lines"), body.alias("body"))
    return C.decided(new, cached).select("book_slug", "topic_number", "action", "body")


@query(r"""
WITH e AS (SELECT doc_id, text, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS t FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(t, '`([^`]+)`', '<code>\1</code>', 'g'), '\*\*([^*]+)\*\*', '<strong>\1</strong>', 'g')) AS inline_md5,
  len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]')))::INTEGER AS n_points FROM e
""")
def inline_exports(spark, sf_dir):
    """Documents as pages, with what stands between stars and backquotes marked."""
    return read(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(M.inline_markup(F.col("text"))).alias("inline_md5"), F.size(M.listed_points(F.col("text"))).alias("n_points"))


@query("""
SELECT p_partkey, p_name || '|inline:' || p_size || '|' || p_type || '|block:a' || chr(10) || p_brand || '|.|$open' AS parts, 'x & y \\begin{align} a ' || p_size || '   b \\& c &amp; d \\end{align} &' AS aligned,
  '<p><span class="math-fallback"><i>' || p_size || ' &lt; 3</i></span> and <span class="math-fallback"><i>[math]</i></span></p>' AS page, CASE p_partkey % 3 WHEN 0 THEN 'mcq' WHEN 1 THEN 'textbook' ELSE 'other' END AS kind,
  'text of ' || p_name AS body, 'Which part is ' || p_name || '?' AS question, least(200, greatest(1, CASE WHEN p_partkey % 4 = 0 THEN 40 ELSE p_partkey - 50 END)) AS page_size FROM part
""")
def exported_texts(spark, sf_dir):
    """Parts' texts with formulas of both kinds, an open one, aligned ones, MathML, a repeated heading and repeated options."""
    size = F.col("p_size").cast("string")
    text = F.concat("p_name", F.lit("$"), size, F.lit("$"), "p_type", F.lit("$$a\n"), "p_brand", F.lit("$$.$open"))
    parts = F.array_join(F.transform(M.formula_parts(text), lambda x: F.when(x["kind"] == "text", x["body"]).otherwise(F.concat_ws(":", x["kind"], x["body"]))), "|")
    aligned = M.without_alignment(F.concat(F.lit("x & y \\begin{align} a "), size, F.lit(" & b \\& c &amp; d \\end{align} &")))
    page = M.plain_math(F.concat(F.lit("<p><script>x</script><math><mn>"), size, F.lit("</mn><mo>&lt;</mo><mn>3</mn></math> and <MATH > </MATH></p>")))
    k = F.col("p_partkey")
    kind = M.exercise_kind(F.when(k % 3 == 0, "Multiple Choice").when(k % 3 == 1, "Exercise 1").otherwise("Other"), F.when(k % 3 == 1, "Text-Book"))
    body = M.without_repeated_heading(F.concat(F.lit("\n## "), F.upper("p_name"), F.lit("\n\n### "), "p_name", F.lit(" and more\ntext of "), "p_name"), F.col("p_name"))
    question = M.without_options(F.concat(F.lit("Which part is "), "p_name", F.lit("?\n\n (a) one\n(b) two")), F.lit(True))
    asked = F.when(k % 4 == 0, "many").otherwise((k - 50).cast("string"))
    rows = spread(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    return rows.select("p_partkey", parts.alias("parts"), aligned.alias("aligned"), page.alias("page"), kind.alias("kind"), body.alias("body"), question.alias("question"), M.bounded_int(asked, 40, 1, 200).alias("page_size"))
