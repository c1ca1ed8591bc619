"""Documents in the shapes of exports, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import export as E
from quire.operators import shaping as H
from quire.plans.registry import query, read


@query("""
SELECT c_custkey, 'before' || chr(10) || '<table><tr><th>' || c_name || '</th><th>b</th></tr><tr><td>1</td><td>' || c_mktsegment || '</td></tr></table>' || chr(10) || '| alone |' || chr(10) || chr(10)
  || '| --- | --- |' || chr(10) || '<table><tr><th>x</th><th>' || c_nationkey || '</th></tr></table>' AS html FROM customer
""")
def tables_in_texts(spark, sf_dir):
    """Customers' texts with two tables, a line that is none, and a rule that stands alone."""
    text = F.concat(F.lit("before\n| "), "c_name", F.lit(" | b |\n|---|---|\n 1 | "), "c_mktsegment", F.lit("\n| alone |\n\n| --- | --- |\n| x | "), F.col("c_nationkey").cast("string"), F.lit(" |"))
    return read(spark, sf_dir, "customer", "c_custkey", "c_name", "c_mktsegment", "c_nationkey").select("c_custkey", H.tables_as_html(text).alias("html"))


def _topics(spark, sf_dir):
    """Orders as topics, their lines as items of four arrays under different names."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    text = F.col("l_partkey").cast("string")
    odd = F.col("l_partkey") % 2 == 1
    item = F.struct(
        F.when(F.col("l_partkey") % 3 > 0, F.concat(F.lit("i"), text)).alias("id"), F.when(odd, text).alias("problem"), F.when(~odd, F.concat(F.lit("q"), text)).alias("question"),
        F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey").cast("string")).otherwise("").alias("solution_markdown"),
    )
    each = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", item.alias("x"))
    nested = rows.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sort_array(F.collect_list(each)).alias("x"))
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").join(nested.hint("merge"), "o_orderkey")
    of = lambda k: F.transform(F.filter("x", lambda x: x["l_linenumber"] % 4 == k), lambda x: x["x"])
    topic = F.struct(
        F.col("o_orderkey").cast("int").alias("topic_number"), F.concat(F.lit(" "), "o_orderpriority").alias("topic_name"), F.array(F.struct(F.lit(" ").alias("text")), F.struct(F.col("o_orderstatus").alias("text"))).alias("key_points"),
        F.array(F.struct(F.lit("T").alias("title"), F.concat(F.lit("| a | b |\n|---|---|\n| 1 | "), "o_orderstatus", F.lit(" |")).alias("markdown"))).alias("theory_sections"),
        *(of(k).alias(a) for k, a in enumerate(("illustrations", "check_your_knowledge_items", "textbook_exercises", "exercises"))),
    )
    books = E.as_books(orders.select(F.lit(None).cast("struct<name:string>").alias("metadata"), F.array(topic).alias("topics")))
    # an inner explode would have the topics worked out once more, for a filter on the array's size
    return books.select(F.explode_outer("topics").alias("t")).where("t is not null").select("t.*")


@query("""
WITH l AS (SELECT l_orderkey AS o, l_linenumber % 4 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber % 4, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, l_partkey AS p, l_suppkey AS s FROM lineitem)
SELECT o_orderkey::INTEGER AS topic_number, o_orderpriority AS chapter_name, o_orderstatus AS points, 'T:| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | ' || o_orderstatus || ' |' AS theory,
  string_agg(CASE WHEN p % 3 > 0 THEN 'i' || p ELSE n::VARCHAR END || ':' || CASE WHEN p % 2 = 1 THEN '' ELSE 'q' END || p || ':' || CASE WHEN s % 2 = 0 THEN s::VARCHAR ELSE '' END, '|' ORDER BY n) AS rows
FROM orders JOIN l ON o = o_orderkey GROUP BY ALL
""")
def export_payloads(spark, sf_dir):
    """Orders as chapters for export."""
    made = H.export_payload(_topics(spark, sf_dir))
    theory = F.transform("theory", lambda t: F.concat_ws(":", t["title"], t["body"]))
    rows = F.transform("rows", lambda r: F.concat_ws(":", r["id"], r["question"], r["answer"]))
    return made.select("topic_number", "chapter_name", F.array_join("key_points", "|").alias("points"), F.array_join(theory, "|").alias("theory"), F.array_join(rows, "|").alias("rows"))


@query("""
SELECT o_orderkey::INTEGER AS topic_number, o_orderpriority AS chapter_name, '<table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>' || o_orderstatus || '</td></tr></table>' AS markdown, 6::INTEGER AS n_fields FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey
""")
def slim_topics(spark, sf_dir):
    """Orders as topics of a table of questions, their tables as HTML."""
    made = H.slim(_topics(spark, sf_dir))
    return made.select("topic_number", "chapter_name", F.element_at("theory_sections", 1)["markdown"].alias("markdown"), F.lit(len(made.columns)).alias("n_fields"))


@query("""
SELECT l_orderkey::INTEGER AS topic_number, string_agg(CASE WHEN l_partkey % 2 = 1 THEN '' ELSE 'q' END || l_partkey || '=' || CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey::VARCHAR ELSE '' END, '|' ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS items
FROM lineitem WHERE l_linenumber % 4 = 3 GROUP BY 1
""")
def renamed_items(spark, sf_dir):
    """The questions and answers of orders' exercises, under these names alone."""
    made = H.with_questions_and_answers(_topics(spark, sf_dir)).select("topic_number", F.explode(F.array("exercises")).alias("x")).where(F.size("x") > 0)
    return made.select("topic_number", F.array_join(F.transform("x", lambda x: F.concat_ws("=", x["question"], x["answer"])), "|").alias("items"))


@query("""
WITH a AS (SELECT page_id // 10 AS topic, 'img_' || lpad((page_id % 10)::VARCHAR, 3, '0') AS id, url, page_id % 10 AS k FROM pages)
SELECT topic, string_agg(id || CASE WHEN place <= 4 THEN '+' ELSE '' END, ' ' ORDER BY place) AS assets
FROM (SELECT topic, id, row_number() OVER (PARTITION BY topic ORDER BY k NOT IN (6, 7), id) AS place FROM a WHERE k % 4 > 0) GROUP BY topic
""")
def used_figures(spark, sf_dir):
    """Ten pages as a topic's figures: those referred to, the map's first, the first four with their bytes."""
    k = F.col("page_id") % 10
    name = F.format_string("img_%03d", k.cast("int"))
    rows = read(spark, sf_dir, "pages", "page_id", "url").select(F.floor(F.col("page_id") / 10).alias("topic"), name.alias("id"), F.struct(F.col("url").alias("source_url"), F.lit("AA").alias("base64")).alias("asset"), (k % 4 > 0).alias("used"), k.isin(6, 7).alias("map"))
    topics = rows.groupBy("topic").agg(
        F.map_from_entries(F.collect_list(F.struct("id", "asset"))).alias("assets"), F.collect_list(F.when(F.col("used"), F.col("id"))).alias("used"), F.collect_list(F.when(F.col("map"), F.col("id"))).alias("map")
    )
    made = H.used_assets(F.col("assets"), F.concat("used", F.array(F.lit("img_999"))), F.col("map"), 4)
    shown = F.transform(made, lambda x: F.concat(x["id"], F.when(x["asset"]["base64"].isNull(), "").otherwise("+")))
    return topics.select("topic", F.array_join(shown, " ").alias("assets")).where("assets <> ''")
