"""Illustrations, checks of knowledge, chapters' slices, questions, theory and figures of whole books, on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import chapters as C
from quire.operators import export as E
from quire.operators import segment as S
from quire.plans.registry import query, read, spread


@query("""
SELECT p_partkey, 'illustration_' || p_size || '_a' AS id, 'Illustration ' || p_size || '-A' AS title, p_name || ' stands here' || chr(10) || '![](http://x/' || p_partkey || '.png)' AS problem, 'It is ' || p_type || chr(10) || 'at last' AS solution, 1::INTEGER AS n_images, 1::INTEGER AS source_order FROM part
UNION ALL SELECT p_partkey, 'illustration_2', 'ILLUSTRATIOM : 2', 'no solution', '', 0, 6 FROM part
""")
def illustrations(spark, sf_dir):
    """Parts as chapters with two illustrations, one solved, one misread and unsolved, and a heading that ends it."""
    size = F.col("p_size").cast("string")
    text = F.concat(F.lit("## Theory\n## Illustration "), size, F.lit("-A\n"), "p_name", F.lit(" stands here\n![](http://x/"), F.col("p_partkey").cast("string"), F.lit(".png)\nSOLUTION: It is "), "p_type", F.lit("\nat last\n"))
    text = F.concat(F.regexp_replace(text, "\nat last\n$", "\nat last"), F.lit("\nILLUSTRATIOM : 2\nno solution\n## Next\nafter"))
    lines = S.lines(read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_size").select("p_partkey", text.alias("markdown")), ["p_partkey"])
    return S.illustrations(lines, ["p_partkey"]).select("p_partkey", "id", "title", "problem", "solution", F.size("image_urls").alias("n_images"), "source_order")


@query("""
SELECT p_partkey, unnest([1, 2])::INTEGER AS place, unnest(['Time to Check Your Knowledge' || chr(10) || p_name, 'Check your knowledge' || chr(10) || p_brand]) AS problem, unnest([p_type || chr(10) || 'so', 'two']) AS solution FROM part
""")
def knowledge_checks(spark, sf_dir):
    """Parts as chapters with two checks that are answered and one that isn't."""
    text = F.concat(F.lit("Time to Check Your Knowledge\n"), "p_name", F.lit("\nSOLUTION:\n"), "p_type", F.lit("\nso\n## Heading\nCheck your knowledge\n"), "p_brand", F.lit("\nSOL.\ntwo\n## Exercise 3\nCheck your knowledge\nnever\n## End\nSOLUTION:\nof another"))
    lines = S.lines(read(spark, sf_dir, "part", "p_partkey", "p_name", "p_type", "p_brand").select("p_partkey", text.alias("markdown")), ["p_partkey"])
    return S.knowledge_checks(lines, ["p_partkey"]).drop("source_order")


@query("""
WITH n AS (SELECT c_custkey, c_name FROM customer)
SELECT c_custkey, unnest([1, 2])::INTEGER AS topic_number, unnest([4, 7])::INTEGER AS start, unnest([6, 9])::INTEGER AS "end", unnest([3, 3])::INTEGER AS n_lines FROM n
""")
def chapter_slices(spark, sf_dir):
    """Customers as books of two chapters: where each begins, in spite of a heading that only looks like it, and where it ends."""
    text = F.concat(F.lit("## Contents\n1. Sound Waves ..... 1-9\n2. Heat Engines ..... 10-19\n## Preface\n## 1. Sound Waves\n"), "c_name", F.lit("\n## Did you know Heat Engines\n## 2. Heat Engines\nend of "), "c_name", F.lit("\nlast"))
    books = spread(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", text.alias("markdown"))
    lines = S.lines(books, ["c_custkey"])
    topics = books.select("c_custkey", F.explode(F.array(F.struct(F.lit(1).alias("topic_number"), F.lit("Sound Waves").alias("topic_name")), F.struct(F.lit(2).alias("topic_number"), F.lit("Heat Engines").alias("topic_name")))).alias("t")).select("c_custkey", "t.*")
    cut = C.slices(lines, topics, C.starts(lines, topics, ["c_custkey"]), ["c_custkey"])
    texts = C.chapter_texts(lines, cut, ["c_custkey"]).select("c_custkey", "topic_number", F.size(T.lines(F.col("markdown"))).alias("n_lines"))
    return cut.join(texts.hint("merge"), ["c_custkey", "topic_number"]).select("c_custkey", "topic_number", "start", "end", "n_lines")


def _books(spark, sf_dir):
    """Orders as books of one topic, their lines as exercises, every other one again among the illustrations."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    part = F.col("l_partkey").cast("string")
    item = F.struct(
        F.concat(F.lit("q"), part).alias("id"), F.concat(F.lit("[image:i"), (F.col("l_partkey") % 3).cast("string"), F.lit("] What is "), part, F.lit("?")).alias("question"), F.col("l_suppkey").cast("string").alias("answer"),
        (F.col("l_partkey") % 50).cast("int").alias("source_order"),
    )
    each = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", item.alias("x"))))
    nested = rows.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(each.alias("x"))
    orders = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").join(nested.hint("merge"), "o_orderkey")
    every = F.transform("x", lambda x: x["x"])
    twice = F.transform(F.filter("x", lambda x: x["l_partkey"] % 2 == 0), lambda x: x["x"])
    section = F.struct(F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("body"))
    empty = F.struct(F.lit("").alias("title"), F.lit(" ").alias("body"))
    assets = F.create_map(F.lit("i1"), F.struct(F.lit("1.png").alias("file")), F.lit("i2"), F.struct(F.lit("2.png").alias("file")))
    topic = F.struct(F.lit(1).alias("topic_number"), F.lit("T").alias("chapter_name"), F.array(section, empty).alias("theory_sections"), every.alias("exercises"), twice.alias("illustrations"))
    books = E.as_books(orders.select(F.struct(F.concat(F.lit("b"), F.col("o_orderkey").cast("string")).alias("book_slug")).alias("metadata"), F.array(topic).alias("topics")))
    kind = books.schema["topics"].dataType.elementType["image_assets"].dataType
    filled = F.transform_values(assets, lambda _, a: F.struct(*(a["file"].alias("file") if f.name == "file" else F.lit(None).cast(f.dataType).alias(f.name) for f in kind.valueType)))
    return books.withColumn("topics", F.transform("topics", lambda t: t.withField("image_assets", filled)))


@query("""
WITH l AS (SELECT 'b' || l_orderkey AS book_slug, l_partkey AS p, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
a AS (SELECT *, CASE WHEN p % 2 = 0 THEN 0 ELSE 1 END AS bucket FROM l), d AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY book_slug, p ORDER BY bucket, n) = 1),
i AS (SELECT book_slug, p, s, bucket, CASE WHEN bucket = 0 THEN row_number() OVER (PARTITION BY book_slug, bucket ORDER BY n) ELSE n END AS n FROM d)
SELECT book_slug, row_number() OVER (PARTITION BY book_slug ORDER BY p % 50, bucket, n)::VARCHAR AS question_number, '[image:i' || p % 3 || '] What is ' || p || '?' AS question, s::VARCHAR AS answer FROM i
""")
def structured_questions(spark, sf_dir):
    """Distinct questions of books, ordered by their lines and numbered anew."""
    return E.questions(_books(spark, sf_dir)).select("book_slug", "question_number", "question", "answer")


@query("""
SELECT 'b' || o_orderkey AS book_slug, 1::INTEGER AS section_order, o_orderpriority AS title, o_orderstatus AS markdown, 'theory' AS section_kind FROM orders SEMI JOIN lineitem ON l_orderkey = o_orderkey
""")
def structured_theory(spark, sf_dir):
    """Theory sections of books; one that holds nothing is left out."""
    return E.theory(_books(spark, sf_dir)).select("book_slug", "section_order", "title", "markdown", "section_kind")


@query("""
WITH l AS (SELECT 'b' || l_orderkey AS book_slug, l_partkey AS p, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n FROM lineitem),
a AS (SELECT book_slug, 'exercises' AS section_key, n, p FROM l UNION ALL SELECT book_slug, 'illustrations', row_number() OVER (PARTITION BY book_slug ORDER BY n), p FROM l WHERE p % 2 = 0)
SELECT book_slug, section_key, n::INTEGER AS item_order, 'i' || p % 3 AS id, CASE p % 3 WHEN 0 THEN '' ELSE p % 3 || '.png' END AS file FROM a
""")
def resolved_figures(spark, sf_dir):
    """The figures that books' items refer to, with their files where the topic has them."""
    return E.resolved_images(_books(spark, sf_dir)).select("book_slug", "section_key", "item_order", "id", "file")


@query("""
WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS n, '![](http://x/' || l_partkey % 5 || ') ' || l_partkey AS line, l_partkey % 5 AS url FROM lineitem),
u AS (SELECT l_orderkey, 'http://x/' || url AS url, min(n) AS n FROM l WHERE n BETWEEN 1 AND 4 GROUP BY ALL)
SELECT l_orderkey, 7::INTEGER AS topic_number, string_agg(line, chr(10) ORDER BY n) AS markdown, (SELECT string_agg(url, ' ' ORDER BY n) FROM u WHERE u.l_orderkey = l.l_orderkey) AS urls FROM l WHERE n BETWEEN 1 AND 4 GROUP BY l_orderkey
""")
def recorded_slices(spark, sf_dir):
    """Orders as books, of which a recorded span is read again with a line before it, and its pictures' addresses."""
    rows = read(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    each = F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")))
    lines = rows.groupBy("l_orderkey").agg(each.alias("x")).select("l_orderkey", F.posexplode("x").alias("line_no", "x"))
    part = F.col("x.l_partkey")
    lines = lines.select("l_orderkey", "line_no", F.concat(F.lit("![](http://x/"), (part % 5).cast("string"), F.lit(") "), part.cast("string")).alias("line"))
    spans = read(spark, sf_dir, "lineitem", "l_orderkey").distinct().select("l_orderkey", F.explode(F.array(F.struct(F.lit(7).alias("topic_number"), F.lit("2-9").alias("lines")), F.struct(F.lit(8).alias("topic_number"), F.lit("unknown").alias("lines")))).alias("s")).select("l_orderkey", "s.*")
    made = C.slices_of(lines, spans, ["l_orderkey"], before=1, most=3)
    return made.withColumn("urls", F.array_join("urls", " "))
