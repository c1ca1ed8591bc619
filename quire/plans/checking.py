"""Quality checks on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as T
from quire.operators import checks as C
from quire.operators import reports as R
from quire.plans.registry import query, read

_DOCS = "documents", "doc_id", "source", "text"
_KEY = r"CASE WHEN length(left(trim(regexp_replace(text, '\s+', ' ', 'g')), 120)) >= 60 THEN left(trim(regexp_replace(text, '\s+', ' ', 'g')), 120) END"


@query("""
WITH n AS (SELECT o_custkey % 100 AS book, o_custkey AS chapter, count(*) AS n FROM orders GROUP BY ALL),
m AS (SELECT book, list_sort(list(n))[count(*) // 2 + 1] AS median, count(*) AS chapters FROM n GROUP BY 1)
SELECT book, chapter, n, median FROM n JOIN m USING (book) WHERE chapters >= 3 AND median >= 3 AND n > 1.5 * median
""")
def chapter_size_outliers(spark, sf_dir):
    rows = read(spark, sf_dir, "orders", (F.col("o_custkey") % 100).alias("book"), F.col("o_custkey").alias("chapter"))
    return C.size_outliers(rows, "book", "chapter", ratio=1.5, least=3)


@query(f"""
WITH k AS (SELECT doc_id, source, {_KEY} AS key FROM documents), f AS (SELECT key, arg_min(source, doc_id) AS first_chapter FROM k WHERE key IS NOT NULL GROUP BY 1)
SELECT 'corpus' AS book, k.doc_id, k.source, f.first_chapter FROM k JOIN f USING (key) WHERE k.source <> f.first_chapter
""")
def cross_chapter_duplicates(spark, sf_dir):
    rows = read(spark, sf_dir, *_DOCS).withColumn("book", F.lit("corpus"))
    return C.cross_chapter_copies(rows, "book", "source", "text", "doc_id").select("book", "doc_id", "source", "first_chapter")


@query("""
WITH r AS (SELECT 'corpus' AS book, source AS chapter, count(*) AS n, avg((doc_id % 10 < CASE WHEN source IN ('src1', 'src2') THEN 0 ELSE 4 END)::INTEGER) AS rate FROM documents GROUP BY ALL HAVING count(*) >= 40),
b AS (SELECT book, max(rate) AS best FROM r GROUP BY 1)
SELECT book, chapter, n, rate FROM r JOIN b USING (book) WHERE best >= 0.2 AND rate < 0.05
""")
def answer_key_lost(spark, sf_dir):
    rows = read(spark, sf_dir, "documents", "doc_id", F.lit("corpus").alias("book"), F.col("source").alias("chapter"))
    return C.lost_keys(rows, "book", "chapter", F.col("doc_id") % 10 < F.when(F.col("chapter").isin("src1", "src2"), 0).otherwise(4))


@query("SELECT doc_id, source, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS size FROM documents WHERE size > 6000")
def runaway(spark, sf_dir):
    """All that can't be one question."""
    return C.runaways(read(spark, sf_dir, *_DOCS), "text").select("doc_id", "source", "size")


@query(r"""
WITH t AS (SELECT text AS x FROM documents UNION ALL SELECT html FROM pages)
SELECT pattern, count(*) FILTER (regexp_matches(x, p)) AS n FROM t CROSS JOIN (VALUES
  ('exam tag', '\[\s*(?:NTSE|JSTSE|KVPY|NSO|IJSO|NSEJS|NSTSE)\b'), ('check-your-knowledge banner', '(?:Time\s+to\s+)?Check\s+Your\s+Knowledge'), ('table separator row', ':?-{3,}\s*\|'),
  ('DIRECTIONS preamble', '\n\s*DIRECTIONS\s*[:(]'), ('LaTeX section heading', '\\section\*'), ('un-embedded figure URL', '!\[\]\(https?://cdn\.mathpix'), ('fullwidth punctuation', '[！-～]')) v(pattern, p) GROUP BY 1
""")
def furniture_hits(spark, sf_dir):
    rows = read(spark, sf_dir, "documents", F.col("text").alias("x")).unionByName(read(spark, sf_dir, "pages", F.col("html").alias("x")))
    return C.furniture(rows, "x")


@query(f"SELECT doc_id, source FROM documents WHERE {_KEY} IN (SELECT {_KEY} FROM documents WHERE source = 'src0' AND {_KEY} IS NOT NULL) AND source <> 'src0'")
def answer_is_question(spark, sf_dir):
    docs = read(spark, sf_dir, *_DOCS)
    return C.answers_that_are_questions(docs.where("source <> 'src0'"), docs.where("source = 'src0'"), "text", "text").select("doc_id", "source")


@query("""
SELECT o_orderkey, chr((97 + o_orderkey % 6)::INTEGER) AS answer FROM orders WHERE o_orderkey % 6 >= 4
""")
def key_outside_options(spark, sf_dir):
    key = F.substring(F.lit("abcdef"), (F.col("o_orderkey") % 6 + 1).cast("int"), F.lit(1))
    options = F.create_map(*(F.lit(x) for k in "ABCD" for x in (k, "text")))
    rows = read(spark, sf_dir, "orders", "o_orderkey").select("o_orderkey", key.alias("answer"), options.alias("options"))
    return C.keys_outside_options(rows, "answer", "options").drop("options")


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS link FROM pages)
SELECT page_id, link, count(*) AS n FROM l WHERE link NOT IN (SELECT url FROM pages WHERE url IS NOT NULL) GROUP BY ALL
""")
def unresolved_refs(spark, sf_dir):
    """Links of pages that lead to no page of the table."""
    pages = read(spark, sf_dir, "pages", "page_id", "url", "html")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("link"))
    return links.groupBy("page_id", "link").agg(F.count("*").alias("n")).join(pages.select(F.col("url").alias("link")), "link", "left_anti").select("page_id", "link", "n")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def empty_chapters(spark, sf_dir):
    done = read(spark, sf_dir, "orders", F.col("o_custkey").alias("c_custkey"), "o_orderstatus").where("o_orderstatus = 'F'")
    return R.without_questions(read(spark, sf_dir, "customer", "c_custkey", "c_name"), done, ["c_custkey"])


_FINDINGS = f"""
WITH k AS (SELECT doc_id, source, length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS size, {_KEY} AS key FROM documents),
f AS (SELECT key, arg_min(source, doc_id) AS first_chapter FROM k WHERE key IS NOT NULL GROUP BY 1),
z AS (
  SELECT source AS book_slug, 'runaway questions' AS c, 'fail' AS severity, count(*) AS n FROM k WHERE size > 6000 GROUP BY 1
  UNION ALL SELECT k.source, 'copies of another chapter', 'warn', count(*) FROM k JOIN f USING (key) WHERE k.source <> f.first_chapter GROUP BY 1
)
"""


def _findings(spark, sf_dir):
    return C.chapter_findings(read(spark, sf_dir, *_DOCS), "source", "text", "doc_id")


@query(_FINDINGS + 'SELECT book_slug, c AS "check", severity, n FROM z')
def quality_findings(spark, sf_dir):
    return _findings(spark, sf_dir)


@query(_FINDINGS + "SELECT book_slug, string_agg('[' || upper(severity) || '] ' || c || ': ' || n, chr(10) ORDER BY severity, c) AS report, bool_or(severity = 'fail') AS failed FROM z GROUP BY 1")
def quality_report(spark, sf_dir):
    return C.report(_findings(spark, sf_dir))
