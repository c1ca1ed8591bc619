"""Figures, caches, cleaned texts and matching questions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import export as E
from quire.operators import figures as G
from quire.operators import parse as P
from quire.plans.registry import query, read

_PICTURE = "'http://pics.example.org/' || (page_id % 7) || '.png'"
_USES = f"""
WITH p AS (SELECT page_id // 50 AS topic, page_id, url, {_PICTURE} AS pic FROM pages), u AS (SELECT topic, page_id * 2 AS place, url FROM p UNION ALL SELECT topic, page_id * 2 + 1, pic FROM p),
f AS (SELECT topic, url, min(place) AS place FROM u GROUP BY ALL), n AS (SELECT topic, url, row_number() OVER (PARTITION BY topic ORDER BY place) AS n FROM f),
i AS (SELECT topic, url, 'img_' || CASE WHEN n < 1000 THEN lpad(n::VARCHAR, 3, '0') ELSE n::VARCHAR END AS id FROM n)
"""


def _illustrated(spark, sf_dir):
    """Pages as texts with two figures, their own and one that others share; fifty pages make a topic."""
    text = F.concat(F.lit("See ![page]("), "url", F.lit(") and ![](http://pics.example.org/"), (F.col("page_id") % 7).cast("string"), F.lit(".png)."))
    return read(spark, sf_dir, "pages", "page_id", "url").select(F.floor(F.col("page_id") / 50).alias("topic"), "page_id", text.alias("text"))


@query(_USES + "SELECT topic, url, id, id || CASE WHEN contains(lower(url), '.png') THEN '.png' ELSE '.jpg' END AS file FROM i")
def figure_numbers(spark, sf_dir):
    return G.numbered(_illustrated(spark, sf_dir), ["topic"], ["page_id"], "text")


@query(_USES + "SELECT p.page_id, 'See [image:' || a.id || '] and [image:' || b.id || '].' AS text FROM p JOIN i a ON a.topic = p.topic AND a.url = p.url JOIN i b ON b.topic = p.topic AND b.url = p.pic")
def figure_tokens(spark, sf_dir):
    return G.wired(_illustrated(spark, sf_dir), ["topic"], ["page_id"], "text").select("page_id", "text")


@query("""
SELECT page_id, '<img class="topic-image" alt="img_001" src="' || CASE WHEN page_id % 2 = 0 THEN 'data:image/png;base64,' || to_base64(encode(url)) ELSE replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') END || '"/> [image:img_002]' AS html FROM pages
""")
def figure_pictures(spark, sf_dir):
    """A token of an asset with bytes or with an address, and a token of none."""
    asset = F.struct(F.when(F.col("page_id") % 2 == 0, F.base64(F.encode("url", "UTF-8"))).alias("base64"), F.lit("image/png").alias("mime_type"), F.col("url").alias("source_url"))
    assets = F.create_map(F.lit("img_001"), asset)
    return read(spark, sf_dir, "pages", "page_id", "url").select("page_id", G.shown(F.lit("[image:img_001] [image:img_002]"), assets).alias("html"))


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_comment_, l_shipmode_ FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS l_comment_, l_linestatus AS l_shipmode_ FROM lineitem GROUP BY ALL)),
s AS (SELECT l_orderkey, l_linenumber AS pos, l_comment_ || l_shipmode_ AS heading, 'own' AS markdown FROM (SELECT l_orderkey, l_linenumber, min(l_comment_) AS l_comment_, min(l_shipmode_) AS l_shipmode_ FROM l GROUP BY ALL)),
f AS (SELECT l_orderkey, pos - 1 AS pos, heading, 'text ' || pos AS markdown FROM s WHERE pos % 3 <> 0), h AS (SELECT l_orderkey, heading, arg_max(markdown, pos) AS m FROM f GROUP BY ALL)
SELECT s.l_orderkey, s.pos, coalesce(h.m, f.markdown, s.markdown) AS markdown FROM s LEFT JOIN h ON h.l_orderkey = s.l_orderkey AND h.heading = s.heading LEFT JOIN f ON f.l_orderkey = s.l_orderkey AND f.pos = s.pos
""")
def section_sources(spark, sf_dir):
    """Lines of orders as sections; two thirds of them are in the source, one place further up."""
    lines = read(spark, sf_dir, "lineitem", "l_orderkey", F.col("l_linenumber").alias("pos"), "l_returnflag", "l_linestatus")
    sections = lines.groupBy("l_orderkey", "pos").agg(F.concat(F.min("l_returnflag"), F.min("l_linestatus")).alias("heading")).withColumn("markdown", F.lit("own"))
    source = sections.where("pos % 3 <> 0").select("l_orderkey", (F.col("pos") - 1).alias("pos"), F.concat(F.lower("heading"), F.lit(" ")).alias("heading"), F.concat(F.lit("text "), F.col("pos").cast("string")).alias("markdown"))
    return G.sourced(sections, source, ["l_orderkey"]).select("l_orderkey", "pos", "markdown")


@query("""
SELECT p_partkey, p_name, CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE p_brand END AS summary, CASE WHEN p_partkey % 4 = 0 THEN 'student_llm' WHEN p_partkey % 2 = 0 THEN 'rules' ELSE 'cache' END AS summary_source FROM part WHERE p_partkey % 3 <> 0
""")
def cached_topics(spark, sf_dir):
    """Parts as topics: two thirds are in the cache, half have a summary of before."""
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type")
    cached = parts.where("p_partkey % 3 <> 0").select("p_partkey", F.col("p_brand").alias("summary"), F.lit("cache").alias("summary_source"))
    before = parts.where("p_partkey % 2 = 0").select("p_partkey", F.col("p_type").alias("summary"), F.when(F.col("p_partkey") % 4 == 0, "LLM").otherwise("rules").alias("summary_source"))
    return G.merged_topics(parts.select("p_partkey", "p_name"), cached, before, ["p_partkey"])


@query("""
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_name || ' is it.' WHEN 1 THEN p_name || ' is' ELSE p_name || ' costs $$ ' || p_size || ' $$.' END AS text FROM part
""")
def sanitised_texts(spark, sf_dir):
    """Answers that run on into the next exercise, exam tags with a stray $$, and prompts under a banner."""
    name, kind = F.col("p_name"), F.col("p_partkey") % 3
    run_on = F.concat(name, F.lit(" is it.\n\nMultiple Choice Questions\nDIRECTIONS : choose one "), "p_brand")
    tagged = F.concat(name, F.lit(" is [NTSE 2015]  $$"))
    under = F.concat(F.lit("Time to\nCheck Your\nKnowledge\n\n- "), name, F.lit(" costs $$ "), F.col("p_size").cast("string"), F.lit(" $$."))
    return read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size").select("p_partkey", E.sanitised(F.when(kind == 0, run_on).when(kind == 1, tagged).otherwise(under)).alias("text"))


@query("SELECT p_partkey, 'Match these.' AS stem, p_name AS first, p_type AS last, 1 AS n_options FROM part")
def matching_inline(spark, sf_dir):
    """Matching questions whose line ends are lost."""
    text = F.concat(F.lit("Match these. (A) "), "p_name", F.lit(" (B) "), "p_brand", F.lit(" (p) one (q) "), "p_type", F.lit(" (a) A-q, B-p"))
    m = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_type").select("p_partkey", P.inline_matching(text).alias("m"))
    return m.select("p_partkey", "m.stem", F.element_at("m.list_1", 1)["text"].alias("first"), F.element_at("m.list_2", -1)["text"].alias("last"), F.size("m.options").alias("n_options"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 'b' END AS label, CASE WHEN o_orderkey % 3 = 1 THEN (o_custkey % 9)::VARCHAR END AS a, CASE WHEN o_orderkey % 3 = 1 THEN 'q' END AS b, CASE WHEN o_orderkey % 3 = 2 THEN o_orderstatus || ' alone' END AS text FROM orders
""")
def matching_answers(spark, sf_dir):
    """Answers by an option, by pairs and in words."""
    kind = F.col("o_orderkey") % 3
    answer = F.when(kind == 0, "(B)").when(kind == 1, F.concat(F.lit("A-"), (F.col("o_custkey") % 9).cast("string"), F.lit("; B → Q"))).otherwise(F.concat("o_orderstatus", F.lit(" alone ")))
    m = read(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select("o_orderkey", P.matching_answer(answer, F.when(kind == 0, F.array(F.lit("a"), F.lit("b")))).alias("m"))
    return m.select("o_orderkey", "m.label", F.try_element_at("m.pairs", F.lit("A")).alias("a"), F.try_element_at("m.pairs", F.lit("B")).alias("b"), "m.text")


_CROP = "url || '?height=' || h || '&width=' || w || '&top_left_y=' || y || '&top_left_x=' || x"
_CROPS = "SELECT page_id, string_split(string_split(url, '?')[1], '#')[1] AS url, 400 + page_id % 5 * 300 AS h, 400 + page_id % 4 * 300 AS w, page_id % 3 * 300 AS y, page_id % 2 * 1400 AS x FROM pages"


@query(f"""
WITH c AS ({_CROPS}), k AS (SELECT *, x >= 1300 AND y <= 650 AND w BETWEEN 380 AND 550 AND h BETWEEN 380 AND 550 AS logo, w >= 1200 AND h >= 1200 AS whole FROM c)
SELECT page_id, logo, whole, CASE WHEN logo THEN '' WHEN whole AND y <= 500 THEN {_CROP.replace("|| h ||", "|| (h - 460) ||").replace("|| y ||", "|| (y + 460) ||")} ELSE {_CROP} END AS kept FROM k
""")
def crop_kinds(spark, sf_dir):
    """Pages' addresses with crops: logos, whole pages without the logo's band, others as they are."""
    base = F.element_at(F.split("url", "[?#]"), 1)
    k = F.col("page_id")
    number = lambda c: c.cast("string")
    url = F.concat(base, F.lit("?height="), number(400 + k % 5 * 300), F.lit("&width="), number(400 + k % 4 * 300), F.lit("&top_left_y="), number(k % 3 * 300), F.lit("&top_left_x="), number(k % 2 * 1400))
    rows = read(spark, sf_dir, "pages", "page_id", "url").select("page_id", url.alias("u"))
    urls = G.concept_map_urls(F.array("u", "u"))
    return rows.select("page_id", G.is_logo(F.col("u")).alias("logo"), G.is_full_page(F.col("u")).alias("whole"), F.array_join(urls, " ").alias("kept"))


@query("""
WITH b AS (SELECT o_orderkey, 200 + o_orderkey % 5000 AS n, o_orderkey % 100 AS e, o_custkey % 60 AS f FROM orders)
SELECT o_orderkey, greatest(e, e + floor(greatest(n - e, 1) * (greatest(f - 1, 0) / 64.0::DOUBLE))::BIGINT - greatest(floor(greatest(n - e, 1) * 0.03::DOUBLE)::BIGINT, 80)) AS line FROM b
""")
def least_lines(spark, sf_dir):
    from quire.operators.chapters import least_line

    key = F.col("o_orderkey")
    return read(spark, sf_dir, "orders", "o_orderkey", "o_custkey").select("o_orderkey", least_line(200 + key % 5000, key % 100, F.col("o_custkey") % 60, F.lit(64)).alias("line"))
