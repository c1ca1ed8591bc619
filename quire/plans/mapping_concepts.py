"""Concept maps on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import concept_maps as C
from quire.operators import segment as S
from quire.plans.registry import query, read, spread

_URL = "'http://x/p' || (page_id // 4 % 3) || '/' || (page_id % 2) || '?height=' || (100 + page_id * 37 % 1400) || '&width=' || (100 + page_id * 53 % 1500) || '&top_left_y=' || (page_id % 5 * 200) || '&top_left_x=' || (page_id % 3 * 700)"


def _url():
    n = lambda c: c.cast("string")
    k = F.col("page_id")
    parts = ["http://x/p", n(F.floor(k / 4) % 3), "/", n(k % 2), "?height=", n(100 + k * 37 % 1400), "&width=", n(100 + k * 53 % 1500), "&top_left_y=", n(k % 5 * 200), "&top_left_x=", n(k % 3 * 700)]
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


_CHOSEN = f"""
WITH u AS (SELECT page_id, page_id // 6 AS chapter, {_URL} AS url, 100 + page_id * 37 % 1400 AS h, 100 + page_id * 53 % 1500 AS w, page_id % 5 * 200 AS y, page_id % 3 * 700 AS x FROM pages),
k AS (SELECT *, x >= 1300 AND y <= 650 AND w BETWEEN 380 AND 550 AND h BETWEEN 380 AND 550 AS logo, w >= 1200 AND h >= 1200 AND y <= 500 AND h - 460 >= 600 AS high FROM u),
t AS (SELECT page_id, chapter, string_split(url, '?')[1] AS page, CASE WHEN high THEN replace(replace(url, 'height=' || h, 'height=' || (h - 460)), 'top_left_y=' || y, 'top_left_y=' || (y + 460)) ELSE url END AS url, CASE WHEN high THEN h - 460 ELSE h END AS h, w FROM k WHERE NOT logo),
f AS (SELECT *, h * w AS area, w >= 1200 AND h >= 1200 AS whole FROM t QUALIFY row_number() OVER (PARTITION BY chapter, url ORDER BY page_id) = 1),
g AS (SELECT chapter, page, sum(area) AS s, min(page_id) AS first FROM f GROUP BY 1, 2),
b AS (SELECT chapter, arg_max(page, s * 1000000 - first) AS page, max(s) AS s FROM g GROUP BY 1),
c AS (SELECT f.*, b.s, f.page = b.page AS best, bool_or(whole) OVER (PARTITION BY chapter) AS any_whole FROM f JOIN b USING (chapter)),
r AS (SELECT *, row_number() OVER (PARTITION BY chapter, CASE WHEN any_whole THEN whole WHEN s >= 120000 THEN best ELSE true END ORDER BY area DESC, page_id) AS n FROM c)
SELECT chapter, string_agg(url, ' ' ORDER BY n) AS urls FROM r WHERE CASE WHEN any_whole THEN whole AND n = 1 WHEN s >= 120000 THEN best AND n <= 12 ELSE n = 1 END GROUP BY chapter
"""


@query(_CHOSEN)
def map_figures(spark, sf_dir):
    """Of the figures of six pages each, those that are their chapter's map."""
    rows = read(spark, sf_dir, "pages", "page_id").select("page_id", F.floor(F.col("page_id") / 6).alias("chapter"), _url().alias("url"))
    urls = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "url"))), lambda x: x["url"])
    return rows.groupBy("chapter").agg(urls.alias("u")).select("chapter", F.array_join(C.chosen_urls(F.col("u")), " ").alias("urls")).where("urls <> ''")


@query("""
SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '![](http://x/map?height=900&width=900)' WHEN 1 THEN '![](http://x/near?height=600&width=700)' || chr(10) || chr(10) || '![](http://x/near?height=500&width=600)'
  ELSE 'The map of ' || p_name || ' is told in words here, ' || repeat('which go on and on ', 8) || 'to the end.' END AS markdown, (CASE p_partkey % 4 WHEN 1 THEN 2 WHEN 0 THEN 1 ELSE 0 END)::INTEGER AS n FROM part WHERE p_partkey % 4 < 3
""")
def chapter_maps(spark, sf_dir):
    """Parts as chapters: a section named as the map, figures around the first heading, a map in words, none at all."""
    kind = F.col("p_partkey") % 4
    words = F.concat(F.lit("The map of "), "p_name", F.lit(" is told in words here, " + "which go on and on " * 8 + "to the end."))
    text = (
        F.when(kind == 0, F.concat(F.lit("![](http://x/far?height=1&width=1)\n## 1. "), "p_name", F.lit("\ntext\n## (CONCEPT MAP)\n![](http://x/map?height=900&width=900)\nFig.\n## Exercise 1\n")))
        .when(kind == 1, F.concat(F.lit("## Exercise 9\n![](http://x/out?height=2000&width=2000)\n## Solutions\n![](http://x/near?height=500&width=600)\n\n## 2. "), "p_name", F.lit("\n![](http://x/near?height=600&width=700)\n![](http://x/other?height=300&width=400)\n## Next\n![](http://x/late?height=1900&width=1900)")))
        .when(kind == 2, F.concat(F.lit("## C O N C E P T M A P\n"), words, F.lit("\n## 3. "), "p_name"))
        .otherwise(F.concat(F.lit("## 4. "), "p_name", F.lit("\nno figures")))
    )
    lines = S.lines(spread(spark, sf_dir, "part", "p_partkey", "p_name").select("p_partkey", text.alias("markdown")), ["p_partkey"])
    return C.concept_maps(lines, ["p_partkey"]).select("p_partkey", "markdown", F.size("urls").alias("n"))


@query("""
SELECT o_orderkey, 'Concept Map;' || CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE '2. Light waves;' END || 'Waves;3. Light' AS titles, 'a [image:img_002] b' || chr(10) || o_orderpriority AS waves FROM orders
""")
def arranged_sections(spark, sf_dir):
    """Orders as chapters: the map goes first and keeps its pictures to itself, an opener that repeats the title goes."""
    section = lambda t, m, k=None: F.struct(F.lit(t).alias("topics"), m.alias("markdown"), F.lit(k).cast("string").alias("section_kind"))
    waves = F.concat(F.lit("[image:img_001]\n\na [image:img_002] b\n"), "o_orderpriority", F.lit("\n[IMAGE: img_001]  "))
    sections = F.array(section("2. Light waves", F.lit("![](logo.png) [image:img_009]")), section("Waves", waves), section("CONCEPT MAP", F.lit("[image:img_001]"), "concept_map"), section("3. Light", F.lit("of another number")))
    number = F.when(F.col("o_orderkey") % 2 == 0, 2).otherwise(7)
    made = read(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority").select("o_orderkey", C.arranged(sections, F.lit("Light and Waves"), number).alias("s"))
    at = F.filter("s", lambda s: s["topics"] == "Waves")
    return made.select("o_orderkey", F.array_join(F.transform("s", lambda s: s["topics"]), ";").alias("titles"), F.element_at(at, 1)["markdown"].alias("waves"))
