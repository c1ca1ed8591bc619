"""Tables of contents and chapters' names on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import chapters as C
from quire.operators import contents as N
from quire.plans.registry import query, read

#: Shapes of an entry: its lines; n, name, a and b stand for a number, a name and a range of pages.
_SHAPES = (
    ["{n}. {name} ..... {a}-{b}"],
    ["| {n}. | {name} | {a} - {b} |", "| :--- | :--- | :--- |"],
    ["## {n}. {name} {a}-{b}"],
    ["{n}. {name}", "and its kinds", "{a}-{b}", "a line of its own"],
    ["1.{n} {name} ..... {a}"],
    ["Revision Exercise {n} ..... {a}", "| Answers | xi |", "| Introduction | i |"],
    ["{n}. {name}${a}-{b}$", "## Index"],
    ["{n}. {name} without pages", "{n}. {name}{a}-{b}"],
)


def _contents(spark, sf_dir):
    """Brands as books: contents under a right, a wrong or no name, their parts as entries, then a body."""
    parts = read(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand", "p_size")
    value = {"n": F.col("p_size").cast("string"), "name": F.col("p_name"), "a": F.col("p_partkey").cast("string"), "b": (F.col("p_partkey") + 7).cast("string")}

    def line(shape: str):
        out = [F.lit("")]
        for piece in shape.split("{"):
            name, _, rest = piece.partition("}")
            out += [value[name], F.lit(rest)] if name in value else [F.lit(piece)]
        return F.concat(*out)

    shape = F.col("p_partkey") % len(_SHAPES)
    found = None
    for k, lines in enumerate(_SHAPES):
        made = F.array(*map(line, lines))
        found = F.when(shape == k, made) if found is None else found.when(shape == k, made)
    entries = parts.select("p_brand", F.col("p_partkey").alias("part"), F.posexplode(found).alias("at", "line"))
    books = parts.select("p_brand").distinct()
    title = F.when(F.col("p_brand").endswith("1"), "## Contents ").when(F.col("p_brand").endswith("2"), "## Contrents").when(F.col("p_brand").endswith("3"), "##  TABLE OF CONTENTS").otherwise("## Inside")
    before = books.select("p_brand", F.lit(-1).cast("long").alias("part"), F.posexplode(F.array(F.lit("## A book"), F.lit("1. Not yet ..... 1-2"), title, F.lit(""), F.lit("1. One ..... 1-5"), F.lit("2. Two ..... 6-9"))).alias("at", "line"))
    after = books.select("p_brand", F.lit(1 << 60).alias("part"), F.posexplode(F.array(F.lit("## Preface"), F.lit("1. No more ..... 1-2"), F.lit("## 2. Neither 3-4"))).alias("at", "line"))
    every = before.unionByName(entries).unionByName(after)
    place = F.row_number().over(Window.partitionBy("p_brand").orderBy("part", "at")) - 1
    return every.select("p_brand", place.alias("line_no"), "line")


@query("""
WITH e AS (SELECT p_brand, p_size AS n, p_name AS name, p_partkey AS a, p_partkey % 8 AS k FROM part)
SELECT p_brand, n::INTEGER AS topic_number, CASE WHEN k = 3 THEN name || ' and its kinds' ELSE name END AS topic_name, a || '-' || (a + 7) AS page_range FROM e WHERE k IN (0, 1, 2, 3, 6, 7)
UNION ALL SELECT p_brand, unnest([1, 2]), unnest(['One', 'Two']), unnest(['1-5', '6-9']) FROM (SELECT DISTINCT p_brand FROM part)
""")
def contents_chapters(spark, sf_dir):
    """Chapters of eight shapes of entries, names over several lines among them, some without their pages."""
    return N.chapters(_contents(spark, sf_dir), ["p_brand"]).drop("line_no")


@query("""
WITH e AS (SELECT p_brand, p_size AS n, p_name AS name, p_partkey AS a, p_partkey % 8 AS k FROM part)
SELECT p_brand, 'chapter' AS entry_type, n || '. ' || name AS label, a || '-' || (a + 7) AS page FROM e WHERE k IN (0, 1, 2)
UNION ALL SELECT p_brand, 'chapter', n || '. ' || name, a || '-' || (a + 7) FROM e WHERE k = 7
UNION ALL SELECT p_brand, 'section', '1.' || n || ' ' || name, a::VARCHAR FROM e WHERE k = 4
UNION ALL SELECT p_brand, unnest(['revision_exercise', 'backmatter', 'frontmatter']), unnest(['Revision Exercise ' || n, 'Answers', 'Introduction']), unnest([a::VARCHAR, 'xi', 'i']) FROM e WHERE k = 5
UNION ALL SELECT p_brand, 'chapter', unnest(['1. One', '2. Two']), unnest(['1-5', '6-9']) FROM (SELECT DISTINCT p_brand FROM part)
""")
def contents_entries(spark, sf_dir):
    """The same contents' entries as they are printed."""
    return N.entries(_contents(spark, sf_dir), ["p_brand"]).drop("line_no")


@query("""
SELECT p_brand, 2 AS begin, (6 + sum(CASE p_partkey % 8 WHEN 1 THEN 2 WHEN 3 THEN 4 WHEN 5 THEN 3 WHEN 6 THEN 2 WHEN 7 THEN 2 ELSE 1 END))::INTEGER AS "end" FROM part GROUP BY p_brand
""")
def contents_ends(spark, sf_dir):
    """Where contents begin, by their name or by the entries that follow, and where they end."""
    return N.ends(_contents(spark, sf_dir), ["p_brand"])


@query("""
WITH b AS (SELECT p_partkey, p_brand, p_size % 5 AS n, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'Sound' ELSE '' END AS name FROM part),
s AS (SELECT p_partkey, n, CASE WHEN n IN (1, 3) AND name <> 'Sound' THEN 98 WHEN name NOT IN ('Sound', '') THEN 95 ELSE 0 END AS score FROM b)
SELECT p_partkey, n::INTEGER AS topic_number, score::INTEGER AS score FROM s WHERE score > 0
""")
def alias_scores(spark, sf_dir):
    """Parts as books of one chapter; brands are aliases of chapters 1 and 3, taken where the book's own name for the chapter doesn't contradict them."""
    part = read(spark, sf_dir, "part", "p_partkey", "p_brand", "p_size")
    name = F.when(F.col("p_partkey") % 3 == 0, F.col("p_brand")).when(F.col("p_partkey") % 3 == 1, "Sound").otherwise("")
    topics = part.select("p_partkey", (F.col("p_size") % 5).alias("topic_number"), name.alias("topic_name"))
    lines = part.select("p_partkey", F.lit(4).alias("line_no"), F.concat(F.lit("## Parts of the "), F.lower("p_brand")).alias("line"))
    aliases = part.select(F.lower("p_brand").alias("alias")).distinct().select("alias", F.explode(F.array(F.lit(1), F.lit(3))).alias("topic_number"))
    return C.scores(lines, topics, ["p_partkey"], aliases=aliases).drop("line_no")
