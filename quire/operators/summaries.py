"""Summaries of chapters: the tree of headings, an excerpt for each heading, an overview before them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as T
from quire.operators import pedagogy as P

LEVELS = 6


def heading_tree(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, level, title, parent, path) of the headings of lines (keys, line_no, line), which # marks of level 1 to 6 begin.

    parent is the line of the nearest earlier heading of a smaller level, null where there is none; path the titles from
    the top of the tree down to the heading. One pass: the last heading of each level before a line is a window's value,
    and one of them is above the line if no heading of a smaller level stands between.
    """
    before = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    s = T.strip(F.col("line"))
    heads = rows.withColumn("level", F.length(F.regexp_extract(s, r"^(#{1,6})(?!#)\s*\S", 1))).where("level > 0")
    heads = heads.withColumn("title", T.strip(F.regexp_replace(s, r"^#+", "")))
    last = [F.last(F.when(F.col("level") == k, F.struct("line_no", F.lit(k).alias("level"), "title")), ignorenulls=True).over(before) for k in range(1, LEVELS + 1)]
    heads = heads.withColumn("_last", F.array(*last))
    smaller = F.filter("_last", lambda x: x["level"] < F.col("level"))  # null ones go
    above = F.filter(smaller, lambda x: ~F.exists(smaller, lambda y: (y["level"] < x["level"]) & (y["line_no"] > x["line_no"])))
    path = F.concat(F.transform("_above", lambda x: x["title"]), F.array("title"))
    parent = F.when(F.size("_above") > 0, F.element_at("_above", -1)["line_no"])
    return heads.withColumn("_above", above).select(*keys, "line_no", "level", "title", parent.alias("parent"), path.alias("path"))


def subparts(markdown: Column) -> Column:
    """array<struct<title, body>>: a text cut at its headings of the second and third level; what stands before them has no title."""
    cut = T.pieces(F.array_join(T.lines(T.text(markdown)), "\n"), fixed.SUBHEADING)

    def part(p: Column, k: Column) -> Column:
        halves = F.split(p, "\n", 2)
        title = T.strip(F.regexp_replace(T.strip(F.element_at(halves, 1)), r"^#+", ""))
        body = F.when(k > 0, F.coalesce(F.get(halves, F.lit(1)), F.lit(""))).otherwise(p)
        return F.struct(F.when(k > 0, title).otherwise("").alias("title"), T.compact(body).alias("body"))

    return F.filter(F.transform(cut, part), lambda x: (x["title"] != "") | (x["body"] != ""))


def is_candidate(paragraph: Column) -> Column:
    """Whether a paragraph can stand for its section: long enough, no picture, table, caption or list."""

    def fit(p: Column) -> Column:
        filled = F.filter(F.transform(T.lines(p), T.strip), lambda x: x != "")
        listed = F.forall(filled, lambda x: x.rlike(r"(?U)^(?:[-*]|\(\w+\))"))
        other = p.rlike(r"(?iU)^(?:!\[|\||- |\* |\(\w+\)|Fig\.\s|\[image:)") | p.rlike(fixed.PIPE_RULE)
        return (F.length(p) >= fixed.PARAGRAPH_LEAST) & ~other & ~listed

    return T.bind(T.strip(paragraph), fit)


def excerpt(body: Column, most: int = fixed.SUMMARY_CHARS) -> Column:
    """A body's first paragraph that can stand for it, else its first line that isn't a heading or a picture, cut; empty if there is none."""
    text = T.bind(P.without_checks(T.text(body)), lambda s: F.regexp_replace(F.when(s.contains("!["), F.regexp_replace(s, r"!\[[^\]]*\]\([^)]+\)", "")).otherwise(s), r"(?i)<img\b[^>]*>", ""))

    def choose(t: Column) -> Column:
        # once one is found, what follows isn't looked at
        first = lambda found, x: F.when(found.isNotNull(), found).otherwise(T.bind(T.compact(x), lambda p: F.when(is_candidate(p), p)))
        paragraph = F.aggregate(F.split(t, "\n\n"), F.lit(None).cast("string"), first)
        plain = F.filter(F.transform(T.lines(t), T.strip), lambda x: (x != "") & ~x.rlike(r"^(?:#|!\[)"))
        return T.strip(T.truncate(F.coalesce(paragraph, F.get(plain, F.lit(0)), F.lit("")), most))

    return T.bind(text, choose)


def _key(title: Column) -> Column:
    return T.collapse(F.lower(T.text(title)))


def section_blocks(heading: Column, markdown: Column) -> Column:
    """array<struct<level, heading, excerpt>> of a section: its own, then those of its parts; boxes beside the text and parts without text are left out."""

    def blocks(s: Column) -> Column:
        main, md, parts = s["main"], s["md"], s["parts"]
        own = lambda x: _key(x["title"]) == _key(main)
        nested = F.filter(parts, lambda x: (x["title"] != "") & ~own(x))
        intro = F.coalesce(F.get(F.filter(parts, lambda x: (x["title"] == "") | own(x)), F.lit(0))["body"], F.lit(""))
        alone = F.when((F.size(parts) == 1) & T.filled(F.get(parts, F.lit(0))["body"]), F.get(parts, F.lit(0))["body"]).otherwise(md)
        first = F.struct(F.lit(2).alias("level"), main.alias("heading"), excerpt(F.when(F.size(nested) > 0, intro).otherwise(alone)).alias("excerpt"))
        below = F.transform(
            F.filter(nested, lambda x: ~P.is_side_title(P.short_title(x["title"]))),
            lambda x: F.struct(F.lit(3).alias("level"), P.short_title(x["title"]).alias("heading"), excerpt(x["body"], fixed.SUBSUMMARY_CHARS).alias("excerpt")),
        )
        found = F.filter(F.concat(F.array(first), below), lambda x: (x["excerpt"] != "") & (x["heading"] != ""))
        return F.when(P.is_side_title(main), F.array().cast("array<struct<level:int,heading:string,excerpt:string>>")).otherwise(found)

    whole = F.struct(T.first_filled(P.short_title(heading), F.lit("Section")).alias("main"), T.strip(T.text(markdown)).alias("md"))
    return T.bind(whole, lambda s: T.bind(F.struct(s["main"].alias("main"), s["md"].alias("md"), subparts(s["md"]).alias("parts")), blocks))


def overview(excerpts: Column, chapter: Column) -> Column:
    """One paragraph of the beginnings of a chapter's first excerpts."""
    firsts = F.transform(excerpts, lambda x: T.strip(F.element_at(F.split(T.strip(x), "\n\n", 2), 1)))
    fit = F.slice(F.filter(firsts, lambda x: F.length(x) > fixed.SNIPPET_LEAST), 1, fixed.SNIPPETS)
    named = F.when(T.text(chapter) != "", F.concat(F.lit("This chapter ("), chapter, F.lit(") covers the following core ideas. "))).otherwise("This chapter covers the following core ideas. ")
    told = lambda fit: F.concat(named, F.array_join(F.transform(fit, lambda x: T.truncate(x, fixed.SNIPPET_CHARS)), " "))
    return T.bind(fit, lambda f: F.when(F.size(f) > 0, T.strip(T.truncate(told(f), fixed.OVERVIEW_CHARS))).otherwise(""))


def document(introduction: Column, blocks: Column) -> Column:
    """The overview, then every block under its heading."""
    shown = F.transform(blocks, lambda b: F.concat(F.repeat(F.lit("#"), b["level"]), F.lit(" "), b["heading"], F.lit("\n" + fixed.EXCERPT_HEAD), b["excerpt"]))
    head = F.when(introduction != "", F.array(F.concat(F.lit(f"## {fixed.OVERVIEW_HEADING}\n"), introduction))).otherwise(F.array().cast("array<string>"))
    return T.compact(F.array_join(F.concat(head, shown), "\n\n"))


def summaries(sections: DataFrame, keys: list[str], chapter: str, order: str = "order", heading: str = "topics", markdown: str = "markdown") -> DataFrame:
    """(keys, blocks, overview, summary) of each chapter (keys) from its sections' headings and texts.

    Sections are summed up where they stand; what meets is a chapter's excerpts, of at most 700 and 450 characters. A
    chapter of which nothing can be told has an empty summary; null texts count as empty.
    """
    told = sections.select(*keys, F.col(order).alias("_o"), F.col(chapter).alias("_c"), section_blocks(F.col(heading), F.col(markdown)).alias("_b"))
    made = told.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_o", "_b"))).alias("_all"), F.max("_c").alias("_c"))
    made = made.withColumn("blocks", F.flatten(F.transform("_all", lambda x: x["_b"])))
    made = made.withColumn("overview", overview(F.transform("blocks", lambda b: b["excerpt"]), T.text(F.col("_c"))))
    return made.select(*keys, "blocks", "overview", document(F.col("overview"), F.col("blocks")).alias("summary"))
