"""Finding chapters in a book: scores of heading lines, the choice of starts, and the slices between them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as T
from quire.operators.parse import title_similarity
from quire.operators.segment import _by_group, _types

# --- fixed values ------------------------------------------------------------------------------------------------
CONCEPT_MAP = r"(?iu)concept\s*map"
BOUNDARY = r"(?iu)^(?:##\s*)?chapter\b|^!\[|<img"
CONTENTS = r"(?iu)^#*\s*(?:table\s+of\s+)?contents\s*$"
#: Headings that never start a chapter, on the heading's text.
NEVER = (
    r"(?iu)check your knowledge|did you know",
    r"(?iu)<br>",
    r"(?iu)origin of life|evolution vs|case\s*[-:]?\s*(study|[iv]+)|connecting topic|concept\s*map|exercise\s+\d",
    r"(?iu)^(\d+)\.\s+(\([a-d]\)|Steps of construction|Column\s*-?\s*I\b)|^\(\d+\)",
)
#: (least overlap, score) of a heading with the topic's number, and of one without.
NUMBERED_SCORES, NAMED_SCORES = ((0.5, 100), (0.25, 90)), ((0.6, 95), (0.4, 88), (0.25, 82))
#: (least likeness, score) by letters alone, and the scores of a concept map and of a short heading in capitals.
LIKE_SCORES, CONCEPT_MAP_SCORE, SHOUTED_SCORE = ((0.9, 97), (0.8, 94)), 72, 92
ALIAS_SCORE = 98
#: A start's least score; below SURE a line needs a chapter's boundary near it, so many lines away at most.
ACCEPT, SURE, NEAR = 72, 95, 12


def _many(rows: DataFrame) -> DataFrame:
    """Rows of all books for a join, never broadcast: Spark takes what is exploded or made from a narrow table for far smaller than it is."""
    return rows.hint("merge")


def _graded(value: Column, grades: tuple, when: Column | None = None) -> Column:
    """The score of the first grade that a value reaches, else 0; 0 too where a condition doesn't hold."""
    score = F.coalesce(*(F.when(value >= least, score) for least, score in grades), F.lit(0))
    return score if when is None else F.when(when, score).otherwise(0)


def is_alias(title: Column, name: Column, aliases: Column) -> Column:
    """Whether a heading holds another wording of a chapter's name, of an array of them, which the name in the book's own contents doesn't contradict.

    A name agrees that holds the wording or its first word, and so does one that isn't known.
    """
    low, own = F.lower(T.text(title)), F.lower(T.text(name))
    agrees = lambda a: (own == "") | own.contains(a) | own.contains(F.element_at(F.split(a, " "), 1))
    return F.coalesce(F.exists(aliases, lambda a: low.contains(F.lower(a)) & agrees(F.lower(a))), F.lit(False))


def scores(lines: DataFrame, topics: DataFrame, keys: list[str], never: tuple[str, ...] = NEVER, aliases: DataFrame | None = None) -> DataFrame:
    """(keys, topic_number, line_no, score) of heading lines that could start a topic; never: patterns of those that can't, a series adds its own. Each book's headings meet its topics, a short list.

    aliases (topic_number, alias): other wordings of chapters' names, of all books.
    """
    out = [T.strip(F.substring("line", 4, 1 << 30)).rlike(p) for p in never]
    heads = lines.where(F.col("line").startswith("## ") & ~reduce(or_, out)).select(*keys, "line_no", T.clean_heading(F.col("line")).alias("_head"))
    both = heads.join(_many(topics.select(*keys, "topic_number", "topic_name")), keys)
    number = F.regexp_extract("_head", r"^(\d{1,3})\s*[.)]?\s+\S", 1)
    title = F.regexp_replace("_head", r"^\d{1,3}\s*[.)]?\s+", "")
    both = both.withColumn("_n", number).withColumn("_title", title).withColumn("_o", T.title_overlap(F.col("topic_name"), title))
    other = F.lit(False)
    if aliases is not None:
        listed = aliases.groupBy("topic_number").agg(F.collect_set("alias").alias("_aliases"))
        both = both.join(listed, "topic_number", "left").withColumn("_alias", is_alias(F.col("_head"), F.col("topic_name"), F.col("_aliases")))
        other = F.col("_alias")
    both = both.where(other | (F.col("_o") > 0) | F.col("_head").rlike(CONCEPT_MAP) | (F.length("_title") >= 6))
    first, words = F.get(T.title_words(F.col("topic_name")), F.lit(0)), T.title_words(F.col("_title"))
    has_first = F.exists(words, lambda w: (w == first) | ((F.least(F.length(w), F.length(first)) >= 4) & (F.substring(w, 1, 4) == F.substring(first, 1, 4))))
    numbered = _graded(F.col("_o"), NUMBERED_SCORES, F.col("_n").cast("int") == F.col("topic_number"))
    named = _graded(F.col("_o"), NAMED_SCORES, F.coalesce(has_first, F.lit(False)) | (F.col("_o") >= 1.0))
    base = F.when(F.col("_n") != "", numbered).when(F.col("_head").rlike(CONCEPT_MAP), CONCEPT_MAP_SCORE).otherwise(named)
    shouted = (F.col("_title") == F.upper("_title")) & F.size(words).between(1, 4) & (base > 0)
    like = title_similarity("topic_name", "_title")
    score = F.when(F.col("_n") != "", base).otherwise(F.greatest(F.when(shouted, F.greatest(base, F.lit(SHOUTED_SCORE))).otherwise(base), _graded(like, LIKE_SCORES)))
    if aliases is not None:
        score = F.when(F.col("_alias"), ALIAS_SCORE).otherwise(score)
    return both.withColumn("score", score).where("score > 0").select(*keys, "topic_number", "line_no", "score")


def least_line(n_lines: Column, contents_end: Column, first_page: Column, last_page: Column) -> Column:
    """The line before which a topic can't begin, by its first page's share of the book's pages; the contents' end where no page is known."""
    body = F.greatest(n_lines - contents_end, F.lit(1))
    share = F.greatest(F.coalesce(first_page, F.lit(0)) - 1, F.lit(0)) / F.greatest(last_page, F.lit(1))
    slack = F.greatest(F.floor(body * fixed.SLACK_SHARE), F.lit(fixed.SLACK_LINES))
    return F.when(last_page.isNull(), contents_end).otherwise(F.greatest(contents_end, contents_end + F.floor(body * share) - slack)).cast("long")


def starts(lines: DataFrame, topics: DataFrame, keys: list[str], never: tuple[str, ...] = NEVER, aliases: DataFrame | None = None) -> DataFrame:
    """(keys, topic_number, start): each topic's best line after the start of the one before; of equals the first. Topics without one are left out."""
    order = Window.partitionBy(*keys).orderBy("line_no")
    s = T.strip(F.col("line"))
    near = F.max((s.rlike(CONCEPT_MAP)).cast("int")).over(order.rowsBetween(-NEAR, NEAR)) + F.max(s.rlike(BOUNDARY).cast("int")).over(order.rowsBetween(-NEAR, 0))
    contents = F.coalesce(F.max(F.when(s.rlike(CONTENTS) & (F.col("line_no") < 400), F.col("line_no"))).over(Window.partitionBy(*keys)), F.lit(-1))
    marked = lines.withColumn("_near", near > 0).withColumn("_after", contents)
    found = scores(lines, topics, keys, never, aliases).join(_many(marked.select(*keys, "line_no", "_near", "_after")), [*keys, "line_no"])
    found = found.where(((F.col("score") >= SURE) | F.col("_near")) & (F.col("line_no") > F.col("_after")) & (F.col("score") >= ACCEPT))

    def work(group: list) -> Iterator[tuple]:
        after = -1
        for topic in sorted({r.topic_number for r in group}):
            mine = [r for r in group if r.topic_number == topic and r.line_no > after]
            if mine:
                best = max(mine, key=lambda r: (r.score, -r.line_no))
                after = best.line_no
                yield (*(getattr(best, k) for k in keys), topic, best.line_no)

    return _by_group(found.select(*keys, "topic_number", "line_no", "score"), keys, ["topic_number", "line_no"], work, f"{_types(found, keys)}, topic_number int, start int")


def slices(lines: DataFrame, topics: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, topic_number, start, end): up to the next topic's start; to the book's end if the next topic has none."""
    last = lines.groupBy(*keys).agg(F.max("line_no").alias("_last"))
    every = topics.select(*keys, "topic_number").join(_many(found), [*keys, "topic_number"], "left").join(_many(last), keys)
    following = F.lead("start").over(Window.partitionBy(*keys).orderBy("topic_number"))
    return every.withColumn("end", F.coalesce(following - 1, F.col("_last"))).where("start is not null").drop("_last")


def chapter_texts(lines: DataFrame, cut: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, topic_number, markdown) of the slices. A book's lines meet its few slices."""
    inside = lines.join(_many(cut), keys).where(F.col("line_no").between(F.col("start"), F.col("end")))
    body: Column = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda r: r["line"]), "\n")
    return inside.groupBy(*keys, "topic_number").agg(body.alias("markdown"))


def contents(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, topic_number, topic_name, page_range) of contents lines: a number, a name that may go on over lines, a range of pages."""
    s = T.strip(F.col("line"))
    own = Window.partitionBy(*keys)
    begin = F.min(F.when(s.rlike(CONTENTS), F.col("line_no"))).over(own)
    rows = lines.withColumn("_s", F.regexp_replace(F.regexp_replace(s, r"^\|\s*|\s*\|$", ""), r"\s*\|\s*|\.{3,}", " ")).withColumn("_begin", begin)
    rows = rows.where(F.col("line_no") > F.col("_begin"))
    stop = F.min(F.when(F.col("line").startswith("## "), F.col("line_no"))).over(own)
    rows = rows.withColumn("_stop", stop).where("_stop is null or line_no < _stop")
    rows = rows.withColumn("_entry", F.sum(F.col("_s").rlike(r"^\d{1,3}[.)]?\s+\p{L}").cast("long")).over(own.orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))).where("_entry > 0")
    text = T.collapse(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "_s"))), lambda r: r["_s"]), " "))
    shape = r"^(\d{1,3})[.)]?\s+(.*?)\s+(\d{1,4}\s*[-–]\s*\d{1,4})\b.*$"
    made = rows.groupBy(*keys, "_entry").agg(text.alias("t")).where(F.col("t").rlike(shape))
    return made.select(*keys, F.regexp_extract("t", shape, 1).cast("int").alias("topic_number"), F.regexp_extract("t", shape, 2).alias("topic_name"), F.regexp_replace(F.regexp_extract("t", shape, 3), r"\s*[-–]\s*", "-").alias("page_range"))


def slices_of(lines: DataFrame, spans: DataFrame, keys: list[str], before: int = 0, most: int | None = None) -> DataFrame:
    """(keys, topic_number, markdown, urls) of recorded spans "first-last" of a book's lines, counted from 1, and the addresses of the pictures there, each once.

    before: lines that stand ahead of a span and are taken too, as a figure may be printed on the page before; most: lines
    from the span's first one at most. A span that isn't one gives no row; one that goes beyond the book ends with it.
    """
    span = T.page_range(F.col("lines"))
    cut = spans.select(*keys, "topic_number", span.alias("_r")).where("_r is not null")
    last = F.col("_r.last") if most is None else F.least(F.col("_r.last"), F.col("_r.first") + most - 1)
    cut = cut.select(*keys, "topic_number", (F.col("_r.first") - 1 - before).alias("_from"), (last - 1).alias("_to"))
    inside = lines.join(_many(cut), keys).where(F.col("line_no").between(F.col("_from"), F.col("_to")))
    each = inside.groupBy(*keys, "topic_number").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("x"))
    text = F.array_join(F.transform("x", lambda r: r["line"]), "\n")
    return each.select(*keys, "topic_number", text.alias("markdown")).withColumn("urls", F.array_distinct(F.regexp_extract_all("markdown", F.lit(fixed.IMAGE_URL), F.lit(1))))
