"""A book's table of contents: where it stands, its entries of six shapes, the chapters they name.

Everything is windows over a book's lines (keys, line_no, line): what a line is, is a built-in expression; where the
contents begin and end, and which lines carry a name on, are values of the window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import text as T

# --- fixed values ------------------------------------------------------------------------------------------------
EXACT, AMBIGUOUS = ("contents", "table of contents"), ("index",)
#: Lines from the book's start in which an unnamed table may begin, lines after its heading, and entries it takes.
SEARCHED, AHEAD, NEEDED = 400, 25, 2
DOTTED = r"^(.+?)\s+\.{3,}\s+([A-Za-z0-9]+)\s*$"
TABLE = r"^\|\s*(.+?)\s*\|\s*([A-Za-z0-9]+)\s*\|$"
TOPIC = r"^(\d+)\.\s+(.+?)(?:\s*\.{3,}\s*|\s*)(\d+-\d+)\s*$"
HEADING_TOPIC = r"^##\s+(\d+)\.\s+(.+?)\s+(\d+-\d+)\s*$"
TABLE_TOPIC = r"^\|\s*(\d{1,2})\s*[.)]?\s*\|\s*(.+?)\s*\|\s*(\d+\s*-\s*\d+)\s*\|\s*$"
PAGES, NUMBER_ONLY, PAGE_SUFFIX = r"^(\d+-\d+)\s*$", r"^(\d+)\.\s+(.+)$", r"\$?(\d+-\d+)\$?\s*$"
BACK, FRONT = ("answers", "index"), ("introduction",)


def entry_line(c: Column) -> Column:
    """A line whose page range stands between dollars or right after a letter, with dots before it."""
    s = F.regexp_replace(T.strip(T.text(c)), r"\$(\d+-\d+)\$", " ..... $1")
    return F.regexp_replace(s, r"([A-Za-z])(\d+-\d+)\s*$", "$1 ..... $2")


def entry_type(label: Column) -> Column:
    low = F.lower(label)
    return (
        F.when(label.rlike(r"^\d+\.\d+"), "section")
        .when(label.rlike(r"^\d+\."), "chapter")
        .when(low.contains("revision exercise"), "revision_exercise")
        .when(low.contains("examination-style exercise"), "exam_exercise")
        .when(low.isin(*BACK), "backmatter")
        .when(low.isin(*FRONT), "frontmatter")
        .otherwise("entry")
    )


def heading_label(c: Column) -> Column:
    """A heading's words in lower case, empty for other lines."""
    s = T.strip(T.text(c))
    return F.when(s.startswith("## "), F.lower(T.strip(F.substring(s, 4, 1 << 30)))).otherwise("")


def looks_like_entry(c: Column) -> Column:
    s = entry_line(c)
    return ~T.strip(c).startswith("| :---") & (s.rlike(DOTTED) | s.rlike(TABLE) | s.rlike(TOPIC))


def marked(lines: DataFrame, keys: list[str]) -> DataFrame:
    """lines with ``begin``, the line of the contents' heading, and ``end``, the first heading after it that is none of its entries; null where there is none.

    A heading named as contents wins, wherever it stands; else the first among the book's first lines that entries follow
    before the next heading.
    """
    own, order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("line_no")
    s, label = T.strip(T.text(F.col("line"))), heading_label(F.col("line"))
    rows = lines.withColumn("_s", s).withColumn("_label", label).withColumn("_entry", looks_like_entry(F.col("line")))
    rows = rows.withColumn("_part", F.sum((F.col("_label") != "").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_head", F.max(F.when(F.col("_label") != "", F.col("line_no"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.col("_entry") & (F.col("line_no") > F.col("_head")) & (F.col("line_no") <= F.col("_head") + AHEAD)
    rows = rows.withColumn("_hits", F.count(F.when(near, 1)).over(Window.partitionBy(*keys, "_part")))
    named = F.min(F.when(F.col("_label").isin(*EXACT), F.col("line_no"))).over(own)
    likely = F.min(F.when((F.col("_label") != "") & (F.col("line_no") < SEARCHED) & (F.col("_hits") >= NEEDED), F.col("line_no"))).over(own)
    rows = rows.withColumn("begin", F.coalesce(named, likely))
    body = (F.col("_label") != "") & ~F.col("_label").isin(*EXACT, *AMBIGUOUS) & ~F.col("_s").rlike(HEADING_TOPIC) & ~F.col("_s").rlike(PAGE_SUFFIX)
    rows = rows.withColumn("end", F.min(F.when(body & (F.col("line_no") > F.col("begin")), F.col("line_no"))).over(own))
    return rows.drop("_entry", "_part", "_head", "_hits")


def ends(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, begin, end) of each book: -1 and 0 where there are no contents, 0 where nothing ends them."""
    found = marked(lines, keys).groupBy(*keys).agg(F.first("begin").alias("begin"), F.first("end").alias("end"))
    return found.select(*keys, F.coalesce("begin", F.lit(-1)).alias("begin"), F.coalesce("end", F.lit(0)).alias("end"))


def _inside(lines: DataFrame, keys: list[str]) -> DataFrame:
    return marked(lines, keys).where((F.col("line_no") > F.col("begin")) & (F.col("end").isNull() | (F.col("line_no") < F.col("end"))))


def _numbered(s: Column, pattern: str) -> Column:
    return F.concat(F.regexp_extract(s, pattern, 1), F.lit(". "), T.strip(F.regexp_extract(s, pattern, 2)))


def entries(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, entry_type, label, page) of the contents' lines that are entries, as they are printed."""
    s = F.col("_s")
    plain = (F.col("_label") == "") | F.col("_label").isin(*EXACT, *AMBIGUOUS)

    def entry(kind: Column | str, label: Column, page: Column) -> Column:
        return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("entry_type"), label.alias("label"), page.alias("page"))

    def of(pattern: str) -> Column:
        label = T.strip(F.regexp_extract(s, pattern, 1))
        return entry(entry_type(label), label, T.strip(F.regexp_extract(s, pattern, 2)))

    chapter = lambda pattern: entry("chapter", _numbered(s, pattern), F.replace(F.regexp_extract(s, pattern, 3), F.lit(" "), F.lit("")))
    found = (
        F.when(~plain, F.when(s.rlike(HEADING_TOPIC), chapter(HEADING_TOPIC)))
        .when((s == "") | s.startswith("| :---"), None)
        .when(s.rlike(TABLE_TOPIC), chapter(TABLE_TOPIC))
        .when(s.rlike(DOTTED), of(DOTTED))
        .when(s.rlike(TABLE), of(TABLE))
        .when(s.rlike(TOPIC), chapter(TOPIC))
    )
    return _inside(lines, keys).select(*keys, "line_no", found.alias("_e")).where("_e is not null").select(*keys, "line_no", "_e.*")


def chapters(lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, line_no, topic_number, topic_name, page_range) of the chapters that the contents name.

    An entry stands on one line, as a heading, a row of a table or with or without dots; or its number begins it, lines
    carry its name on, and a line of pages ends it. A name whose pages never come is left out, and so is what follows it.
    """
    rows = _inside(lines, keys).withColumn("_plain", (F.col("_label") == "") | F.col("_label").isin(*EXACT, *AMBIGUOUS)).withColumn("_t", F.when(F.col("_plain"), entry_line(F.col("line"))).otherwise(F.col("_s")))
    t = F.col("_t")
    whole = lambda pattern: F.struct(F.regexp_extract(t, pattern, 1).cast("int").alias("n"), T.strip(F.regexp_extract(t, pattern, 2)).alias("name"), F.replace(F.regexp_extract(t, pattern, 3), F.lit(" "), F.lit("")).alias("pages"))
    begun = F.struct(F.regexp_extract(t, NUMBER_ONLY, 1).cast("int").alias("n"), T.strip(F.regexp_extract(t, NUMBER_ONLY, 2)).alias("name"), F.lit(None).cast("string").alias("pages"))
    # a row or a dotted line with one page number is an entry of another kind: it neither ends a name nor carries it on
    other = t.rlike(DOTTED) | t.rlike(TABLE)
    opened = (
        F.when(~F.col("_plain"), F.when(t.rlike(HEADING_TOPIC), whole(HEADING_TOPIC)))
        .when(t.rlike(TABLE_TOPIC), whole(TABLE_TOPIC))
        .when(other, None)
        .when(t.rlike(TOPIC), whole(TOPIC))
        .when(t.rlike(PAGES), None)
        .when(t.rlike(NUMBER_ONLY) & ~t.rlike(r"\d+-\d+\s*$"), begun)
    )
    rows = rows.where(t != "").withColumn("_open", opened)
    on = F.when(F.col("_plain") & F.col("_open").isNull() & ~other, F.struct("line_no", "_t", t.rlike(PAGES).alias("pages")))
    rows = rows.withColumn("_on", on).withColumn("_g", F.count("_open").over(Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))).where("_g > 0")
    made = rows.groupBy(*keys, "_g").agg(F.min(F.when(F.col("_open").isNotNull(), F.struct("line_no", "_open"))).alias("o"), F.array_sort(F.collect_list("_on")).alias("on"))
    last = F.get(F.filter("on", lambda x: x["pages"]), F.lit(0))
    made = made.withColumn("_last", last)
    more = F.transform(F.filter("on", lambda x: ~x["pages"] & (x["line_no"] < F.col("_last.line_no"))), lambda x: x["_t"])
    carried = T.strip(F.array_join(F.concat(F.array("o._open.name"), more), " "))
    made = made.select(*keys, F.col("o.line_no").alias("line_no"), F.col("o._open.n").alias("topic_number"), F.when(F.col("o._open.pages").isNull(), carried).otherwise(F.col("o._open.name")).alias("topic_name"), F.coalesce("o._open.pages", F.regexp_extract("_last._t", PAGES, 1)).alias("page_range"))
    return made.where("page_range is not null")
