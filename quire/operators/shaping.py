"""Documents in the shapes that exports and viewers take: fields renamed and left out, tables as HTML, only the figures that are used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as K

from quire.functions import fixed
from quire.functions import text as T
from quire.operators import figures as G
from quire.operators import markup as M
from quire.operators.leaves import rewritten

# --- fixed values ------------------------------------------------------------------------------------------------
PROBLEM, SOLUTION = ("problem", "problem_markdown", "prompt_markdown", "prompt"), ("solution", "solution_markdown")
#: Figures of a topic that carry their bytes in a document.
MOST_EMBEDDED = 80
SHAPE = ("topic_number", "chapter_name", "page_range", "summary", "key_points", "theory_sections")


def is_table_row(line: Column) -> Column:
    """Whether a line is a row of a pipe table: a rule, or two cells at least."""
    s = T.strip(T.text(line))
    inside = F.regexp_replace(F.regexp_replace(s, r"^\|", ""), r"\|$", "")
    return s.rlike(fixed.PIPE_RULE) | inside.contains("|")


def tables_as_html(c: Column) -> Column:
    """A text whose pipe tables are HTML, each in one line; a rule that no row stands before is text. Text without pipes stays as it is."""

    def with_tables(s: Column) -> Column:
        is_row = lambda k: F.coalesce(F.get(s["rows"], k), F.lit(False))
        led = lambda k: F.coalesce(F.get(s["rules"], k), F.lit(False)) & ~is_row(k - 1)  # noqa: E731  a rule that begins a run of rows
        places = F.sequence(F.lit(0), F.size(s["lines"]) - 1)
        begins = F.filter(places, lambda k: is_row(k) & ~led(k) & (~is_row(k - 1) | led(k - 1)))
        ends = F.filter(places, lambda k: is_row(k) & ~led(k) & ~is_row(k + 1))
        return T.bind(F.struct(s["lines"].alias("lines"), begins.alias("begins"), ends.alias("ends")), joined)

    def joined(s: Column) -> Column:
        """What stands before each table, then the table: each stretch of lines is cut out once."""

        def piece(k: Column) -> Column:
            after, upto = F.coalesce(F.get(s["ends"], k - 1) + 1, F.lit(0)), F.coalesce(F.get(s["begins"], k), F.size(s["lines"]))
            rows = F.slice(s["lines"], upto + 1, F.coalesce(F.get(s["ends"], k), upto - 1) - upto + 1)
            table = T.bind(rows, lambda r: F.when(F.size(r) > 0, F.array(M.table_html(r))).otherwise(F.array().cast("array<string>")))
            return F.concat(F.slice(s["lines"], after + 1, upto - after), table)

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size(s["begins"])), piece)), "\n")

    def looked(lines: Column) -> Column:
        rules = F.transform(lines, lambda x: T.strip(x).rlike(fixed.PIPE_RULE))
        return T.bind(F.struct(lines.alias("lines"), F.transform(lines, is_table_row).alias("rows"), rules.alias("rules")), with_tables)

    return F.when(T.text(c).contains("|"), T.bind(T.lines(T.text(c)), looked)).otherwise(T.text(c))


def theory_for_display(c: Column, ids: Column) -> Column:
    """A theory text for display: its pictures as tokens by a map of their ids, its tables as HTML, its formulas as plain text."""
    return M.mathml_text(M.without_formulas(tables_as_html(G.tokenised(c, ids))))


def renamed_item(item: Column, kind: K.StructType) -> Column:
    """An item with its problem and solution, under whatever name, as question and answer, and without the other names.

    A filled problem or solution comes before what question and answer already hold.
    """
    names = [f.name for f in kind]
    told = lambda own, others: T.first_filled(*(item[x] for x in others if x in names), *([item[own]] if own in names else []))
    rest = [item[f.name].alias(f.name) for f in kind if f.name not in (*PROBLEM, *SOLUTION, "question", "answer")]
    return F.when(item.isNotNull(), F.struct(*rest, told("question", PROBLEM).alias("question"), told("answer", SOLUTION).alias("answer")))


def with_questions_and_answers(topics: DataFrame, arrays: tuple[str, ...] = fixed.QA_ARRAYS) -> DataFrame:
    """topics (a row each) with the items of all their arrays renamed; arrays that aren't there are left out."""
    own = {a: topics.schema[a].dataType.elementType for a in arrays if a in topics.columns}
    return topics.withColumns({a: F.transform(a, _renaming(kind)) for a, kind in own.items()})


def _renaming(kind: K.StructType):
    return lambda x: renamed_item(x, kind)


def slim(topics: DataFrame) -> DataFrame:
    """topics (a row each) with the six fields that a table of questions shows of a topic, tables in all their texts as HTML."""
    named = topics.withColumn("chapter_name", T.strip(T.first_filled(*(F.col(c) for c in ("chapter_name", "topic_name") if c in topics.columns))))
    chosen = named.select(*(c for c in topics.columns if c not in (*SHAPE, "topic_name", *fixed.QA_ARRAYS, "image_assets", "metadata")), *(c for c in SHAPE if c in named.columns))
    texts = [c for c in ("summary", "key_points", "theory_sections") if c in chosen.columns]
    return chosen.withColumns({c: rewritten(F.col(c), chosen.schema[c].dataType, tables_as_html) for c in texts})


def qa_metadata(version: Column) -> Column:
    """What a table of questions tells of itself: its layout, the topics' fields, which fields were renamed, and its version (3.x is 3.1)."""
    renamed = {"rows.problem": "question", "rows.solution": "answer", "theory_sections.title": "theory_sections.topics"}
    return F.struct(
        F.lit("qa_view").alias("layout"), F.array(*map(F.lit, SHAPE)).alias("topics_shape"), F.create_map(*(F.lit(x) for kv in renamed.items() for x in kv)).alias("qa_field_map"),
        F.array(*map(F.lit, fixed.QA_ARRAYS)).alias("row_arrays"), F.when(version.startswith("3."), "3.1").otherwise(version).alias("format_version"),
    )


def used_assets(assets: Column, referenced: Column, first: Column | None = None, most: int = MOST_EMBEDDED) -> Column:
    """array<struct<id, asset>>: the figures that a topic refers to and has, those of ``first`` before the others, each by its id's order.

    Each keeps its file and address, so that every reference resolves; beyond so many they lose their bytes.
    """
    early = F.array().cast("array<string>") if first is None else first
    known = F.array_sort(F.array_distinct(F.filter(referenced, lambda r: F.map_contains_key(assets, r))))
    ordered = F.concat(F.filter(known, lambda r: F.array_contains(early, r)), F.filter(known, lambda r: ~F.array_contains(early, r)))
    return F.transform(ordered, lambda r, k: F.struct(r.alias("id"), T.bind(F.try_element_at(assets, r), lambda a: F.when(k < most, a).otherwise(a.withField("base64", F.lit(None).cast("string")))).alias("asset")))


def export_payload(topics: DataFrame, arrays: tuple[str, ...] = ("illustrations", "check_your_knowledge_items", "textbook_exercises", "exercises")) -> DataFrame:
    """topics (a row each) as chapters for export: (topic_number, chapter_name, summary, key_points, theory, rows), texts alone.

    key_points are the filled points' texts, theory (title, body, section_kind), rows (id, question, answer) of the arrays
    in order, an item without an id numbered among all of the topic's.
    """
    items = F.concat(*(F.coalesce(F.transform(a, lambda x: F.struct(T.text(x["id"]).alias("id"), T.first_filled(x["problem"], x["problem_markdown"], x["question"]).alias("question"), T.first_filled(x["solution"], x["solution_markdown"], x["answer"]).alias("answer"))), F.array().cast("array<struct<id:string,question:string,answer:string>>")) for a in arrays))
    numbered = F.transform(items, lambda x, k: F.struct(T.first_filled(x["id"], (k + 1).cast("string")).alias("id"), x["question"].alias("question"), x["answer"].alias("answer")))
    points = F.filter(F.transform("key_points", lambda x: T.strip(T.text(x["text"]))), lambda x: x != "")
    theory = F.transform("theory_sections", lambda s: F.struct(T.first_filled(s["topics"], s["title"], F.lit("Section")).alias("title"), T.text(s["markdown"]).alias("body"), T.text(s["section_kind"]).alias("section_kind")))
    name = T.strip(T.first_filled(F.col("chapter_name"), F.col("topic_name")))
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return topics.select("topic_number", name.alias("chapter_name"), T.text(F.col("summary")).alias("summary"), none(points, "array<string>").alias("key_points"), none(theory, "array<struct<title:string,body:string,section_kind:string>>").alias("theory"), numbered.alias("rows"))
