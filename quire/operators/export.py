"""Nested book documents to rows: flattening, first-wins de-duplication, ordering, shredding, alignment and edits."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as K

from quire.functions import fixed
from quire.functions import text as T

ITEM = """struct<id:string,title:string,question:string,problem:string,problem_markdown:string,prompt_markdown:string,prompt:string,
answer:string,solution:string,solution_markdown:string,explanation:string,source_type:string,question_number:string,
subsection_title:string,subsection_kind:string,source_order:int,passage:string,image_urls:array<string>,
pdf_page_number:int,printed_page_number:int>"""
SECTION = "struct<topics:string,title:string,heading:string,section_title:string,name:string,markdown:string,excerpt:string,content:string,text:string,body:string,section_kind:string,order:int,id:string>"
ASSET = "struct<source_url:string,file:string,mime_type:string,base64:string,caption:string>"
TOPIC = f"""struct<topic_number:int,chapter_name:string,topic_name:string,page_range:string,summary:string,
key_points:array<struct<text:string>>,theory_sections:array<{SECTION}>,
{",".join(f"{a}:array<{ITEM}>" for a in fixed.QA_ARRAYS)},image_assets:map<string,{ASSET}>>"""
BOOK = f"metadata struct<name:string,format_version:string,book_slug:string>, topics array<{TOPIC}>".replace("\n", "")


def as_books(rows: DataFrame) -> DataFrame:
    """Rows (metadata, topics) of fewer fields than a book's, in any order, as books: fields that are missing are null."""
    schema = rows.sparkSession.createDataFrame([], BOOK).schema

    def fitted(c: Column, own: K.DataType, kind: K.DataType) -> Column:
        if isinstance(kind, K.StructType):
            has = {f.name: f.dataType for f in own}
            made = F.struct(*((fitted(c[f.name], has[f.name], f.dataType) if f.name in has else F.lit(None).cast(f.dataType)).alias(f.name) for f in kind))
            return F.when(c.isNotNull(), made)
        if isinstance(kind, K.ArrayType):
            return F.transform(c, lambda x: fitted(x, own.elementType, kind.elementType))
        return c.cast(kind)

    return rows.select(*(fitted(F.col(f.name), rows.schema[f.name].dataType, f.dataType).alias(f.name) for f in schema))


def problem_text(item: Column) -> Column:
    return T.first_filled(*(item[k] for k in ("question", "problem", "problem_markdown", "prompt_markdown", "prompt")))


def solution_text(item: Column) -> Column:
    return T.first_filled(*(item[k] for k in ("answer", "solution", "solution_markdown")))


def topics(books: DataFrame) -> DataFrame:
    """One row for each topic of each book."""
    name = T.first_filled(F.col("metadata.book_slug"), T.book_slug(F.col("metadata.name")))
    # an inner explode would have the topics worked out once more, for a filter on the array's size
    rows = books.select(name.alias("book_slug"), F.posexplode_outer("topics").alias("topic_pos", "topic")).where("topic_pos is not null")
    return rows.withColumn("chapter_name", T.strip(T.first_filled(F.col("topic.chapter_name"), F.col("topic.topic_name"))))


def items(books: DataFrame) -> DataFrame:
    """One row for each item of the five arrays, in the arrays' fixed order, with its place in its own array from 1. Topics are read once for all five."""
    return _exploded(topics(books), lambda x: x)


def _exploded(rows: DataFrame, of: Callable[[Column], Column]) -> DataFrame:
    """What of(item) gives of each item of topics, as ``item``, with where the item stands."""
    listed = []
    for pos, array in enumerate(fixed.QA_ARRAYS):
        own = lambda x, k: F.struct(F.lit(array).alias("section_key"), F.lit(pos).alias("bucket"), of(x).alias("item"), (k + 1).alias("item_order"))  # noqa: B023, E731
        found = F.transform(f"topic.{array}", own)
        listed.append(F.when(found.isNotNull(), found).otherwise(F.array()))
    rows = rows.select("book_slug", "topic_pos", F.col("topic.topic_number").alias("topic_number"), "chapter_name", F.explode_outer(F.concat(*listed)).alias("_x"))
    return rows.where("_x is not null").select("book_slug", "topic_pos", "topic_number", "chapter_name", "_x.*")


def qa_rows(books: DataFrame) -> DataFrame:
    """A row for each item that has a question or an answer. Items that two arrays hold give two rows."""
    section = F.create_map(*(F.lit(x) for kv in fixed.SECTION_TYPE.items() for x in kv))[F.col("section_key")]
    rows = items(books).withColumn("question", problem_text(F.col("item"))).withColumn("answer", solution_text(F.col("item")))
    rows = rows.where("question <> '' or answer <> ''").withColumn("section_type", section)
    return rows.select(
        T.row_id(F.col("book_slug"), F.col("topic_number"), F.col("section_type"), F.col("item_order"), F.col("item.id")).alias("id"),
        "book_slug", "topic_number", "chapter_name", "section_type", "item_order", T.text(F.col("item.title")).alias("title"), "question", "answer",
        T.text(F.col("item.source_type")).alias("source_type"), T.text(F.col("item.id")).alias("item_ref_id"),
    )


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key. A minimum over structs, so a key of any size is combined before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")
    return rows.groupBy(*keys).agg(first).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*rows.columns)


def renumber(rows: DataFrame, group: list[str], order: list[Column], name: str = "question_number") -> DataFrame:
    """Numbers from 1 in each group's order, as strings."""
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)).cast("string"))


def questions(books: DataFrame) -> DataFrame:
    """Distinct questions of each chapter, typed and renumbered: first array, first item wins; items without an order come last."""
    from quire.functions.classify import display_type

    rows = items(books).withColumn("question", problem_text(F.col("item"))).withColumn("answer", solution_text(F.col("item"))).where("question <> '' or answer <> ''")
    rows = rows.withColumn("key", T.dedupe_key(F.col("item.id"), F.col("question"))).withColumn("source_order", F.coalesce("item.source_order", F.lit(1_000_000_000)))
    told = [F.col(f"item.{k}").alias(k) for k in ("subsection_kind", "subsection_title", "explanation")]
    rows = rows.select("book_slug", "topic_pos", "key", "topic_number", "chapter_name", "section_key", "bucket", "item_order", "source_order", "question", "answer", *told)
    rows = first_wins(rows, ["book_slug", "topic_pos", "key"], ["bucket", "item_order"])
    rows = rows.withColumn("exam", exam_tags(F.col("question"))).withColumn("question", sanitised(F.col("question"))).withColumn("answer", sanitised(F.col("answer")))
    rows = rows.withColumn("question_type", display_type(T.text(F.col("subsection_kind")), F.col("question"), T.text(F.col("subsection_title"))))
    display = F.create_map(*(F.lit(x) for kv in fixed.SECTION_DISPLAY.items() for x in kv))[F.col("section_key")]
    rows = renumber(rows, ["book_slug", "topic_pos"], [F.col("source_order"), F.col("bucket"), F.col("item_order")])
    return rows.select("book_slug", "topic_number", "chapter_name", "question_number", "question_type", display.alias("section"), T.text(F.col("subsection_title")).alias("heading"), "exam", "question", "answer", T.text(F.col("explanation")).alias("explanation"))


def exam_tags(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(T.fold_width(T.text(c)), F.lit(fixed.EXAM_TAG), F.lit(1)), F.upper)))


def _without_tail(c: Column) -> Column:
    """Without blank lines at the end and, before them, one short line that begins with a letter and doesn't end as a sentence does."""
    ended = F.regexp_replace(c, r"(?U)\s+\z", "")
    heading = rf"(?U)(?:\A|\n)[^\S\n]*(?!.{{{fixed.HEADING_TAIL_CHARS + 1}}})\p{{L}}[^\n]*(?<![.?:;,])\z"
    return F.regexp_replace(F.regexp_replace(ended, heading, ""), r"(?U)\s+\z", "")


def without_run_on(c: Column) -> Column:
    """A text up to the first heading or banner that something precedes: what it begins with stays."""
    parts = T.pieces(c, r"(?imu)^[ \t]*(?:" + "|".join(f"(?:{p})" for p in fixed.RUN_ON) + ")")

    def cut(p: Column) -> Column:
        # pieces are added until what stands before the next heading is filled: each is looked at once
        start = F.struct(F.lit("").alias("text"), F.lit(False).alias("ends"))

        def step(s: Column, x: Column) -> Column:
            whole = F.struct(F.concat(s["text"], x).alias("text"), F.lit(False).alias("ends"))
            return F.when(s["ends"], s).otherwise(T.bind(_without_tail(s["text"]), lambda t: F.when((s["text"] != "") & T.filled(t), F.struct(t.alias("text"), F.lit(True).alias("ends"))).otherwise(whole)))

        return F.when(F.size(p) > 1, F.aggregate(p, start, step, lambda s: s["text"])).otherwise(F.element_at(p, 1))

    return T.bind(parts, cut)


def sanitised(c: Column) -> Column:
    """A question or an answer without exam tags, what runs on after it, its banner, stranded table rules and an unpaired $$."""
    s = without_run_on(F.regexp_replace(T.fold_width(T.text(c)), fixed.EXAM_TAG, " "))
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)\A\s+", ""), fixed.BANNER, "")
    s = F.regexp_replace(s, fixed.TAG_RULE, " ")
    s = T.bind(s, lambda x: F.when(F.regexp_count(x, F.lit(fixed.DISPLAY_MATH)) % 2 == 1, F.regexp_replace(x, fixed.DISPLAY_MATH, " ")).otherwise(x))
    s = T.strip(F.regexp_replace(F.regexp_replace(s, r"[ \t]{2,}", " "), r"\n{3,}", "\n\n"))
    return T.strip(F.regexp_replace(s, r"(?U)\A[ \t]*[-–—•]\s*", ""))


def theory(books: DataFrame) -> DataFrame:
    """Theory sections with their first filled heading and body; sections with neither are left out."""
    rows = topics(books).select("book_slug", F.col("topic.topic_number").alias("topic_number"), "chapter_name", F.posexplode("topic.theory_sections").alias("pos", "s"))
    title = T.first_filled(*(F.col(f"s.{k}") for k in ("topics", "title", "heading", "section_title", "name")))
    body = T.first_filled(*(F.col(f"s.{k}") for k in ("markdown", "excerpt", "content", "text", "body")))
    rows = rows.withColumn("title", title).withColumn("markdown", body).where(T.filled(F.col("title")) | T.filled(F.col("markdown")))
    named = F.when(F.col("title") == "", F.concat(F.lit("Section "), (F.col("pos") + 1).cast("string"))).otherwise(F.col("title"))
    return rows.select("book_slug", "topic_number", "chapter_name", (F.col("pos") + 1).alias("section_order"), named.alias("title"), "markdown", T.first_filled(F.col("s.section_kind"), F.lit("theory")).alias("section_kind"))


def theory_text(books: DataFrame) -> DataFrame:
    """Each topic's theory as one text: headings and bodies, a blank line between sections."""

    def section(s: Column) -> Column:
        head, body = T.first_filled(*(s[k] for k in ("topics", "title", "heading", "section_title"))), T.first_filled(*(s[k] for k in ("markdown", "excerpt", "content", "text", "body")))
        return F.when(body == "", F.lit("")).when(head == "", body).otherwise(F.concat(F.lit("## "), head, F.lit("\n"), body))

    parts = F.filter(F.transform("topic.theory_sections", section), lambda x: x != "")
    return topics(books).select("book_slug", F.col("topic.topic_number").alias("topic_number"), T.first_filled(F.array_join(parts, "\n\n"), F.col("topic.summary")).alias("theory"))


def resolved_images(books: DataFrame) -> DataFrame:
    """(book_slug, topic_number, section_key, item_order, pos, id, file, source_url): figures in order of first use; an unknown one keeps its id."""

    def found(item: Column) -> Column:
        """An item's figures, looked up in its own topic: nothing is joined."""
        refs = F.array_distinct(T.image_tokens(F.concat_ws(" ", problem_text(item), solution_text(item), item["explanation"])))
        shown = lambda id, a: F.struct(id.alias("id"), T.text(a["file"]).alias("file"), T.text(a["source_url"]).alias("source_url"))
        return F.transform(refs, lambda id: T.bind(F.try_element_at(F.col("topic.image_assets"), id), lambda a: shown(id, a)))

    used = _exploded(topics(books), found).select("book_slug", "topic_number", "section_key", "item_order", F.posexplode_outer("item").alias("pos", "_i"))
    return used.where("pos is not null").select("book_slug", "topic_number", "section_key", "item_order", "pos", "_i.*")


def shredded(books: DataFrame) -> dict[str, DataFrame]:
    """The relational tables of books, each with its declared columns."""
    t = topics(books).withColumn("topic_number", F.col("topic.topic_number"))
    ident = lambda kind, n: T.database_id(F.col("book_slug"), F.col("topic_number"), F.lit(kind), n)
    each = lambda array: t.select("book_slug", "topic_number", F.posexplode(f"topic.{array}").alias("pos", "x")).withColumn("n", F.col("pos") + 1)
    sections = each("theory_sections")
    title = T.first_filled(*(F.col(f"x.{k}") for k in ("topics", "title", "heading", "section_title", "name")))
    body = T.first_filled(*(F.col(f"x.{k}") for k in ("markdown", "excerpt", "content", "text", "body")))
    shown, known, asked = each("illustrations"), each("check_your_knowledge_items"), each("exercises").unionByName(each("textbook_exercises"))
    return {
        "topics": t.select(ident("topic", F.lit(1)).alias("id"), "topic_number", F.col("chapter_name").alias("topic_name"), T.text(F.col("topic.page_range")).alias("page_range"), T.text(F.col("topic.summary")).alias("summary")),
        "theory_sections": sections.select(ident("theory", F.col("n")).alias("id"), "topic_number", F.col("n").alias("order"), title.alias("title"), body.alias("markdown")),
        "illustration_problems": shown.select(ident("illus", F.col("n")).alias("id"), "topic_number", F.col("n").alias("order"), T.text(F.col("x.title")).alias("title"), problem_text(F.col("x")).alias("problem_markdown")),
        "illustration_solutions": shown.select(ident("illussol", F.col("n")).alias("id"), ident("illus", F.col("n")).alias("illustration_problem_id"), "topic_number", F.col("n").alias("order"), solution_text(F.col("x")).alias("solution_markdown")),
        "check_your_knowledge": known.select(ident("cyk", F.col("n")).alias("id"), "topic_number", F.col("n").alias("order"), problem_text(F.col("x")).alias("prompt_markdown"), solution_text(F.col("x")).alias("solution_markdown")),
        "exercise_sections": asked.select(ident("exsec", F.col("n")).alias("id"), "topic_number", F.col("n").alias("order"), T.text(F.col("x.title")).alias("title"), T.text(F.col("x.source_type")).alias("kind")),
        "questions": asked.select(ident("q", F.col("n")).alias("id"), ident("exsec", F.col("n")).alias("exercise_section_id"), "topic_number", F.col("n").alias("order"), T.text(F.col("x.question_number")).alias("number"), problem_text(F.col("x")).alias("prompt_markdown"), solution_text(F.col("x")).alias("solution_markdown"), T.text(F.col("x.subsection_title")).alias("subsection_title")),
        "key_points": each("key_points").select(ident("kp", F.col("n")).alias("id"), "topic_number", F.col("n").alias("order"), F.col("x.text").alias("text")),
        "image_assets": t.select("topic_number", F.explode("topic.image_assets").alias("id", "a")).select("id", "topic_number", F.col("a.caption").alias("caption"), F.col("a.mime_type").alias("mime_type"), F.col("a.base64").alias("base64")),
    }


def rename_repeats(rows: DataFrame, group: list[str], key: str, order: list[str]) -> DataFrame:
    """Repeats of an id in a group get _2, _3, ...: for ids that don't end in such a number themselves. Blank ids stay."""
    n = F.row_number().over(Window.partitionBy(*group, key).orderBy(*order))
    return rows.withColumn("_n", n).withColumn(key, F.when((F.col(key) == "") | (F.col("_n") == 1), F.col(key)).otherwise(F.concat_ws("_", key, "_n"))).drop("_n")


def rename_all_repeats(rows: DataFrame, group: list[str], key: str, order: list[str]) -> DataFrame:
    """As rename_repeats, for any ids: a repeat gets the smallest number that makes an id not seen before in its group, a topic."""
    from quire.operators.segment import _by_group

    at = rows.columns.index(key)

    def work(items: list) -> Iterator[tuple]:
        seen: set[str] = set()
        for r in map(tuple, items):
            name = r[at]
            if name in seen:
                name = next(x for n in count(2) if (x := f"{name}_{n}") not in seen)
            if name:
                seen.add(name)
            yield (*r[:at], name, *r[at + 1 :])

    return _by_group(rows, group, order, work, ", ".join(f"{c} {t}" for c, t in rows.dtypes))


def align_by_rank(asked: DataFrame, answered: DataFrame, coordinates: list[str], order: str) -> DataFrame:
    """Pairs the n-th block of a coordinate with its n-th answer block; unmatched questions keep no answer."""
    place = F.row_number().over(Window.partitionBy(*coordinates).orderBy(order))
    return asked.withColumn("_rank", place).join(answered.withColumn("_rank", place).drop(order), [*coordinates, "_rank"], "left").drop("_rank")


def fill_blanks(rows: DataFrame, answers: DataFrame, keys: list[str], answer: str, order: str) -> DataFrame:
    """Blank answers from the first filled one of the same key."""
    first = first_wins(answers.where(T.filled(F.col(answer))).select(*keys, answer, order), keys, [order]).select(*keys, F.col(answer).alias("_found"))
    return rows.join(first, keys, "left").withColumn(answer, F.when(T.filled(F.col(answer)), F.col(answer)).otherwise(T.text(F.col("_found")))).drop("_found")


def merge_edits(rows: DataFrame, edits: DataFrame, key: str, columns: list[str], only_filled: list[str], order: str) -> DataFrame:
    """Rows with the last edit of each key; the columns of only_filled change only where the edit has something."""
    last = edits.groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_e"))
    out = rows.join(last, key, "left")
    for c in columns:
        new = F.col(f"_e.{c}")
        out = out.withColumn(c, F.when(F.col("_e").isNotNull() & (T.filled(new) if c in only_filled else F.lit(True)), new).otherwise(F.col(c)))
    return out.drop("_e")
